"""Personal data by anchor expansion: Aho-Corasick finds anchors in one pass, local parsers expand and validate spans.

Anchors are at-signs (email), ``://`` (logins in addresses), plus signs (phone), digits (ip, card) and words that
announce an identifier (secret, account, ssn). A parser reads outwards from its anchor only, so the time grows with the
text however long its runs of letters or digits are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, with_fields

#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "secret", "account", "ssn")
BASE = KINDS[:4]
#: Fixed words that announce a secret, an account number or a social security number, lower-cased.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "bearer", "passwort", "contraseña", "mot de passe")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "routing", "passport", "license no", "customer id")
SSN_CUES = ("ssn", "social security")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"([^\s/?#@:\"'<>]++:[^\s/?#@\"'<>]++)@[A-Za-z0-9\[]")
_SECRET = re.compile(r"[\"']?\s{0,4}(?:=>|:=|=|:|\bis\b)?\s{0,4}[\"'`]?([A-Za-z0-9_+/=.~-]{16})")
#: After a cue for a password and a sign: anything up to white space or a quote, if letters and digits or signs are mixed.
_PASSWORD = re.compile(r"[\"']?\s{0,4}(?:=>|:=|=|:)\s{0,4}[\"'`]?([^\s\"'`<>]++)")
_PASSWORD_CUES = ("password", "passwd", "passwort", "contraseña", "mot de passe")
_SIGNS = frozenset("!#$%&*+@^?~")
_RUN = re.compile(r"[A-Za-z0-9_+/=.~-]*+")
_ACCOUNT = re.compile(r"(?:\s{0,3}(?:number|nummer|num|no|nr|id|code|#))?\.?\s{0,3}[:#=]?\s{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){7,})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?:\s{0,3}(?:number|no|#))?\.?\s{0,3}[:#=]?\s{0,3}([0-9]{3}[- ][0-9]{2}[- ][0-9]{4})(?![0-9])")


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("email", ("@",)), ("login", ("://",)), ("phone", ("+",)), ("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("ssn", SSN_CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _lowered(text: str) -> str:
    """Lower case of the same length, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if start < at and domain else None


def _secret(text: str, at: int, run: list[int]) -> tuple[int, int] | None:
    """The span of a secret after its cue, to the end of its run of characters.

    ``run``: the end of the last run read and its last digit and letter; cues within a run do not read it again.
    """
    m = _SECRET.match(text, at)
    if not m:
        return None
    start = m.start(1)
    if start >= run[0]:
        end = _RUN.match(text, start).end()
        digit = next((i for i in range(end - 1, start - 1, -1) if text[i].isdigit()), -1)
        letter = next((i for i in range(end - 1, start - 1, -1) if text[i].isalpha()), -1)
        run[:] = end, digit, letter
    mixed = run[1] >= start and run[2] >= start
    return (start, run[0]) if mixed and not m[1].startswith("//") else None


def _password(text: str, at: int) -> tuple[int, int] | None:
    """The span of a password of any length after its cue: up to white space or a quote, without the sentence's last marks."""
    m = _PASSWORD.match(text, at)
    if not m:
        return None
    value = m[1].rstrip(".,;:)]}")
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    mixed = digit and letter or (digit or letter) and any(c in _SIGNS for c in value.rstrip("!?"))
    return (m.start(1), m.start(1) + len(value)) if mixed and not value.startswith("//") and len(value) >= 4 else None


def _account(text: str, at: int) -> tuple[int, int] | None:
    m = _ACCOUNT.match(text, at)
    return m.span(1) if m and (m[1][0].isdigit() or _iban(m[1])) else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, by start and then kind; a null text has none.

    Spans of one base kind never overlap: each begins where the one before has ended, or later, whether that was
    valid or not. Spans of different kinds may overlap.
    """
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    ends = {"email": 0, "phone": 0}
    run = [0, -1, -1]
    for last, (kind, width) in _anchors().iter(_lowered(text)):
        at, after = last - width + 1, last + 1
        if kind == "email":
            if span := _email(text, at, ends["email"]):
                ends["email"] = span[1]
                out.append(("email", *span))
        elif kind == "phone":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
        elif kind == "login":
            if m := _LOGIN.match(text, after):
                out.append(("login", *m.span(1)))
        elif at and text[at - 1].isalnum():
            continue  # a cue begins a word
        elif kind == "secret":
            span = _secret(text, after, run)
            if not span and text[at:after].lower() in _PASSWORD_CUES:
                span = _password(text, after)
            if span:
                out.append(("secret", *span))
        elif kind == "account":
            if span := _account(text, after):
                out.append(("account", *span))
        elif m := _SSN.match(text, after):
            out.append(("ssn", *m.span(1)))
    out += _digits(text)
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _digits(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield ("ip", *m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield ("card", *m.span())


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with ``<KIND>`` in place of each span; of spans that overlap or touch, one mark with the first's kind."""
    if not text:
        return text
    parts, done = [], 0
    for kind, start, end in find(text) if spans is None else spans:
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii: array<struct<kind, start, end>>, in code points of the whole text; empty for null and clean texts.

    All other columns and repeated rows stay; a column pii is replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts])

    return docs.withColumn("pii", spans(F.col(text)))


def pii_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_<base kind> counts, base_sha256 over the base spans, and spans, all listed as kind:start:end.

    Null and empty texts have no spans: counts of zero, the digest of an empty list and an empty list. All rows and other
    columns stay; columns of the six names are replaced.
    """
    small_batches(docs.sparkSession)
    fields = [f"n_{k}" for k in BASE] + ["base_sha256", "spans"]

    @F.pandas_udf(", ".join(f"{f} {'long' if f[:2] == 'n_' else 'string'}" for f in fields))
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = find(t)
            base = [s for s in found if s[0] in BASE]
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        return pd.DataFrame(rows, columns=fields)

    return with_fields(docs, digest(F.col(text)), fields)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its ``<KIND>``; null texts stay null, other columns as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t) for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
