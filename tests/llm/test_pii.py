import hashlib
import random
import re

from basketry.llm import pii
from basketry.llm.pii import find, pii_digest, redact, redacted

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def base(text):
    return [s for s in find(text) if s[0] in PATTERNS]


def test_base_kinds_equal_their_patterns_on_random_texts():
    draw = random.Random(3)
    for alphabet in ("a@.-", "1234.", "0 -5", "+1 ().-9", "aB1@.+ -(é\n", "4111 1111-"):
        for _ in range(400):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
            assert base(text) == brute(text), text


def test_base_kinds_equal_their_patterns_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    assert sum(len(base(r.text)) for r in rows) > 20
    assert all(base(r.text) == brute(r.text) for r in rows)


def test_method_adds_secrets_logins_and_accounts():
    def kinds(t):
        return [(k, t[a:b]) for k, a, b in find(t)]

    assert kinds('x token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!') == [("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]
    assert ("login", "bob:hunter2") in kinds("see https://bob:hunter2@example.com/x")
    assert ("account", "GB82 WEST 1234 5698 7654 32") in kinds("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert ("account", "GB83 WEST 1234 5698 7654 32") not in kinds("IBAN: GB83 WEST 1234 5698 7654 32.")
    assert ("ssn", "078-05-1120") in kinds("SSN 078-05-1120")
    assert find("the token of my account is a plain sentence without numbers") == []


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "İ token " * 50_000):
        find(text)


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é a@b.co, 10.0.0.1 a@b.co", "x"), (3, "é a@b.co, 10.0.0.1 a@b.co", "x"), (4, "999.1.1.1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii_digest(docs).collect(), key=lambda r: r.doc_id)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(0, 0, 0, 0), (0, 0, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0), (0, 0, 0, 0)]
    assert got[0].base_sha256 == got[4].base_sha256 == empty and got[2].spans == "email:2:8,ip:10:18,email:19:25"
    cleaned = {r.doc_id: r.text for r in redact(docs).collect()}
    assert cleaned == {1: None, 2: "", 3: "é <EMAIL>, <IP> <EMAIL>", 4: "999.1.1.1"}
    assert pii_digest(docs.limit(0)).count() == 0
    assert redacted("call +1 (555) 555-0199 now") == "call <PHONE> now"


def test_long_secrets_logins_and_accounts_go_whole():
    token, user, digits = "eyJ0a1" * 400, "user" * 80, "1234567890" * 3
    assert redacted(f"bearer {token}, end") == "bearer <SECRET>, end"
    for a, b in ((user, "pw"), ("bob", user), (user, user)):
        assert redacted(f"see https://{a}:{b}@example.com/x") == "see https://<LOGIN>/x"
    assert ("account", 8, 38) in find(f"account {digits}.")
    assert [s for s in find("token=ab_token=" + "x1" * 300 + " " + "y" * 20) if s[0] == "secret"] == [("secret", 6, 615), ("secret", 15, 615)]
    for text in ("://" + "a" * 400_000, "://a:" + "b" * 400_000, "://" * 130_000, "token " + "a1" * 200_000, "token=" * 70_000, "account " + "1 " * 200_000 + "x"):
        find(text)


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "p", "r", 7)], "doc_id long, text string, _pii string, row string, n_email int")
    got = pii.pii_digest(docs).first()
    assert (got._pii, got.row, got.n_email) == ("p", "r", 1)


def test_passwords_of_any_length():
    spans = lambda t: [t[a:b] for k, a, b in find(t) if k == "secret"]
    assert spans("password: Tr0ub4dor&3") == ["Tr0ub4dor&3"] and spans('passwd = "ab12", x') == ["ab12"]
    assert spans("Passwort:geheim! und") == [] and spans("mot de passe : s3cret.") == ["s3cret"] and spans("password=hunter2)") == ["hunter2"]
    for clean in ("password: required", "the password is 12 letters", "password:", "password = \n x", "password: 1234567", "passwords: a1b2", "token: a1b2", "password: //a1"):
        assert spans(clean) == [], clean
    long = "password: " + "a1&" * 100_000
    assert [b - a for k, a, b in find(long) if k == "secret"] == [300_000]
