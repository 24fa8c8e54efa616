"""Column builders of the retail model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str, scale: int = 4) -> Column:
    """A double as an exact decimal, so that sums do not hang on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def money_sum(c: Column | str, scale: int = 4) -> Column:
    return F.sum(money(c, scale)).cast("double")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom in doubles; null where bottom is zero or null."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.try_divide(col(top), F.nullif(col(bottom), F.lit(0.0)))


def reconciled(*names: str, missing: str = "missing") -> tuple[Column, Column]:
    """(value, name of the column that gave it) of columns that are one field under several names."""
    value = F.coalesce(*names)
    source = F.lit(missing)
    for name in reversed(names):
        source = F.when(F.col(name).isNotNull(), name).otherwise(source)
    return value, source


def leading_number(raw: Column | str) -> Column:
    """The number that a text begins with, as a bigint; null without one."""
    return F.regexp_extract(raw, "^\\s*(-?[0-9]+)", 1).try_cast("bigint")


def number_format(raw: Column | str, unit: str = " units?") -> Column:
    """``numeric``, ``unit_suffixed`` or ``unparsed``; null for a null."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.when(c.rlike("^-?[0-9]+$"), "numeric").when(c.rlike(f"^-?[0-9]+{unit}$"), "unit_suffixed").when(c.isNotNull(), "unparsed")


def or_member(c: Column | str, member: str) -> Column:
    """A blank or null text as an explicit member."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (F.trim(c) == ""), member).otherwise(F.trim(c))


def exposure_label(week: Column | str, display: Column | str, mailer: Column | str, low: int, high: int) -> Column:
    """One of unknown (outside the observed weeks, or no week), both, display, mailer, not_promoted."""
    week = F.col(week) if isinstance(week, str) else week
    shown, mailed = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)) for c in (display, mailer))
    known = F.coalesce(week.between(low, high), F.lit(False))
    return F.when(~known, "unknown").when(shown & mailed, "both").when(shown, "display").when(mailed, "mailer").otherwise("not_promoted")


def hhmm_timestamp(day: Column | str, hhmm: Column | str) -> Column:
    """A date and a packed HHMM integer as a timestamp; null if the integer is no time."""
    day, hhmm = (F.col(c) if isinstance(c, str) else c for c in (day, hhmm))
    hour, minute = F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int")
    ok = hhmm.between(0, 2359) & (minute < 60)
    return F.when(ok, day.cast("timestamp") + F.make_interval(hours=hour, mins=minute))


def portable_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A nonnegative 60-bit number from the MD5 of the seed and the parts as text, which any SQL engine gives alike; nulls are ``~``."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), 1, 15), 16, 10).cast("bigint")


def canonical_text(c: str, kind: str) -> Column:
    """A column as text that other engines write alike: fractions with six digits, timestamps with microseconds; nulls are ``~``."""
    x = F.col(c)
    if kind in ("double", "float") or kind.startswith("decimal"):
        x = x.cast("decimal(30,6)")
    elif kind.startswith("timestamp"):
        x = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(x.cast("string"), F.lit("~"))
