"""Column functions over text, numbers and times. All are built-in expressions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that matching treats as one, and what stands for them.
FOLDED_FROM, FOLDED_TO = "‘’“”—–", "''\"\"--"
ELLIPSIS = "…"
#: White space as Unicode has it, and the four separators that Java's class leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Folded for matching: plain quotes, dashes and dots, lower case, single spaces, none at the ends; null becomes empty."""
    plain = F.replace(F.translate(F.coalesce(_col(c), F.lit("")), FOLDED_FROM, FOLDED_TO), F.lit(ELLIPSIS), F.lit("..."))
    return F.trim(F.regexp_replace(F.lower(plain), SPACES, " "))


def token_estimate(c: Column | str) -> Column:
    """A token for every four characters, rounded up; none for no text."""
    return F.ceil(F.length(F.coalesce(_col(c), F.lit(""))) / 4).cast("long")


def human_size(c: Column | str) -> Column:
    """Bytes for people: `12 bytes`, `1.0 KB`, `1.00 MB`, `1.00 GB`."""
    b = _col(c)
    kb, mb, gb = (F.lit(1024.0**k) for k in (1, 2, 3))
    return (
        F.when(b < 1024, F.concat(b.cast("string"), F.lit(" bytes")))
        .when(b < 1024**2, F.concat(F.format_string("%.1f", b / kb), F.lit(" KB")))
        .when(b < 1024**3, F.concat(F.format_string("%.2f", b / mb), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", b / gb), F.lit(" GB")))
    )


def human_elapsed(c: Column | str) -> Column:
    """Seconds for people: `5.0s`, `2m 30s`, `1h 1m`."""
    s = _col(c)
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.concat(F.format_string("%.1f", s.cast("double")), F.lit("s")))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def truncate(c: Column | str, n: int) -> Column:
    """The first n characters and three dots, if there are more."""
    text = _col(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def epoch_date(c: Column | str) -> Column:
    """The UTC date of epoch seconds, as text. The session's time zone has to be UTC."""
    return F.date_format(F.timestamp_seconds(_col(c)), "yyyy-MM-dd")


def period(first: Column | str, last: Column | str) -> Column:
    return F.concat_ws(" to ", epoch_date(first), epoch_date(last))


def capital(c: Column | str) -> Column:
    """First letter upper case, the rest lower."""
    text = _col(c)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def percent_reduced(before: Column | str, after: Column | str) -> Column:
    """Percent by which after is less than before; 0 where there was nothing."""
    b, a = _col(before), _col(after)
    return F.when(b > 0, (1 - a / b) * 100).otherwise(F.lit(0.0))


def plain_number(c: Column | str) -> Column:
    """A double in positional notation with at least one decimal, as in `1700000000.0`."""
    return F.regexp_replace(_col(c).cast("decimal(26,6)").cast("string"), r"(\.\d+?)0+$", "$1")
