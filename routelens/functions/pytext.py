"""Text forms of numbers and times used in messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(ratio: Column, digits: int = 0) -> Column:
    """``0.625 -> 62%``: half-even like the messages this package has to reproduce."""
    return F.format_string(f"%.{digits}f%%", F.bround(ratio * 100, digits))


def whole(x: Column) -> Column:
    """A double with no decimals, half-even."""
    return F.bround(x, 0).cast("bigint").cast("string")


def _with_fraction(ts: Column, pattern: str) -> Column:
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, pattern)
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def iso(ts: Column) -> Column:
    """``2024-01-31T10:00:00[.ffffff]``."""
    return _with_fraction(ts, "yyyy-MM-dd'T'HH:mm:ss")


def plain(ts: Column) -> Column:
    """``2024-01-31 10:00:00[.ffffff]``, ``None`` for a missing time."""
    return F.coalesce(_with_fraction(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("None"))


def title_words(s: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` only restarts after blanks, so words are first split on every boundary between
    letters and other characters.
    """
    runs = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.initcap(w)), "")


def quoted_list(items: Column) -> Column:
    """``['a', 'b']``."""
    body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.concat(F.lit("["), body, F.lit("]"))
