"""Log timestamps as wall-clock times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2}(?:\.\d{1,6})?)?)"
# Accepted timestamp layouts; group 1 of the ISO forms is the clock.
CLF_TIME = r"^\d{1,2}/(?:" + _MONTHS.replace(" ", "|") + r")/\d{4}:\d{1,2}:\d{1,2}:\d{1,2} " + _OFFSET + "$"
ISO_TIMES = (
    r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)" + _OFFSET + "$",
    r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})$",
)


def _clock(day: Column, month: Column, year: Column, time: Column) -> Column:
    number = F.shiftright(F.instr(F.lit(_MONTHS), month) + 3, 2).cast("string")
    return F.concat(year, F.lit("-"), number, F.lit("-"), day, F.lit(" "), time)


def clf_time(raw: Column) -> Column:
    """``03/Apr/2026:10:15:01 +0000`` -> wall clock; NULL when it does not parse.

    The offset is checked and dropped: the inventory compares clocks as they were logged.  The
    usual two-digit layout is cut by position, which is several times cheaper than splitting.
    """
    usual = _clock(F.substring(raw, 1, 2), F.substring(raw, 4, 3), F.substring(raw, 8, 4), F.substring(raw, 13, 8))
    part = F.split(raw, "[/: ]")
    any_width = _clock(
        *[F.get(part, F.lit(i)) for i in range(3)], F.concat_ws(":", *[F.get(part, F.lit(i)) for i in (3, 4, 5)])
    )
    two_digits = (F.substring(raw, 3, 1) == "/") & (F.substring(raw, 21, 1) == " ")
    return F.when(raw.rlike(CLF_TIME), F.when(two_digits, usual).otherwise(any_width)).try_cast("timestamp_ntz")


def iso_time(raw: Column) -> Column:
    """ISO text with a zone, or ``yyyy-mm-dd hh:mm:ss`` without one, as wall clock."""
    clocks = [F.regexp_extract(raw, pattern, 1) for pattern in ISO_TIMES]
    return F.coalesce(*[c.try_cast("timestamp_ntz") for c in clocks])


def any_time(raw: Column) -> Column:
    return F.coalesce(iso_time(raw), clf_time(raw))


def loose_iso_time(raw: Column) -> Column:
    """Any ISO date or date-time, with or without a zone, as wall clock."""
    clock = F.regexp_extract(
        raw, r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?)(?:Z|[+-]\d{2}:?\d{2})?$", 1
    )
    return clock.try_cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Difference of two wall clocks in seconds, as a double, independent of the session zone."""
    span = end - start
    return (
        F.extract(F.lit("DAY"), span) * 86400.0
        + F.extract(F.lit("HOUR"), span) * 3600.0
        + F.extract(F.lit("MINUTE"), span) * 60.0
        + F.extract(F.lit("SECOND"), span).cast("double")
    )
