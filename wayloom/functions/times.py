"""Date text, ages and durations as column expressions. The session clock is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted ISO 8601 forms. A date is written with or without dashes, by month
# and day or by week; a time with or without colons, down to any part; a zone with or without one.
ISO_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
ISO_TIME = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
ISO_ZONE = r"(?:(Z)|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?"
ISO_COMMON = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?Z?)?$"
ISO_PATTERN = rf"^{ISO_DATE}(?:[^\d]{ISO_TIME}{ISO_ZONE})?$"

DAY_MICROS = 86_400_000_000


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO text, null for anything else.

    Dates, week dates and times in the extended and the basic form; a comma or a dot before a
    fraction, of which the digits after the sixth are cut; any one character between date and
    time. Without a zone the text is UTC.
    """
    part = lambda *groups: F.coalesce(*[F.nullif(F.regexp_extract(text, ISO_PATTERN, g), F.lit("")) for g in groups])
    number = lambda *groups: part(*groups).cast("int")
    year, week = number(1), number(6, 8)
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    weekday = F.coalesce(number(7, 9), F.lit(1))
    last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    by_week = F.when(week.between(1, last_week) & weekday.between(1, 7), F.date_add(monday, (week - 1) * 7 + weekday - 1))
    by_month = F.concat_ws("-", part(1), part(2, 4), part(3, 5)).try_cast("date")
    date = F.when(week.isNotNull(), by_week).otherwise(by_month)
    two = lambda *groups: F.coalesce(part(*groups), F.lit("00"))
    clock = F.concat_ws(":", two(10), two(11, 14), F.concat(two(12, 15), F.lit("."), F.rpad(F.substring(F.coalesce(part(13, 16), F.lit("0")), 1, 6), 6, "0")))
    sign = F.when(part(18) == "-", -1).otherwise(1)
    shift = sign * (F.coalesce(number(19), F.lit(0)) * 3600 + F.coalesce(number(20), F.lit(0)) * 60 + F.coalesce(number(21), F.lit(0)))
    moment = F.concat(date.cast("string"), F.lit(" "), clock).try_cast("timestamp")
    in_range = F.coalesce(number(19), F.lit(0)) < 24
    shifted = F.timestamp_micros(F.unix_micros(moment) - shift.cast("bigint") * 1_000_000)
    # The common forms are Spark's own and take one cast.
    common = F.when(text.rlike(ISO_COMMON) & ~text.startswith("0000"), text.try_cast("timestamp"))
    return F.coalesce(common, F.when(text.rlike(ISO_PATTERN) & in_range & (year > 0), shifted))


def iso_text(moment: Column) -> Column:
    """ISO text of a timestamp; the fraction shows only when it is not zero."""
    fraction = F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS"))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(fraction, F.lit("")))


def floor_div(value: Column, unit: int | Column) -> Column:
    """Whole units in a BIGINT, rounded down also below zero, with no double rounding."""
    unit = unit if isinstance(unit, Column) else F.lit(unit).cast("bigint")
    return F.call_function("div", value - F.pmod(value, unit), unit)


def age_micros(as_of: Column, moment: Column) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(moment)


def age_days(as_of: Column, moment: Column) -> Column:
    """Full 24-hour days between two instants, rounded down (P12); not calendar days."""
    return floor_div(age_micros(as_of, moment), DAY_MICROS)


def duration_text(micros: Column) -> Column:
    """``H:MM:SS`` with an ``N day(s), `` prefix from 24 hours on."""
    days = floor_div(micros, DAY_MICROS)
    seconds = floor_div(F.pmod(micros, F.lit(DAY_MICROS)), 1_000_000)
    two = lambda number: F.lpad(number.cast("string"), 2, "0")
    clock = F.concat_ws(
        ":",
        floor_div(seconds, 3600).cast("string"),
        two(floor_div(seconds, 60) % 60),
        two(seconds % 60),
    )
    prefix = F.when(days == 0, F.lit("")).otherwise(
        F.concat(days.cast("string"), F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    )
    return F.concat(prefix, clock)


def instant(as_of: str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
