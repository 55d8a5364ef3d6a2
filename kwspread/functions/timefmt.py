"""Time helpers (F5-F7, F17-F20). Results are zone-free: dates, formatted strings,
or TIMESTAMP_NTZ, so they do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MAIL_DATE = r"^(?:[A-Za-z]{3},\s*)?([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+([0-9]{4})"
_TIMED = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})[Tt\s]\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)\s*"
_ZONE = r"([zZ]|UTC|GMT|[+-][0-9]{2}:?(?:[0-9]{2})?|[A-Za-z]+/[A-Za-z_/+-]+)"


def _iso_date_first(s: Column) -> Column:
    """Rewrite the date at the start of a value as yyyy-m-d: slashes (year or month
    first), eight digits, and mail dates (`Fri, 05 Jan 2024`)."""
    month = F.array_position(F.lit(list(_MONTHS)), F.lower(F.regexp_extract(s, _MAIL_DATE, 2)))
    mail = F.concat(
        F.regexp_extract(s, _MAIL_DATE, 3), F.lit("-"), month.cast("string"), F.lit("-"),
        F.regexp_extract(s, _MAIL_DATE, 1), F.regexp_replace(s, _MAIL_DATE, ""),
    )
    plain = F.regexp_replace(s, r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?![0-9])", "$1-$2-$3")
    plain = F.regexp_replace(plain, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?![0-9])", "$3-$1-$2")
    plain = F.regexp_replace(plain, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?=$|[Tt\s])", "$1-$2-$3")
    return F.when(month > 0, mail).otherwise(plain)


def lenient_ts(s: Column) -> Column:
    """each value parsed on its own; unparsable -> null (never raises under ANSI).

    Dates: yyyy-m-d, yyyy/m/d, m/d/yyyy, yyyymmdd, `Fri, 05 Jan 2024`. A time may follow
    after T or white space, with a fraction, and a zone after that, with or without
    white space: z/Z, UTC, GMT, +hh, +hhmm, +hh:mm or a region name. Zoned input is
    converted to UTC; naive input is taken as UTC.
    """
    plain = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$")
    trimmed = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.when(plain, s.try_cast("timestamp_ntz")).otherwise(_once(_once(trimmed, _iso_date_first), _read_iso))


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda variable stands for it, so
    the expression stays small however often `body` names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _read_iso(iso: Column) -> Column:
    zoned = "^" + _TIMED[1:] + _ZONE + "$"
    wall = F.concat_ws(" ", F.regexp_extract(iso, _TIMED, 1), F.regexp_replace(F.regexp_extract(iso, _TIMED, 2), ",", "."))
    zone = F.regexp_extract(iso, zoned, 3)
    zone = F.regexp_replace(zone, r"^([+-][0-9]{2}):?$", "$1:00")
    zone = F.regexp_replace(zone, r"^([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    zone = F.regexp_replace(zone, "^(z|GMT)$", "Z")
    # Zoned text becomes an instant rendered as its UTC wall clock; naive text is read
    # directly as a wall clock. A region name needs a space before it.
    instant = F.concat(wall, F.regexp_replace(zone, "^(?=.*/)", " ")).try_cast("timestamp")
    return (
        F.when(iso.rlike(zoned), utc_wall(instant))
        .when(iso.rlike(_TIMED + "$"), wall.try_cast("timestamp_ntz"))
        .when(iso.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), iso.try_cast("timestamp_ntz"))
    )


def utc_wall(ts: Column) -> Column:
    """TIMESTAMP (instant) -> TIMESTAMP_NTZ holding its UTC wall clock (zone-free)."""
    return F.convert_timezone(None, F.lit("UTC"), ts)


def iso_utc(s: Column) -> Column:
    """F5 iso(): lenient parse, naive -> UTC, aware -> converted to UTC, 'yyyy-MM-ddTHH:mm:ssZ'."""
    return F.date_format(lenient_ts(s), ISO_Z)


def week_start(ts: Column) -> Column:
    """Monday of the (Mon-Sun) week, as DATE. Pure date arithmetic (zone-free)."""
    d = F.to_date(ts)
    return F.date_sub(d, F.weekday(d))


def week_label(week: Column) -> Column:
    """'yyyy-MM-dd/yyyy-MM-dd' label of a pandas W-SUN period."""
    return F.concat_ws("/", week.cast("string"), F.date_add(week, 6).cast("string"))


def plus_days(ts: Column, n: int) -> Column:
    """F19 start + N days."""
    return ts + F.make_dt_interval(F.lit(n))


def floor_days_between(high: Column, low: Column) -> Column:
    """F20 floor((high - low) in days) for TIMESTAMP_NTZ/TIMESTAMP values."""
    return F.timestamp_diff("DAY", low, high).cast("long")


def instant_of(ntz: Column) -> Column:
    """TIMESTAMP_NTZ holding a UTC wall clock -> TIMESTAMP instant (zone-free)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ntz))


def utc_date(instant: Column) -> Column:
    """UTC calendar day of a TIMESTAMP instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int"))
