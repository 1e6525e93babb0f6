"""Dates. "Now" is always an argument, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_to_iso(c: Column) -> Column:
    """d.m.y, d/m/y, d-m-y or year first to yyyy-mm-dd text; two-digit years are of this century. Not checked by a calendar."""
    p = F.transform(F.split(c, "[./-]"), lambda x: F.trim(x))
    a, b, y = (F.get(p, F.lit(i)) for i in range(3))
    first = F.length(a) == 4
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    year = F.when(first, a).when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    day, month = pad(F.when(first, y).otherwise(a)), pad(b)
    ok = (F.size(p) == 3) & (a != "") & (b != "") & (y != "") & (F.length(day) <= 2) & (F.length(month) <= 2) & (F.length(year) == 4)
    return F.when(ok, F.concat_ws("-", year, month, day))


def iso_or_null(c: Column) -> Column:
    """An instant as ISO text with milliseconds; null for what is no date."""
    return F.date_format(F.try_to_timestamp(c.cast("string")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_date(c: Column, with_time: bool = False) -> Column:
    return F.date_format(c, "dd.MM.yyyy HH:mm" if with_time else "dd.MM.yyyy")


def relative_time(c: Column, as_of: Column) -> Column:
    """How long ago: under a minute, minutes, hours, else the date."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(c)
    return F.when(s < 60, "Az önce").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" dk önce"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" sa önce"))).otherwise(short_date(c))


def open_days(c: Column, as_of: Column) -> Column:
    """Whole days between local midnights, not below zero."""
    return F.greatest(F.lit(0), F.datediff(as_of, c))


def same_month(c: Column, as_of: Column) -> Column:
    return F.coalesce(F.date_trunc("month", c) == F.date_trunc("month", as_of), F.lit(False))


def age_bucket(days: Column) -> Column:
    return F.when(days <= 2, "0-2").when(days <= 5, "3-5").otherwise("5+")


def open_days_label(days: Column) -> Column:
    return F.when(days == 0, "Bugün").otherwise(F.concat(days.cast("string"), F.lit(" gün")))


def open_days_level(days: Column, escalation: Column, red: int = 14) -> Column:
    """How open days are shown: normal without escalation, else red from `red` days on and warn before."""
    return F.when(days.isNull(), None).when(~F.coalesce(escalation, F.lit(False)), "normal").when(days >= red, "red").otherwise("warn")
