"""Dates and clock times out of text; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import once

#: Day, month and year in figures, and written out in Vietnamese (fixed values).
NUMERIC = r"(?<![0-9])([0-9]{1,2})\s*[/.\-]\s*([0-9]{1,2})\s*[/.\-]\s*([0-9]{4})(?![0-9])"
NAMED = r"(?iu)ngày\s*([0-9]{1,2})\s*tháng\s*([0-9]{1,2})\s*năm\s*([0-9]{4})"
CLOCK = r"(?<![0-9])([01]?[0-9]|2[0-3])\s*[:hH]\s*([0-5][0-9])(?![0-9])"
#: Whole-text formats in the order in which they are tried.
FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/MMM/yyyy", "d MMMM yyyy", "d 'tháng' M 'năm' yyyy")


def of_parts(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def first_date(text: Column) -> Column:
    """First date in figures, else the first written out; null if the day does not exist."""
    of = lambda p: of_parts(*(F.regexp_extract(text, p, i) for i in (3, 2, 1)))
    return F.when(text.rlike(NUMERIC), of(NUMERIC)).when(text.rlike(NAMED), of(NAMED))


def date_key(text: Column) -> Column:
    """The date of a whole text in the first format that parses."""
    return F.coalesce(*(F.try_to_date(F.trim(text), f) for f in FORMATS))


def short_year(text: Column) -> Column:
    """d/m/y with a year of two digits counted from 2000."""
    p = r"^\s*([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2}|[0-9]{4})\s*$"
    y = F.regexp_extract(text, p, 3)
    return of_parts(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 1))


def named_dates(text: Column) -> Column:
    """All dates written out in Vietnamese, in order; days that do not exist are left out."""
    each = F.regexp_extract_all(text, F.lit(f"({NAMED})"), F.lit(1))
    return F.filter(F.transform(each, lambda m: of_parts(*(F.regexp_extract(m, NAMED, i) for i in (3, 2, 1)))), lambda d: d.isNotNull())


def typed_date(text: Column) -> Column:
    """A date in ISO form or in figures, else three whole numbers of which the last has four digits."""
    p = r"^\D*([0-9]{1,2})\D+([0-9]{1,2})\D+([0-9]{4})\D*$"
    return F.coalesce(F.try_to_date(F.trim(text), "yyyy-MM-dd"), first_date(text), F.when(text.rlike(p), of_parts(*(F.regexp_extract(text, p, i) for i in (3, 2, 1)))))


def duration_key(text: Column) -> Column:
    """`qualifier|amount|unit` of a whole text that names years of experience; null else."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    p = r"^(?:(hơn|trên|ít\s+nhất)\s+)?(\d+(?:[.,]\d+)?)\s*(năm|nam|years|year)(?:\s+kinh\s+nghiệm)?$"
    part = lambda i: F.regexp_extract(t, p, i)
    return F.when(t.rlike(p), F.concat_ws("|", part(1), F.replace(part(2), F.lit(","), F.lit(".")), F.when(part(3).isin("năm", "nam"), "năm").otherwise("year")))


WORK_DAYS = 5


def weekly_hours(text: Column, days: int = WORK_DAYS) -> Column:
    """Hours of a week of work days, each of the two spans that the first four clock times of the text bound; null with fewer times."""
    p = r"(\d{1,2})[hH](\d{2})?"
    at = lambda m: F.regexp_extract(m, p, 1).try_cast("int") * 60 + F.coalesce(F.regexp_extract(m, p, 2).try_cast("int"), F.lit(0))
    times = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2}[hH](?:\d{2})?)"), F.lit(1)), at)
    span = lambda ts: (F.get(ts, F.lit(1)) - F.get(ts, F.lit(0)) + F.get(ts, F.lit(3)) - F.get(ts, F.lit(2))) / F.lit(60.0)
    return once(times, lambda ts: F.when(F.size(ts) >= 4, F.bround(span(ts) * days, 2)))


def minutes(text: Column) -> Column:
    """Minutes of the day of the first clock time; null without one."""
    h, m = (F.regexp_extract(text, CLOCK, i).try_cast("int") for i in (1, 2))
    return h * 60 + m


def span_hours(start: Column, end: Column) -> Column:
    return (minutes(end) - minutes(start)) / F.lit(60.0)


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1
