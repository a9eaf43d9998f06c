"""Rates, percentiles and parsed numbers, with the rounding that the metrics define."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(n: Column, d: Column, digits: int = 6) -> Column:
    """n / d, ties rounded to even; 0 where d is 0."""
    return F.coalesce(F.bround(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), digits), F.lit(0.0))


def harmonic(p: Column, r: Column, digits: int = 6) -> Column:
    """F1 of an already rounded precision and recall."""
    return F.when(p + r > 0, F.bround(2 * p * r / (p + r), digits)).otherwise(F.lit(0.0))


def nearest_rank(name: str, q: float, digits: int = 3) -> Column:
    """The value of the named column at place ceil(q * n); nulls do not count."""
    return F.bround(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{name}`)"), digits)


def clamp(x: Column) -> Column:
    """Confidence in [0, 1]; null and NaN are 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def plain_number(text: Column) -> Column:
    """Decimal of a text with a comma or a point; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("decimal(38,6)")


def shown_number(text: Column) -> Column:
    """plain_number as text: a whole number without decimals."""
    d = plain_number(text)
    return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("double").cast("string"))


def decimal_token(text: Column) -> Column:
    """Decimal of a token whose separators may part thousands or decimals.

    With both kinds the later one parts decimals. A single kind parts thousands if it occurs more than once or exactly three
    digits follow it, else decimals.
    """
    t = F.regexp_extract(text, r"([0-9][0-9.,]*)", 1)
    comma, point = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    n = lambda sep: F.length(t) - F.length(F.replace(t, F.lit(sep), F.lit("")))
    drop = lambda x, sep: F.replace(x, F.lit(sep), F.lit(""))
    one = lambda sep, at: F.when((n(sep) > 1) | (at == 4), drop(t, sep)).otherwise(F.replace(t, F.lit(sep), F.lit(".")))
    plain = (
        F.when((comma > 0) & (point > 0), F.when(comma < point, F.replace(drop(t, "."), F.lit(","), F.lit("."))).otherwise(drop(t, ",")))
        .when(comma > 0, one(",", comma))
        .when(point > 0, one(".", point))
        .otherwise(t)
    )
    return plain.try_cast("decimal(38,6)")


def half_step(v: Column) -> Column:
    """Whether a score lies in [0, 9] on a step of one half."""
    return v.between(0, 9) & (v * 2 == F.floor(v * 2))


def salary(text: Column) -> Column:
    """Whole amount of a salary text: with a unit of a million or a thousand a decimal times the unit, else the digits of the first number."""
    low = F.lower(text)
    token = F.regexp_extract(low, r"([0-9]+(?:[.,][0-9]+)*)", 1)
    unit = F.when(low.rlike("triệu|trieu|million"), 1_000_000).when(low.rlike("nghìn|ngàn|nghin|thousand"), 1_000)
    amount = F.when(unit.isNotNull(), decimal_token(token) * unit).otherwise(F.regexp_replace(token, "[^0-9]", "").try_cast("decimal(38,6)"))
    return F.when(amount == F.floor(amount), amount.try_cast("long"))


def years(text: Column) -> Column:
    """Years of experience; months count twelfths where both are named."""
    low = F.lower(text)
    months = F.regexp_extract(low, r"([0-9]+)\s*(?:tháng|month)", 1).try_cast("int")
    both = low.rlike("năm|year") & months.isNotNull()
    n = F.regexp_extract(low, r"([0-9]+(?:[.,][0-9]+)*)", 1)
    return F.bround(decimal_token(n).cast("double") + F.when(both, months / 12).otherwise(0.0), 6)
