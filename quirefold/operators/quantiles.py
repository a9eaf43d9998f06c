"""Exact order statistics of groups of any size, without a group's values in one place.

The interval that holds a wanted rank is cut into buckets, which are counted; the one bucket that holds the rank is the next interval, until
few values are left in it. Intervals of all groups and ranks narrow in the same job, counts are partial sums, and only the values of the
last buckets are looked at one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.operators.governance import cut

BUCKETS = 1024
#: Values of an interval that are compared one by one.
FEW = 10_000
BROADCAST_GROUPS = 100_000


def nearest(q: float) -> Column:
    """The place of the nearest rank of a quantile among `samples` values."""
    return F.greatest(F.lit(1), F.ceil(q * F.col("samples") - 1e-9)).cast("long")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)), F.lit(True))


def _inside(values: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """values (by, v) that lie in a span (by, lo, hi) of their group; the same value once for each such span."""
    names = [f"s_{b}" for b in by]
    spans = spans.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), "lo", "hi")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_GROUPS else spans
    return values.join(spans, _same(by, names) & F.col("v").between(F.col("lo"), F.col("hi"))).select(*by, "lo", "hi", "v")


def _picked(wanted: DataFrame, counts: DataFrame, by: list[str], order: str, *more: str) -> DataFrame:
    """For each wanted (by, name, place, lo, hi) the row of counts (by, lo, hi, order, k, more) that its place falls into, and the place within that row."""
    before = F.sum("k").over(Window.partitionBy(*by, "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    names = [f"c_{x}" for x in (*by, "lo", "hi")]
    rows = rows.select(*(F.col(x).alias(n) for x, n in zip((*by, "lo", "hi"), names, strict=True)), "k", "before", *more)
    met = wanted.join(rows, _same([*by, "lo", "hi"], names) & (F.col("before") < F.col("place")) & (F.col("place") <= F.col("before") + F.col("k")))
    return met.withColumn("place", F.col("place") - F.col("before"))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column], buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by, samples, a column for each of places): the values at places (from 1, expressions over samples) in ascending order of each group.

    Nulls and NaN do not count, and groups without any other value have no row; null keys are one group; places outside 1..samples give null.
    """
    if not by:
        return order_statistics(rows.select(F.lit(0).alias("_all"), value), ["_all"], value, places, buckets, few).drop("_all")
    values = rows.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    groups = cut(values.groupBy(*by).agg(F.count("*").alias("samples"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), p.cast("long").alias("place")) for n, p in places.items())))
    wanted = groups.select(*by, "lo", "hi", F.col("samples").alias("n"), each.alias("w")).select(*by, "lo", "hi", "n", "w.name", "w.place").where("place BETWEEN 1 AND n")
    columns = [*by, "name", "place", "lo", "hi", "n"]
    while not (wide := wanted.where((F.col("n") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        held = _inside(values, wide.select(*by, "lo", "hi").distinct(), by)
        # Halves, so that the widest interval has a finite width.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.lit(buckets - 1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * buckets).cast("int"))
        bucket = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), buckets - 1).otherwise(bucket)
        counts = held.groupBy(*by, "lo", "hi", bucket.alias("bucket")).agg(F.count("*").alias("k"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        narrow = _picked(wide, counts, by, "bucket", "lo2", "hi2").select(*by, "name", "place", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("k").alias("n"))
        wanted = cut(wanted.where((F.col("n") <= few) | (F.col("lo") >= F.col("hi"))).select(*columns).unionByName(narrow.select(*columns)))
    spread = wanted.where("lo < hi")
    counts = _inside(values, spread.select(*by, "lo", "hi").distinct(), by).groupBy(*by, "lo", "hi", "v").agg(F.count("*").alias("k"))
    found = _picked(spread, counts, by, "v", "v").select(*by, "name", "v").unionByName(wanted.where("lo = hi").select(*by, "name", F.col("lo").alias("v")))
    out = found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in places))
    names = [f"g_{b}" for b in by]
    sizes = groups.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), "samples")
    return sizes.join(out, _same(names, by), "left").select(*(F.col(n).alias(b) for b, n in zip(by, names, strict=True)), "samples", *places)


def median(rows: DataFrame, by: list[str], value: str, name: str = "p50") -> DataFrame:
    """(by, samples, name): the middle value, or the mean of the two middle ones."""
    two = order_statistics(rows, by, value, {"_low": F.floor((F.col("samples") + 1) / 2), "_high": F.floor((F.col("samples") + 2) / 2)})
    return two.select(*by, "samples", (F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias(name))
