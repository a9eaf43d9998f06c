"""Order statistics against sorted lists, however few values an interval may leave."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import quantiles

SCHEMA = "g string, h int, x double, v string"


def rows():
    r = random.Random(3)
    out = [("hot", 1, float(r.choice([r.gauss(0, 1), r.randrange(5), 1e9 * r.random(), 5e-324 * r.randrange(9)])), "") for _ in range(3000)]
    out += [("hot", 1, 7.0, "")] * 900 + [(None, 1, float(i % 10), "") for i in range(50)] + [("one", None, -3.5, ""), ("none", 2, None, ""), ("nan", 2, math.nan, ""), ("nan", 2, 1.0, "")]
    out += [("wide", 3, x, "") for x in (1.7e308, -1.7e308, 0.0, math.inf, -math.inf, 1.0)]
    return out


@pytest.mark.parametrize(("buckets", "few"), [(1024, 10_000), (4, 3), (2, 1), (16, 100)])
def test_places_of_groups(spark, buckets, few):
    places = {"least": F.lit(1), "p50": quantiles.nearest(0.5), "p95": quantiles.nearest(0.95), "last": F.col("samples"), "beyond": F.col("samples") + 1}
    data = rows() if few > 2 else rows()[2500:]
    got = {(r.g, r.h): r for r in quantiles.order_statistics(spark.createDataFrame(data, SCHEMA), ["g", "h"], "x", places, buckets, few).collect()}
    groups = {}
    for g, h, x, _ in data:
        if x is not None and not math.isnan(x):
            groups.setdefault((g, h), []).append(x)
    assert set(got) == set(groups)
    for k, xs in groups.items():
        xs.sort()
        n, r = len(xs), got[k]
        assert (r.samples, r.least, r.p50, r.p95, r["last"], r.beyond) == (n, xs[0], xs[math.ceil(0.5 * n) - 1], xs[math.ceil(0.95 * n) - 1], xs[-1], None)


def test_median_and_all_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2)], "x double")
    assert quantiles.median(df, [], "x").first().asDict() == {"samples": 4, "p50": 3.0}
    assert quantiles.order_statistics(df.where("x > 9"), [], "x", {"a": F.lit(1)}).collect() == []
