"""Fuzzy joins by match ratio over an index of q-grams, exact for every pair.

A ratio of t needs M >= t * (a + b) / 2 matched letters in blocks, and blocks are parted by unmatched letters, of which a + b - 2 * M are
left; so the texts share at least M - (q - 1) * (a + b - 2 * M + 1) q-grams. Of two sets that share c grams, in one order for
all texts, the first size - c + 1 grams of either hold a common one. Texts meet by such grams alone, rarest first; what meets
must have lengths and shared grams that allow the ratio, and only then Python computes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import match_ratio

#: Kinds of grams that are broadcast with their numbers; with more, they are joined by shuffle.
BROADCAST_GRAMS = 100_000


def least_shared(a: int | Column, b: int | Column, least: float, q: int):
    """The least number of q-grams that texts of a and b letters share if their ratio is `least` or more (before it is rounded up)."""
    return (a + b) * (least / 2 * (2 * q - 1) - (q - 1)) - (q - 1)


def shortest(least: float) -> float:
    """Texts of at least so many letters share two letters in a row with all they are like; infinite if none need."""
    gain = 1.5 * least - 1
    # Of two such texts the shorter has at least least / (2 - least) of the other's letters.
    return math.inf if gain <= 0 else math.ceil(2 / gain / (1 + least / (2 - least))) + 1


def grams(text: Column, q: int) -> Column:
    """The q-grams of a text, each with how often it stood before: a set that keeps repeats."""
    n = F.length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - q + 1)), lambda i: F.substr(text, i, F.lit(q)))
    return F.when(n >= q, F.transform(each, lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice(each, F.lit(1), i), lambda x: x == g)).cast("string")))).otherwise(F.array().cast("array<string>"))


def _indexed(texts: DataFrame, kinds: DataFrame, q: int, least: float) -> DataFrame:
    """(group, text, size, grams, prefix): the grams of each text, rarest first, and those of its prefix."""
    each = texts.select("group", "text", "size", F.explode("grams").alias("kind")).join(kinds, "kind")
    ordered = each.groupBy("group", "text", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "kind"))), lambda x: x["kind"]).alias("grams"))
    other = F.ceil(F.col("size") * (least / (2 - least)) - 1e-9)  # the shortest that may be like it
    need = F.greatest(F.lit(1), F.ceil(least_shared(F.col("size"), other, least, q) - 1e-9))
    return ordered.withColumn("prefix", F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.size("grams") - need + 1).cast("int")))


def candidates(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(group, text, like) of distinct (group, text): pairs of different texts of a group whose lengths and shared grams allow the ratio."""
    c = F.col
    short = shortest(least)
    longest_of_short = short * (2 - least) / least
    size = F.length("text")
    out = []
    for q, here in ((1, size < longest_of_short if short < math.inf else F.lit(True)), (2, size >= short if short < math.inf else F.lit(False))):
        a, b = (x.where(here).select("group", "text", size.alias("size"), grams(c("text"), q).alias("grams")) for x in (rows, known))
        kinds = a.select(F.explode("grams").alias("kind")).unionByName(b.select(F.explode("grams").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))
        kinds = F.broadcast(kinds) if kinds.count() <= BROADCAST_GRAMS else kinds
        a, b = (_indexed(x, kinds, q, least) for x in (a, b))
        a = a.select("group", "text", "size", "grams", F.explode("prefix").alias("gram"))
        b = b.select(c("group").alias("k_group"), c("text").alias("like"), c("size").alias("k_size"), c("grams").alias("k_grams"), F.explode("prefix").alias("k_gram"))
        met = a.join(b, (c("group") == c("k_group")) & (c("gram") == c("k_gram")) & (c("text") != c("like")) & (2 * F.least("size", "k_size") >= least * (c("size") + c("k_size"))))
        # A pair is kept at the first gram that both prefixes hold.
        shared = F.array_intersect("grams", "k_grams")
        met = met.where(c("gram") == F.get(shared, F.lit(0))).where(F.size(shared) >= least_shared(c("size"), c("k_size"), least, q) - 1e-9)
        out.append(met.select("group", "text", "like"))
    return out[0].unionByName(out[1]).distinct()


def like_known(rows: DataFrame, known: DataFrame, group: str, text: str, least: float) -> DataFrame:
    """Distinct (group, text) of rows whose match ratio with any known text of their group is at least `least`; equal texts have 1."""
    a, b = (x.select(F.col(group).alias("group"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct() for x in (rows, known))
    same = a.join(b, ["group", "text"], "left_semi")
    met = candidates(a.join(same, ["group", "text"], "left_anti"), b, least)
    near = met.where(match_ratio(F.col("like"), F.col("text")) >= least).select("group", "text")
    return same.unionByName(near).distinct().select(F.col("group").alias(group), F.col("text").alias(text))
