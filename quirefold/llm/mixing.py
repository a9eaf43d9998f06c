"""Mixing sources to target weights: repetition rates from token totals, whole copies plus one seeded Bernoulli copy.

The draw of a Bernoulli copy hashes the doc_id. Rows whose doc_id is null or stands more than once draw by their content too, and
k equal rows of fraction f, which no hash tells apart, take floor(k * f) copies and one draw for what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import cut, on_disk, partitions, running_sums

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Seeds tried for the Bernoulli copies of each source; the one whose total comes closest to the target is used.
SEEDS = 64
BROADCAST_SOURCES = 10_000
BROADCAST_IDS = 100_000
#: Rows or copies of equal rows that are made at once.
EACH = 10_000


def text_size(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, mark: Column, seed: Column) -> Column:
    """A number from 0 to 1 that depends on the id, the mark of the content where there is one, and the seed alone."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), mark, seed.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def told_apart(docs: DataFrame, mark: Column) -> tuple[DataFrame, bool]:
    """docs and a column mark: null where the doc_id is filled and stands once, else the mark of the content; and whether any row has one.

    This first reads doc_id alone. Few such ids are broadcast.
    """
    odd = docs.groupBy(F.col("doc_id").alias("o_id")).agg(F.count("*").alias("n")).where("n > 1 OR o_id IS NULL").select("o_id", F.lit(True).alias("clash"))
    odd = cut(odd)
    n = odd.count()
    if not n:
        return docs.withColumn("mark", F.lit(None).cast("string")), False
    odd = F.broadcast(odd) if n <= BROADCAST_IDS else odd
    joined = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("o_id")), "left")
    return joined.withColumn("mark", F.when(F.col("clash"), F.coalesce(mark, F.lit("")))).drop("o_id", "clash"), True


def equal_rows(docs: DataFrame, some: bool, *firsts: str) -> DataFrame:
    """One row for each (source, doc_id, size, mark) with the number of equal rows, and the first of other columns; rows without a mark are one each and are not shuffled."""
    clear = docs.where("mark IS NULL").withColumn("rows", F.lit(1).cast("long")).select("source", "doc_id", "size", "mark", *firsts, "rows")
    if not some:
        return clear
    alike = docs.where("mark IS NOT NULL").groupBy("source", "doc_id", "size", "mark").agg(*(F.first(c).alias(c) for c in firsts), F.count("*").alias("rows"))
    return clear.unionByName(alike)


def source_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight) -> also target and rate.

    target = min(max_repeats * source_size, level * weight) with the one level at which the targets share the total,
    which is where resharing the excess by weight ends. Sources in ascending order of cap / weight fill up first, so the
    level comes from running sums over one row a source, range by range: no task holds all sources.
    """
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    s = running_sums(sources.withColumn("cap", F.lit(max_repeats) * F.col("source_size")), order, {"before": F.col("cap"), "passed": F.col("weight")})
    s = s.crossJoin(F.broadcast(s.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))))  # one row
    # The level if this source is the first that is not filled; the first that fits holds for all.
    s = s.withColumn("level", (F.col("total") - F.col("before")) / (F.col("all_weight") - F.col("passed")))
    place = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), "source")
    level = s.agg(F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), place)).alias("level"))
    s = s.drop("level").crossJoin(F.broadcast(level))  # one row
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "weight", "target", rate.alias("rate"))


def mix_plan(docs: DataFrame, weights: DataFrame | None = None, max_repeats: int = MAX_REPEATS, seeds: int = SEEDS) -> DataFrame:
    """(p_source, source_size, target, rate, seed), one row a source, from (source, doc_id, size, mark, rows) rows.

    weights (source, weight): missing means 1, 2, 3 repeating over the sources by code point, null last. Of the seeds
    tried, a source uses the one whose total is nearest to its target (the smallest of equals). Hot sources are summed
    before any shuffle.
    """
    sums = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"))
    if weights is None:
        place = running_sums(sums, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
        sums = place.withColumn("weight", (F.col("place") % 3 + 1).cast("long")).drop("place")
    else:
        w = weights.select(F.col("source").alias("w_source"), "weight")
        sums = sums.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    plan = cut(source_targets(sums, max_repeats).withColumnRenamed("source", "p_source"))
    joined = with_plan(docs.select("doc_id", "source", "size", "mark", "rows"), plan)
    took = lambda seed: F.col("size") * (F.col("rows") * F.floor("rate") + more(F.lit(seed)))
    totals = joined.groupBy("p_source").agg(F.first("target").alias("goal"), *(F.sum(took(k)).alias(f"t{k}") for k in range(seeds)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("goal")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds))))["seed"]
    chosen = totals.select(F.col("p_source").alias("c_source"), best.alias("seed"))
    return cut(plan.join(chosen, F.col("p_source").eqNullSafe(F.col("c_source"))).drop("c_source"))


def with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins each row's source with its plan; the plan is broadcast if it has few sources, else joined by shuffle."""
    small = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return docs.join(small, F.col("source").eqNullSafe(F.col("p_source")))


def more(seed: Column) -> Column:
    """How many of the equal rows get a copy beyond floor(rate): the whole ones, and one for what is left if its draw says so."""
    share = F.col("rows") * (F.col("rate") - F.floor("rate"))
    return (F.floor(share) + F.when(draw(F.col("doc_id"), F.col("mark"), seed) < share - F.floor(share), 1).otherwise(0)).cast("long")


def repeated(rows: DataFrame, times: str, as_name: str) -> DataFrame:
    """Each row as often as times says, numbered from 0; many copies of one row are dealt to all tasks."""
    few, many = rows.where(F.col(times) <= EACH), rows.where(F.col(times) > EACH)
    one = lambda df, a, b: df.withColumn(as_name, F.explode(F.sequence(a, b)))
    zero, last = F.lit(0).cast("long"), F.col(times) - 1
    blocks = one(many, zero, F.floor(last / EACH)).withColumn("_from", F.col(as_name) * EACH).drop(as_name).repartition(partitions(rows.sparkSession))
    blocks = one(blocks, F.col("_from"), F.least(F.col("_from") + EACH - 1, last)).drop("_from")
    return one(few.where(F.col(times) > 0), zero, last).unionByName(blocks)


def mix_sizes(docs: DataFrame, weights: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds source_size, weight, target, rate, seed and copies to each of (doc_id, source, size) rows, or of such rows with a mark of their content.

    Null sources are one source. Rows of a doc_id that is null or stands more than once draw by their mark too; of equal ones
    so many take one copy more that their share is met. Sources of size 0 have rate 0; an empty table gives an empty table.
    """
    mark = F.col("content") if "content" in docs.columns else F.lit("")
    slim, some = told_apart(docs, mark)
    slim = on_disk(equal_rows(slim, some))
    plan = mix_plan(slim, weights, max_repeats)
    out = with_plan(slim, plan).drop("p_source").withColumn("more", more(F.col("seed")))
    single = out.where("rows = 1").withColumn("copies", F.floor("rate") + F.col("more"))
    if some:
        several = repeated(out.where("rows > 1"), "rows", "at").withColumn("copies", F.floor("rate") + F.when(F.col("at") < F.col("more"), 1).otherwise(0)).drop("at")
        single = single.unionByName(several)
    return single.withColumn("copies", F.col("copies").cast("int")).drop("mark", "rows", "more")


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed documents themselves, each row as often as it is taken, with the columns of docs.

    Null texts have size 0; null sources are one source; an empty table gives an empty one. Rows of a doc_id that is null or stands
    more than once draw by all of their columns; rows equal in all columns are taken as often as their share asks. Columns of any name
    pass, as rows travel as one struct; very long texts are moved only where their doc_id is not unique.
    """
    whole = F.struct(*(F.col(c) for c in docs.columns))
    kept, some = told_apart(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), whole.alias("row")), F.sha2(F.to_json("row"), 256))
    rows = equal_rows(kept, some, "row")
    slim = on_disk(equal_rows(kept.drop("row"), some))
    plan = mix_plan(slim, weights, max_repeats).select("p_source", "rate", "seed")
    slim.unpersist()
    taken = with_plan(rows, plan).withColumn("copies", F.col("rows") * F.floor("rate") + more(F.col("seed")))
    if some:
        return repeated(taken.select("row", "copies"), "copies", "at").select("row.*")
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_sizes(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.md5("text").alias("content")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _more_sql(seed: str) -> str:
    drawn = f"('0x' || substr(md5(key || ':' || {seed}), 1, 12))::BIGINT / 281474976710656.0"
    return f"(floor(k * (rate - floor(rate))) + CASE WHEN {drawn} < k * (rate - floor(rate)) - floor(k * (rate - floor(rate))) THEN 1 ELSE 0 END)"


_SEED_SUMS = ", ".join(f"sum(size * (k * floor(rate) + {_more_sql(k)})) AS t{k}" for k in range(SEEDS))
_SEED_LIST = ", ".join(f"{{'off': abs(t{k} - goal), 'seed': {k}}}" for k in range(SEEDS))
OP7_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN doc_id IS NULL OR count(*) OVER (PARTITION BY doc_id) > 1 THEN ':' || coalesce(md5(text), '') ELSE '' END AS key FROM documents),
d AS (SELECT *, count(*) OVER (PARTITION BY source, doc_id, key) AS k, row_number() OVER (PARTITION BY source, doc_id, key) - 1 AS nth FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER o, 0) AS before,
        sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, total::DOUBLE / 1 AS t, (total - before)::DOUBLE / left_weight::DOUBLE AS level FROM f),
b AS (SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM l),
p AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, lv * weight), 0.0) AS target FROM b),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END AS rate FROM p),
j AS (SELECT d.doc_id, d.size, d.key, d.k, d.nth, r.* FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT source, first(target) AS goal, {_SEED_SUMS} FROM j WHERE nth = 0 GROUP BY source),
c AS (SELECT source, list_min([{_SEED_LIST}]).seed AS seed FROM g)
SELECT j.doc_id, j.size, j.source_size, j.target::DOUBLE AS target,
  (j.size * (floor(rate) + CASE WHEN nth < {_more_sql("c.seed")} THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j JOIN c ON j.source IS NOT DISTINCT FROM c.source
"""
