"""Dataset governance: inventory numbers, digests, split leaks, samples, coverage of reviews."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder, so that all later reads see the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, by: str, order: list[str], size: Column) -> DataFrame:
    """Adds before: the sum of size over the rows of `by` before the row in an order without ties.

    Rows are dealt to ranges of (by, order), and each range starts behind the sums of the ranges before it: no task holds a whole
    hot group, and the one window by group is over a row a range.
    """
    ranges = cut(df.withColumn("_size", size).repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()))
    behind = F.sum("_n").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy(F.col(by).alias("_c"), F.col("_range").alias("_b")).agg(F.sum("_size").alias("_n")).select("_c", "_b", F.coalesce(behind, F.lit(0)).alias("_start"))
    within = F.sum("_size").over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranges.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, F.col(by).eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_b")))
    return placed.select(*df.columns, (F.col("_start") + F.col("_within")).alias("before"))


def number_cases(rows: DataFrame, category: str, order: str) -> DataFrame:
    """Adds case_id `<category>-<0001...>`, a running number within the category; numbers over 9999 take more digits. Order has no repeats within a category.

    Rows are numbered range by range, so no task sorts a whole category.
    """
    n = (F.col("before") + 1).cast("string")
    number = F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0"))
    return running(rows, category, [order], F.lit(1)).withColumn("case_id", F.concat(F.col(category), F.lit("-"), number)).select(*rows.columns, "case_id")


#: Bits of a key that a level of the digest takes up: a group holds at most so many digests, as long as keys do not repeat.
LEVEL_BITS = 12


def dataset_digest(rows: DataFrame, by: list[str], key: str, content: Column, levels: int = 3) -> DataFrame:
    """(by, rows, digest): a tree digest of the rows by their whole-number key, equal for equal contents in whatever order they are read.

    A leaf digests the rows' digests of 4,096 neighbouring keys in order of key, a node the digests of 4,096 neighbouring
    leaves, and the root all nodes of the last level, so no task gathers a whole source: the root of a million million
    rows joins 15 nodes.
    """
    hs = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n"), 256)
    level = rows.select(*by, F.col(key).cast("long").alias("k"), F.sha2(content, 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(levels):
        level = level.groupBy(*by, F.shiftright("k", LEVEL_BITS).alias("p")).agg(hs().alias("h"), F.sum("n").alias("n")).withColumnRenamed("p", "k")
    return level.groupBy(*by).agg(F.sum("n").alias("rows"), F.concat(F.lit("sha256:"), hs()).alias("digest"))


def split_leaks(rows: DataFrame, split: str, content: Column) -> DataFrame:
    """(digest, splits, rows): contents that occur in more than one split."""
    each = rows.select(F.col(split).alias("s"), F.sha2(content, 256).alias("digest"))
    return each.groupBy("digest").agg(F.countDistinct("s").alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def split_overlaps(rows: DataFrame, split: str, content: Column, lineage: Column) -> DataFrame:
    """(kind, key, splits, rows): contents and lineages that occur in more than one split. Rows without a lineage share none; hot keys are counted before the shuffle."""
    keys = F.array(F.struct(F.lit("content").alias("kind"), F.sha2(content, 256).alias("key")), F.struct(F.lit("lineage").alias("kind"), lineage.cast("string").alias("key")))
    each = rows.select(F.col(split).alias("s"), F.explode(keys).alias("k")).where("k.key IS NOT NULL").groupBy("k.kind", "k.key", "s").agg(F.count("*").alias("n"))
    return each.groupBy("kind", "key").agg(F.count("*").alias("splits"), F.sum("n").alias("rows")).where("splits > 1")


def stratified_sample(rows: DataFrame, stratum: Column, key: str, sizes: dict[str, int]) -> DataFrame:
    """So many rows of each stratum, in order of the keys' digests. The largest size bounds what each task hands on before the strata meet."""
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("_h", key))
    rows = rows.withColumns({"stratum": stratum, "_h": F.sha2(F.col(key).cast("string"), 256)}).withColumn("place", place)
    size = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("stratum")), F.lit(0))
    return rows.where(F.col("place") <= max(sizes.values(), default=0)).where(F.col("place") <= size).drop("_h")


def backfilled_sample(rows: DataFrame, preferred: Column, key: str, most: int, share: float = 0.85) -> DataFrame:
    """`most` rows: a share of preferred ones, then others, then more preferred ones if the others are too few, each in order of the keys' digests."""
    target = math.ceil(most * share)
    ranked = rows.withColumns({"_p": preferred, "_h": F.sha2(F.col(key).cast("string"), 256)})
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    ranked = ranked.withColumn("_place", place).where(F.col("_place") <= most)
    turn = F.when(F.col("_p") & (F.col("_place") <= target), 0).when(~F.col("_p"), 1).otherwise(2)
    return ranked.withColumn("_turn", turn).orderBy("_turn", "_place").limit(most).select(*rows.columns)


def carry_forward(draft: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Draft rows with the prior review's value and status where it has the same key; adds case_confirmed, whether all rows of a case are confirmed."""
    p = prior.select(*keys, F.col("value").alias("p_value"), F.col("status").alias("p_status"))
    rows = draft.join(p, keys, "left").select(*keys, F.coalesce("p_value", "value").alias("value"), F.coalesce("p_status", "status").alias("status"))
    return rows.withColumn("case_confirmed", F.bool_and(F.col("status") == "CONFIRMED").over(Window.partitionBy(keys[0])))


def coverage(rows: DataFrame, document: str) -> DataFrame:
    """(document, missing, decided, status), and with a null document the sums: NO_MISSING, CONFIRMED if all is decided, else PENDING."""
    out = rows.cube(document).agg(F.count_if("missing").alias("missing"), F.count_if(F.col("missing") & F.col("decided")).alias("decided"))
    return out.withColumn("status", F.when(F.col("missing") == 0, "NO_MISSING").when(F.col("decided") == F.col("missing"), "CONFIRMED").otherwise("PENDING"))


def typed_projection(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of normalisation status by data type and `by`, with all totals."""
    return rows.cube(*by, "data_type", "normalization_status").agg(F.count("*").alias("fields"))
