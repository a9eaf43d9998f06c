"""Helpers the training-data operators share: batches, word hashes, shingles, components."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH_BYTES = 32 << 20
MEMO_WORDS = 1 << 17
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def bound_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes as well as rows, so that very long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only where none is named and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that later jobs neither redo nor lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(key, doc_id, text) of all rows, the same of all documents, and whether key is doc_id: key orders the documents. It is doc_id itself unless that is null or repeated somewhere.

    Then rows of equal doc_id and text are one document, and different texts of a doc_id are documents in order of text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():  # reads doc_id alone
        keyed = ids.where("doc_id IS NOT NULL").withColumn("key", F.col("doc_id"))
        return keyed, keyed, True
    # Only the ids that clash bring their texts into the order; all others are ordered by their ids alone.
    mark = F.coalesce(F.sha2("text", 256), F.lit(""))
    clash = odd.select(F.col("doc_id").alias("o_id"), F.lit(True).alias("clash"))
    marked = ids.withColumn("mark", mark).join(clash, F.col("doc_id").eqNullSafe(F.col("o_id")), "left").drop("o_id")
    order = marked.groupBy("doc_id", "mark").agg(F.min(F.when(F.col("clash"), F.col("text"))).alias("text")).orderBy(F.col("doc_id").asc_nulls_first(), "text", "mark")
    keys = cut(order.select("doc_id", "mark", F.monotonically_increasing_id().alias("key"))).withColumnRenamed("doc_id", "k_id").withColumnRenamed("mark", "m")
    keyed = marked.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("m") == F.col("mark"))).select("key", "doc_id", "text")
    return keyed, keyed.dropDuplicates(["key"]), False


def on_disk(df: DataFrame) -> DataFrame:
    """Keeps df on the executors' disks until unpersist(); what a lost executor held is computed again from df's own plan."""
    return df.persist(StorageLevel.DISK_ONLY)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over columns as Python lists; fn maps one batch's columns to the output columns, done runs after a partition's last one."""
    bound_batches(df.sparkSession)
    names, kinds = zip(*((x.split()[0], x.split()[1]) for x in schema.split(", ")), strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow[k]) for n, k in zip(names, kinds, strict=True)], names=list(names))
        if done:
            done()
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Frees remembered hashes and hands memory back at a partition's end: Python workers live on, and what they hold adds up over stages."""
    WORDS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordHash(dict):
    """Word to 64-bit hash; remembers a bounded number of words, until a partition's end frees them."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h
        return h


WORDS = WordHash()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of n white-space separated words.

    A text of fewer than n words has one shingle, all of its words; null or blank texts have none.
    """
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    out = np.full(m, len(h) if len(h) < n else n, np.uint64)
    for k in range(min(n, len(h))):
        out += h[k : k + m] * _MIX[k % len(_MIX)] ^ _MIX[-1 - k % len(_MIX)]
    return np.unique(_scramble(out))


def set_key(hashes: np.ndarray) -> bytes:
    """128-bit key of a shingle set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class MinHash:
    """Signatures under k universal hash permutations x -> a*x + b (mod 2**32, a odd) of folded shingle hashes."""

    WIDE = 4096

    def __init__(self, k: int, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.k = k
        self.a = (rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32) ^ (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        for i in range(0, len(x), self.WIDE):
            np.minimum(out, (self.a * x[i : i + self.WIDE] + self.b).min(axis=1), out=out)
        return out


def banding(similarity: float, recall: float, rows: int) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows by which a pair of that similarity meets with at least that probability."""
    if not (0 < similarity < 1 and 0 < recall < 1 and rows > 0):
        raise ValueError("similarity and recall lie between 0 and 1, rows are positive")
    return int(np.ceil(np.log(1 - recall) / np.log1p(-(similarity**rows)))), rows


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band, which holds the band's number too."""
    s = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0]
    for k in range(rows):
        out = _scramble((out ^ s[:, k]) * _MIX[1 + k % 7])
    return out.view(np.int64)


#: Rows for each partition of a table of links that a round writes; and the rows of a round's map that are broadcast.
LINKS_EACH = 20_000
BROADCAST_LINKS = 100_000


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows before the row in an order without ties.

    Rows are dealt to ranges of the order, each range starts behind the sums of the ranges before it, and the one window
    over all holds a row a range: no task sees the whole table. The result is cut, so that all later reads agree.
    """
    dealt = cut(df.select("*", *(c.alias(f"_{n}") for n, c in sums.items())).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("_range").alias("_r")).agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    starts = starts.select("_r", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in sums})
    placed = placed.join(F.broadcast(starts), F.col("_range") == F.col("_r"))  # a row a partition
    return placed.select(*df.columns, *((F.col(f"_start_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it is known to have few rows."""
    return F.broadcast(df) if rows <= BROADCAST_LINKS else df


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """(node, root) of every node of the undirected edges; nodes must be random keys such as hashes.

    Contraction: each node hands its edges to its smallest neighbour, so edges shrink by a factor each round; the
    rounds' maps are then followed back. All state stays in distributed tables cut in the checkpoint folder, in as many
    partitions as their rows call for. most: a bound of the number of nodes, if one is known.
    """
    # A round's map goes to every task while it is small, so that a hub's many links need not meet; beyond, AQE splits such a join.
    few = lambda df, n: df.coalesce(max(1, min(partitions(df.sparkSession), -(-n // LINKS_EACH))))
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = cut(few(e, most) if most else e)
    maps: list[tuple[DataFrame, int]] = []
    while n := e.count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        up = cut(few(up, n))
        maps.append((up, n))
        e = (
            e.join(small(up, n), e.a == up.node).select(F.col("root").alias("a"), "b")
            .join(small(up.select(F.col("node").alias("n2"), F.col("root").alias("r2")), n), F.col("b") == F.col("n2"))
            .select("a", F.col("r2").alias("b")).where("a <> b").distinct()
        )
        e = cut(few(e, n))
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0][0]
    for up, n in maps[1:]:
        nxt = small(up.select(F.col("node").alias("n2"), F.col("root").alias("r2")), n)
        out = out.join(nxt, out.root == nxt.n2, "left").select("node", F.coalesce("r2", "root").alias("root"))
    return out
