"""Vector code compression: product codes by integer k-means over columnar blocks, aggregated up a tree of tasks.

A block holds the integer components of some rows as one NumPy array [part, dimension, row], so that each dimension of a part lies
in one piece. A round sends the codebooks (parts x entries x width integers, whatever the number of rows) to the tasks; a
block adds up squared distances dimension by dimension, and np.add.at scatters its rows into sums and counts of the
entries, which RDD.treeAggregate merges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bound_batches, cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of blocks: 4 MB as 32-bit integers.
BLOCK_CELLS = 1 << 20
#: Components farther out are held here, so that distances and sums over ten billion rows fit 64 bits.
BOUND = 1 << 29
BROADCAST_LABELS = 100_000
#: Partitions of blocks that one level of the tree merges.
FAN = 32


def integers(vectors: DataFrame, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(id, label, terms array<int>): floor(scale * x) of each component, held within BOUND; vectors that are null or hold null or non-finite components are dropped."""
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))).cast("int")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(x.isNotNull()).where(~odd).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform(x, held).alias("terms"))


def blocks(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(n, ids, labels, data): blocks of bounded size; data is the array [part, dimension, row] of 32-bit integers, short vectors end in zeros."""
    bound_batches(rows.sparkSession)
    each = max(1, BLOCK_CELLS // max(1, parts * width))
    kind = rows.schema["label"].dataType.simpleString()

    def columnar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                terms = part.column(2)
                size = np.diff(terms.offsets.to_numpy())
                flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
                x = np.zeros((part.num_rows, parts * width), np.int32)
                x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
                data = np.ascontiguousarray(x.T).tobytes()
                one = lambda a, t: pa.array([a.to_pylist()], pa.list_(t))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), one(part.column(0), pa.int64()), one(part.column(1), part.column(1).type), pa.array([data], pa.binary())], names=["n", "ids", "labels", "data"])

    return rows.select("id", "label", "terms").mapInArrow(columnar, f"n int, ids array<long>, labels array<{kind}>, data binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of one part: x is [dimension, row], book [entry, dimension]; ties go to the smaller entry."""
    d = np.zeros((len(book), x.shape[1]), np.int64)
    for j in range(x.shape[0]):
        gap = x[j].astype(np.int64) - book[:, j, None]
        gap *= gap
        d += gap
    code = d.argmin(axis=0)
    return code, d[code, np.arange(x.shape[1])]


def gather(acc: tuple | None, block: np.ndarray, books: np.ndarray) -> tuple:
    """Adds a block's rows to the sums and counts of their entries."""
    parts, entries, width = books.shape
    sums, counts = acc or (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
    for p in range(parts):
        code, _ = nearest(block[p], books[p])
        np.add.at(counts[p], code, 1)
        for j in range(width):
            np.add.at(sums[p, :, j], code, block[p, j])
    return sums, counts


def merge(a: tuple | None, b: tuple | None) -> tuple | None:
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def train(dealt: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds of assigning all rows and replacing each used entry by the floor of its rows' mean."""
    parts, _, width = books.shape
    sc = dealt.sparkSession.sparkContext
    arrays = dealt.select("data").rdd.map(lambda r: np.frombuffer(r[0], np.int32).reshape(parts, width, -1) if width else np.zeros((parts, 0, 0), np.int32))
    depth = max(2, int(np.ceil(np.log(max(2, arrays.getNumPartitions())) / np.log(FAN))))
    for _ in range(rounds if width else 0):
        sent = sc.broadcast(books)
        total = arrays.treeAggregate(None, lambda acc, block, sent=sent: gather(acc, block, sent.value), merge, depth)
        sent.unpersist()
        if total:
            sums, counts = total
            books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def assign(dealt: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code array<int>, error) of each row under the codebooks."""
    parts, _, width = books.shape
    kind = dealt.schema["labels"].dataType.elementType.simpleString()
    sent = dealt.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(0)[i].as_py()
                block = np.frombuffer(batch.column(3)[i].as_py(), np.int32).reshape(parts, width, n)
                codes, error = np.zeros((n, parts), np.int32), np.zeros(n, np.int64)
                for p in range(parts):
                    codes[:, p], d = nearest(block[p], sent.value[p])
                    error += d
                lists = pa.ListArray.from_arrays(np.arange(0, n * parts + 1, parts, dtype=np.int32), codes.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, batch.column(2)[i].values, lists, pa.array(error)], names=["id", "label", "code", "error"])

    return dealt.mapInArrow(run, f"id long, label {kind}, code array<int>, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code array<int>, error) of all kept rows, and the final codebooks [part, entry, dimension].

    Entries begin as the rows of smallest ids; null ids come last, rows of one id in order of their components. Fewer rows
    than entries: as many entries as rows. Vectors are cut into equal parts of the longest one's length, rounded up;
    shorter ones end in zeros. Empty vectors have distance 0 to everything. No rows: an empty result and no entries.
    Rows of equal ids, labels or vectors all count. A label column of any type passes; without one all labels are null.
    """
    rows = integers(vectors, scale, column)
    longest = rows.agg(F.max(F.size("terms"))).first()[0] or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "terms").limit(entries).select("terms").collect()
    flat = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        flat[i, : len(r.terms)] = r.terms
    books = np.ascontiguousarray(flat.reshape(len(first), parts, width).transpose(1, 0, 2))
    dealt = cut(blocks(rows, parts, width))
    if len(first):
        books = train(dealt, books, rounds)
    return assign(dealt, books), books


def label_errors(coded: DataFrame, error: Column) -> DataFrame:
    """coded and label_error, the sum of the errors of its label; null labels are one. Hot labels are summed before the shuffle, and few labels come back by broadcast."""
    sums = cut(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(error).alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def books_digest(books: np.ndarray) -> Column:
    """SHA-256 of all final components as decimals, by part, entry and position."""
    return F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)


def op11(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = label_errors(cut(coded), F.col("error"))
    return out.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", books_digest(books).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, one step of names a round; rows of equal ids in order of their components, vectors of one length."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS a FROM v, (SELECT unnest(range({parts})) AS p))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v QUALIFY k < {entries})",
        "b0 AS MATERIALIZED (SELECT p, k, a AS b FROM x JOIN f USING (r))",
    ]
    pick = "SELECT r, p, any_value(a) AS a, min([d, k]) AS best FROM (SELECT r, p, k, a, list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{n} USING (p)) GROUP BY r, p"
    for n in range(1, rounds + 1):
        steps += [
            f"a{n} AS MATERIALIZED ({pick.format(n=n - 1)})",
            f"m{n} AS (SELECT p, k, list(m ORDER BY j) AS b FROM (SELECT p, best[2] AS k, j, floor(sum(a[j])::HUGEINT // count(*) - CASE WHEN sum(a[j]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m FROM a{n}, (SELECT unnest(range(1, (SELECT max(len(a)) FROM x) + 1)) AS j) GROUP BY p, best[2], j) GROUP BY p, k)",
            f"b{n} AS MATERIALIZED (SELECT b{n - 1}.p, b{n - 1}.k, coalesce(m{n}.b, b{n - 1}.b) AS b FROM b{n - 1} LEFT JOIN m{n} USING (p, k))",
        ]
    steps += [
        f"l AS ({pick.format(n=rounds)})",
        "c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM l GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, k)) AS digest FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN c USING (r), h"


OP11_SQL = _sql()
