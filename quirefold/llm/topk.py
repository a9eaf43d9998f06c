"""Exact top-k search: term-at-a-time accumulation of integer inner products over candidates that stay where they are, then a merge.

Queries, a stated small share of the rows, go out in blocks of bounded size; a block is at every task once, and each task scatters
its candidates' weighted postings into dense score rows, keeps the k best of each query over all of its candidates, and one
ranking merges the tasks. So a candidate is shuffled never, and each query's k rows once a task, however many blocks there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import bound_batches, cut, partitions

#: Candidates that a task scores at once, and queries of a block.
CANDIDATE_ROWS = 1 << 14
QUERY_ROWS = 1 << 15
#: Cells of the dense scores that a task holds at once.
CELLS = 1 << 21


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, terms array<long>): floor(scale * x) of each component; vectors that are null or hold a null or a non-finite component take no part.

    Every other row counts, also rows that share a vec_id or have none.
    """
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(x.isNotNull()).where(~odd)
    terms = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores [query, candidate]. For each term the candidates' postings of weight other than 0 are scattered, times the queries' weights, into the rows of the queries that have the term."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for t in range(min(queries.shape[1], candidates.shape[1])):
        rows, posts = np.flatnonzero(queries[:, t]), np.flatnonzero(candidates[:, t])
        if len(rows) == len(queries) and len(posts) == len(candidates):
            scores += queries[:, t, None] * candidates[None, :, t]
        elif len(rows) and len(posts):
            scores[np.ix_(rows, posts)] += queries[rows, t, None] * candidates[None, posts, t]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids (none last): partition selection, then a sort of what is left."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def matrix(terms: Iterable) -> np.ndarray:
    rows = [np.asarray(x, np.int64) for x in terms]
    out = np.zeros((len(rows), max((len(x) for x in rows), default=0)), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("none", pa.bool_()), ("at", pa.int64()), ("score", pa.int64())])


def _search(sent, k: int, most: int):
    """The k best candidates of a task's rows (id, none, row, terms) for each query of the block that was sent: (rows, ids, terms)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, names, queries = sent.value
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        held: list[tuple] = [nothing] * len(asking)  # scores, ids, whether without one, rows

        def score(table: pa.Table) -> None:
            # In this order a smaller place is a smaller id, none last, so places break ties; rows of one id stand apart by number.
            ids, none, rows = (table.column(x).to_numpy() for x in ("id", "none", "row"))
            order = np.lexsort((rows, ids, none))
            ids, none, rows = ids[order], none[order], rows[order]
            c, places = matrix(table.column("terms").take(pa.array(order)).to_pylist()), np.arange(len(order))
            place = {row: i for i, row in enumerate(rows.tolist())}
            step = max(1, CELLS // len(rows))
            for i in range(0, len(asking), step):
                for n, scores in enumerate(accumulate(queries[i : i + step], c), i):
                    # One more than wanted, as the query's own row may be among them.
                    own = place.get(int(asking[n]), -1)
                    at = best(scores, places, k + (own >= 0))
                    at = at[at != own][:k]
                    both = [np.concatenate(x) for x in zip(held[n], (scores[at], ids[at], none[at], rows[at]), strict=True)]
                    top = np.lexsort((both[3], both[1], both[2], -both[0]))[:k]
                    held[n] = tuple(x[top] for x in both)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= most:
                score(pa.Table.from_batches(waiting))
                waiting = []
        if sum(b.num_rows for b in waiting):
            score(pa.Table.from_batches(waiting))
        sizes = [len(h[0]) for h in held]
        scores, ids, none, rows = (np.concatenate([h[i] for h in held]) if held else x for i, x in enumerate(nothing))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.repeat(asking, sizes), np.repeat(names, sizes), ids, none, rows, scores), FOUND, strict=True)], schema=FOUND)

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 10, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates of highest inner product for each query row of (vec_id, terms).

    Rows are numbered once and stay in their partitions; where these are fewer than the session's, they are dealt out once. A query
    row is no candidate of its own; other rows of its id are. Fewer than k candidates: all. No queries or no rows: an empty
    result. The driver holds one block of queries at a time.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    if vectors.rdd.getNumPartitions() < partitions(spark):
        vectors = vectors.repartition(partitions(spark))
    # Ids without nulls, which would turn into floating numbers.
    v = cut(vectors.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("none"), "terms", F.monotonically_increasing_id().alias("row"), F.coalesce(F.expr(is_query) & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks")))
    asking = v.where("asks").select("row", "id", "terms")
    blocks = max(1, math.ceil(asking.count() / query_rows))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at"))
    out = None
    for b in range(blocks):
        rows = asking.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast((rows.column("row").to_numpy(), rows.column("id").to_numpy(), matrix(rows.column("terms").to_pylist())))
        found = v.select("id", "none", "row", "terms").mapInArrow(_search(sent, k, candidate_rows), "row long, query_id long, id long, none boolean, at long, score long")
        found = found.withColumn("vec_id", F.when(~F.col("none"), F.col("id")))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            found = cut(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    return top_k(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id % 100 = 0", 10)


OP10_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""
