"""Document fingerprints: MinHash signatures over word shingles, their bands joined in Spark, Jaccard verified.

op6 itself needs each document's fingerprint and that of its neighbour only; `near_pairs` is the join over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import SIMILARITY, MinHash, band_keys, bound_batches, map_arrow, partitions, shingles
from quirefold.llm.jaccard_join import jaccard_classes

PERMUTATIONS = 128
#: Bands of a fingerprint and their rows: a pair of similarity 0.8 shares one with a probability of 0.998.
BANDS, ROWS = 21, 6
#: Parts of the range of doc_id for each shuffle partition.
RANGES_EACH = 4


@lru_cache(maxsize=1)
def _minhash() -> MinHash:
    return MinHash(PERMUTATIONS)


def signature(text: str | None) -> np.ndarray:
    """The lowest 16 bits of each minimum; a text without words has a signature of its own, all 65535."""
    return (_minhash()(shingles(text)) & np.uint32(0xFFFF)).astype(">u2")


def fingerprint(text: str | None) -> str:
    return signature(text).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima: estimates the Jaccard similarity of the shingle sets, 1 for equal texts."""
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; null texts count as empty. No shuffle."""
    return map_arrow(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "fingerprint": [fingerprint(t) for t in c["text"]]}, "doc_id long, fingerprint string")


def edited(text: str | None, following: str | None) -> str:
    """The last half of the code points gives way to the first as many (or all) of the following text."""
    text, following = text or "", following or ""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    """fn(doc_ids, texts, next_texts) over all rows, each with the text of the next row by (doc_id, text), after the last the first.

    The range of doc_id is cut into parts at real ids; a row whose id starts a part also goes, as a look-ahead, to the
    part before, so each task sees every next text and no window runs over the whole table. Null doc_id come first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark) * RANGES_EACH
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 10 * n).alias("q"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = sorted({bounds.least, *(bounds.q or ())} - {None})
    cuts = ([None] if bounds.nulls else []) + cuts
    if not cuts:
        cuts = [None]
    real = [c for c in cuts if c is not None]
    offset = len(cuts) - len(real)
    place, first = F.lit(0), F.lit(True)
    if real:
        # Cuts ascend: the number of rows' first cuts up to the id names a row of cuts, and their number in that row the cut.
        # So a row is compared with about twice the root of the number of cuts.
        wide = int(len(real) ** 0.5) + 1
        listed = lambda xs: f"array({', '.join(xs)})"
        rows = F.expr(listed(listed(f"{c}L" if c > -(1 << 63) else "bigint(-9223372036854775808)" for c in real[i : i + wide]) for i in range(0, len(real), wide)))
        up_to = lambda xs, key: F.size(F.filter(xs, lambda c: key(c) <= F.col("doc_id")))
        row = up_to(rows, lambda c: c[0]) - 1
        at = lambda r: F.get(rows, r)
        found = once(row, lambda r: once(up_to(at(r), lambda c: c) - 1, lambda i: F.struct((r * wide + i + offset).alias("part"), (F.get(at(r), i) == F.col("doc_id")).alias("first"))))
        place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("_found.part"))
        first = F.col("doc_id").isNull() | F.col("_found.first")
        ids = ids.withColumn("_found", found)
    own = F.struct(place.alias("part"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.when(place == 0, F.lit(len(cuts) - 1)).otherwise(place - 1).alias("part"), F.lit(1).alias("ahead"))
    dealt = ids.select("doc_id", "text", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("at.part", "at.ahead", "doc_id", "text").repartition(partitions(spark), "part")
    dealt = dealt.sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[0] == row[0]:
                    rows.append((held[2], held[3], row[3]))
                if row[1] == 0:
                    held = row
                else:
                    held = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(fn(*map(list, zip(*rows, strict=True))), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, ddl)


def fingerprint_bands(grams: np.ndarray) -> np.ndarray:
    """Band hashes of a fingerprint's own values."""
    return band_keys((_minhash()(grams) & np.uint32(0xFFFF)).astype(np.uint32), BANDS, ROWS)


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each document: the bands of the fingerprints are joined in Spark, and what
    meets is verified by the Jaccard similarity of full shingle sets."""
    return jaccard_classes(docs, similarity, bands_of=fingerprint_bands)


def once(x, fn):
    """fn(x) with x computed once."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def _digest(doc_ids: list, texts: list, following: list) -> list[list]:
    out: list[list] = [[] for _ in range(7)]
    known: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in known:
            if len(known) > 4:
                known.clear()
            known[text] = signature(text)
        return known[text]

    for doc_id, text, nxt in zip(doc_ids, texts, following, strict=True):
        text, nxt = text or "", nxt or ""
        new = edited(text, nxt)
        a, b, c = of(text), signature(new), of(nxt)
        row = (doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, c))
        for col, value in zip(out, row, strict=True):
            col.append(value)
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_next(docs, _digest, SCHEMA, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
