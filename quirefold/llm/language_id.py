"""Language identification: TF-IDF n-gram vectors against several clustered centroids a language, nearest by cosine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bound_batches, map_arrow

BUCKETS = 1 << 12
#: The centroids are fitted on about so many documents in all, dealt evenly over the languages.
SAMPLE = 4000
CLUSTERS = 4
ROUNDS = 12
TEMPERATURE = 0.04
#: A text is rejected if its cosine with the nearest centroid is below this quantile of the centroid's own documents.
REJECT = 0.005
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Bucketed counts of the letter n-grams, n = 2 and 3, of the whole text, white space and all other signs as one gap; None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out = np.bincount(((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift, minlength=BUCKETS)
    out += np.bincount(((three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39)) >> shift, minlength=BUCKETS)
    return out


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of length 1: damped counts times idf."""
    v = np.log1p(tf.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    langs: tuple[str, ...]
    of: np.ndarray
    centres: np.ndarray
    least: np.ndarray

    def nearest(self, tf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine and whether it is rejected, of each row of counts."""
        cos = unit(tf, self.idf) @ self.centres.T
        best = cos.argmax(axis=1)
        by = np.stack([cos[:, self.of == i].max(axis=1) for i in range(len(self.langs))], axis=1)
        e = np.exp((by - by.max(axis=1, keepdims=True)) / TEMPERATURE)
        near = cos[np.arange(len(cos)), best]
        return [self.langs[self.of[i]] for i in best], (1 / e.sum(axis=1)).clip(0, 1), near.clip(0, 1), near < self.least[best]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents of each n-gram bucket, and of documents with letters, over all rows; summed in Spark."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (tf := counts(text)) is not None:
                    total[:-1] += tf > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts: (assignment)."""
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.max(x @ np.stack(centres).T, axis=1).argmin()])
    c = np.stack(centres)
    at = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        at = (x @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T).argmax(axis=1)
        c = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
    return at


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids | None:
    """Learns from (text, lang) rows; rows without a language or letters teach nothing. None if nothing can be learned.

    Document frequencies cover all rows; the centroids are fitted on about `sample` rows, chosen by a hash of the text.
    """
    train = train.where("lang IS NOT NULL").select("text", "lang")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, each / n))))
    chosen = train.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(float(1 << 20)))

    def run(c: dict[str, list]) -> dict[str, list]:
        tf = [counts(t) for t in c["text"]]
        keep = [i for i, x in enumerate(tf) if x is not None]
        return {"lang": [c["lang"][i] for i in keep], "mark": [c["mark"][i] for i in keep], "tf": [tf[i].astype(np.float32).tobytes() for i in keep]}

    df, n = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # The bound bites only where many rows share a text; the smallest hashes are taken, so that a rerun learns the same.
    rows = map_arrow(chosen.withColumn("mark", F.xxhash64("text", "lang")), run, "lang string, mark long, tf binary").orderBy("mark", "lang", "tf").limit(2 * max(sample, len(sizes))).collect()
    langs, of, centres, least = sorted({r.lang for r in rows}), [], [], []
    for i, lang in enumerate(langs):
        x = unit(np.stack([np.frombuffer(r.tf, np.float32) for r in rows if r.lang == lang]), idf)
        at = cluster(x, clusters)
        for j in np.unique(at):
            c = x[at == j].mean(axis=0)
            c /= max(float(np.linalg.norm(c)), 1e-12)
            of.append(i)
            centres.append(c)
            least.append(np.quantile(x[at == j] @ c, REJECT))
    if not langs:
        return None
    return Centroids(idf, tuple(langs), np.array(of), np.stack(centres).astype(np.float32), np.array(least, np.float32))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """(doc_id, lang_pred, score, cosine, rejected) of each row, from its whole text alone.

    `und` with score 0 for null and blank texts, texts without a letter, and without a model. A rejected text keeps the
    nearest language beside rejected = true: it lies farther out than nearly all documents of its nearest centroid. Equal
    cosines go to the language first by name, repeated rows get the same result, a very long text is counted once over its
    whole length, an empty table gives an empty one, and other columns play no part.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        n = len(c["text"])
        out = {"doc_id": c["doc_id"], "lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "cosine": [0.0] * n, "rejected": [True] * n}
        for a in range(0, n, 256):
            tf = {i: x for i in range(a, min(n, a + 256)) if (x := counts(c["text"][i])) is not None} if model else {}
            if tf:
                for i, *found in zip(tf, *model.nearest(np.stack(list(tf.values()))), strict=True):
                    out["lang_pred"][i], out["score"][i], out["cosine"][i], out["rejected"][i] = found[0], float(found[1]), float(found[2]), bool(found[3])
        return out

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = identify(docs, fit(learn))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
