"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets verify them; one row a document comes out.

Documents of equal n-gram sets are one node from the start, so copies are never expanded. The bands' buckets link each node
to the bucket's smallest one; the components of these unverified links hold every candidate pair. A component's nodes are
dealt to blocks of bounded number and bytes, and each pair of blocks that a bucket has in common is one unit of work: it gets both
blocks' n-gram sets, verifies the pairs that share a band, and hands back a count for each node and a spanning forest, never the
pairs. So a large component that unlike texts chain together costs what its buckets cost, not all pairs of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import SHINGLE_WORDS, SIMILARITY, MinHash, band_keys, banding, bound_batches, components, cut, keyed_rows, map_arrow, on_disk, partitions, set_key, shingles, small

RECALL = 0.999
#: Rows of a band: so many that pairs well below the similarity seldom meet; the number of bands follows from the recall.
ROWS = 8
#: Nodes and bytes of n-gram sets of a block.
BLOCK, BLOCK_BYTES = 192, 16 << 20
#: Rows of the result for each partition.
ROWS_EACH = 50_000


@lru_cache(maxsize=8)
def _minhash(k: int) -> MinHash:
    return MinHash(k)


#: Odd, so that multiplying keys by it (mod 2 ** 64) keeps them apart and puts them in an order that has nothing to do with theirs.
ODD = 0x9E3779B97F4A7C15


Bands = Callable[[np.ndarray], np.ndarray]


def standard_bands(similarity: float = SIMILARITY, recall: float = RECALL) -> Bands:
    """Band hashes of an n-gram set, in so many bands that a pair of that similarity meets with that probability."""
    bands, rows = banding(similarity, recall, ROWS)
    return lambda grams: band_keys(_minhash(bands * rows)(grams), bands, rows)


def sketch(keyed: DataFrame, bands_of: Bands, n: int = SHINGLE_WORDS) -> DataFrame:
    """(key, node, doc_id, set, size, bands) of (key, doc_id, text) rows: node is the key in scattered order, set the key of the n-gram
    set, size its bytes, bands its band hashes; set and bands are null for a text without words."""

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": c["key"], "doc_id": c["doc_id"], "set": [], "size": [], "bands": []}
        out["node"] = [(k * ODD + (1 << 63)) % (1 << 64) - (1 << 63) for k in c["key"]]
        for text in c["text"]:
            grams = shingles(text, n)
            out["set"].append(set_key(grams) if len(grams) else None)
            out["size"].append(grams.nbytes)
            out["bands"].append(bands_of(grams) if len(grams) else None)
        return out

    return map_arrow(keyed.select("key", "doc_id", "text"), run, "key long, node long, doc_id long, set binary, size long, bands array<long>")


def _links(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, weight: np.ndarray, similarity: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weighted number of verified links of each node of a unit, and the smallest place that each is connected with."""
    n = len(sets)
    may = np.zeros((n, n), bool)
    for b in range(bands.shape[1]):
        may |= bands[:, b, None] == bands[None, :, b]
    may &= np.triu(np.ones((n, n), bool), 1)
    if cross:
        may &= side[:, None] != side[None, :]
    size = np.array([len(s) for s in sets])
    least, most = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    may &= least >= similarity * most - 1e-9
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    count, root = np.zeros(n, np.int64), np.arange(n)
    mark = np.zeros(len(grams), np.int64)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(may.any(axis=1)):
        js = np.flatnonzero(may[i])
        mark[place[ends[i] : ends[i + 1]]] = 1
        at = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in js])
        both = np.add.reduceat(mark[place[at]], np.concatenate([[0], np.cumsum(size[js])[:-1]]))
        mark[place[ends[i] : ends[i + 1]]] = 0
        for j in js[both >= similarity * (size[i] + size[js] - both) - 1e-9]:
            count[i] += weight[j]
            count[j] += weight[i]
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return count, np.array([top(i) for i in range(n)])


def _verify(similarity: float):
    def unit(rows: list[tuple]) -> tuple[list, list, list]:
        rows = list({r[3]: r for r in rows}.values())
        if len(rows) < 2:
            return [], [], []
        nodes = [r[3] for r in rows]
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        count, root = _links(sets, np.array([r[4] for r in rows]), np.array([r[6] for r in rows]), np.array([r[7] for r in rows]), similarity, rows[0][1] != rows[0][2])
        keep = [i for i in range(len(rows)) if count[i]]
        return [nodes[i] for i in keep], [nodes[root[i]] for i in keep], [int(count[i]) for i in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            a, b, n = unit(rows)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if row[:3] != key:
                    yield from out(held)
                    held, key = [], row[:3]
                held.append(row)
        yield from out(held)

    return run


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = SHINGLE_WORDS, bands_of: Bands | None = None) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row for each input row.

    class_id is the smallest doc_id among the documents that links connect; n_links counts the other rows whose n-gram sets
    have at least that similarity to the row's (n_copies of them have the very same set). Texts of fewer than n words are
    one n-gram; null and blank texts are classes of their own without links; repeated rows count as copies of each other; an
    empty table gives an empty one, and other columns play no part. bands_of: other bands of an n-gram set than the standard.
    """
    bound_batches(docs.sparkSession)
    bands_of = bands_of or standard_bands(similarity, recall)
    keyed, _, _ = keyed_rows(docs)
    sk = on_disk(sketch(keyed, bands_of, n))
    rows = sk.count()
    some = sk.where("set IS NOT NULL")
    sets = some.groupBy("set").agg(F.min("node").alias("first"), F.min_by("key", "node").alias("rep_key"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"))
    # Only one row of each set goes on; that join is by node, so copies do not meet in a task.
    banded = some.select("node", "bands").join(sets.select(F.col("first").alias("node")), "node", "left_semi").select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("band", "hub")
    edges = banded.join(buckets, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    comp = cut(components(edges, most=rows))
    members = cut(comp.join(sets.select(F.col("first").alias("node"), "rep_key", "copies", "size"), "node"))
    nodes = members.count()
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("long")
    sizes = small(members.groupBy("root").agg(blocks.alias("blocks")), nodes)
    members = members.join(sizes, "root").withColumn("block", F.pmod(F.shiftright("node", 7), F.col("blocks"))).select("node", "root", "block", "blocks", "copies", "rep_key")
    several = cut(members.where("blocks > 1").select("node", "root", "block"))
    members = members.drop("blocks")
    if several.isEmpty():
        members = members.withColumn("others", F.array(F.lit(0).cast("long")))
    else:
        members = members.join(small(_met(banded, several), nodes), ["root", "block"], "left").withColumn("others", F.coalesce("others", F.array(F.lit(0).cast("long"))))
    texts = keyed.join(members, F.col("key") == F.col("rep_key")).select("node", "root", "copies", "block", "others", "text")
    found = on_disk(_linked(texts, similarity, bands_of, n))
    links = found.groupBy("a").agg(F.sum("links").alias("others"))
    classes = components(found.where("a <> b").select("a", "b"), most=rows)
    named = sets.join(links, F.col("first") == F.col("a"), "left").join(classes, F.col("first") == F.col("node"), "left")
    named = named.select("set", "rep", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "first").alias("root"))
    ends = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(small(ends, rows), "root").select("set", "class_id", "others", "copies")
    own = F.col("copies").isNull()
    out = sk.select("doc_id", "set").join(named, "set", "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(0)).otherwise(F.col("others") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(own, F.lit(0)).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"),
    )
    out = cut(out.coalesce(max(1, min(partitions(docs.sparkSession), -(-rows // ROWS_EACH)))))
    sk.unpersist()
    found.unpersist()
    return out


def _met(banded: DataFrame, several: DataFrame) -> DataFrame:
    """(root, block, others): the blocks with which each block of (node, root, block) shares a bucket of (node, band), itself among them."""
    at = banded.join(several, "node").select("band", "root", "block").distinct()
    other = at.select(F.col("band").alias("o_band"), F.col("block").alias("other"))
    # A bucket lies in one component; its blocks meet, not its nodes.
    return at.join(other, F.col("band") == F.col("o_band")).groupBy("root", "block").agg(F.collect_set("other").alias("others"))


def _linked(texts: DataFrame, similarity: float, bands_of: Bands, n: int) -> DataFrame:
    """(a, b, links) of the nodes that have links, unit by unit: b connects a within the unit."""

    def sets(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: c[k] for k in ("root", "node", "copies", "block", "others")} | {"bands": [], "grams": []}
        for text in c["text"]:
            grams = shingles(text, n)
            out["bands"].append(bands_of(grams))
            out["grams"].append(grams.tobytes())
        return out

    sized = map_arrow(texts, sets, "root long, node long, bands array<long>, grams binary, copies long, block long, others array<long>")
    dealt = sized.withColumn("other", F.explode("others")).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "bands", "grams", "block", "copies")
    dealt = dealt.repartition(partitions(texts.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(_verify(similarity), "a long, b long, links long")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one whose doc_id is the class's smallest; columns stay as they are.

    Rows that share a doc_id stay or go together, and of those that stay one of each text is kept. Rows without a doc_id
    stay, as nothing names them.
    """
    classes = jaccard_classes(docs, similarity).where("doc_id IS NOT NULL").select("doc_id", "class_id")
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    kept = rows.join(classes.where("doc_id = class_id").select("doc_id").distinct(), "doc_id", "left_semi").select("row.*")
    if not classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op3(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
