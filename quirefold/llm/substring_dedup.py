"""Suffix-array dedup of repeated byte strings: difference-cover suffix sorting where repeats can be, adjacent prefixes compared.

A suffix array over every byte of a corpus is far larger than the corpus. Each string of LENGTH bytes holds an anchor, the
K-byte piece of least hash in it, and equal strings hold it at the same place. So strings can only repeat around anchors that repeat:
Spark groups the anchors, and all occurrences but the first of the same surroundings go at once. Where surroundings differ,
their bytes are dealt out by anchor and each task builds the suffix array of its share by the difference cover modulo 3
(sort sampled triples, recurse on their names, merge the remaining suffixes) and compares the prefixes of adjacent suffixes.
Nothing is sampled: every string of LENGTH bytes of every text takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import _scramble, bound_batches, cut, keyed_rows, partitions

LENGTH = 100
K = 32
GRAMS = LENGTH - K + 1
PIECE = 1 << 19
MASK = np.uint64((1 << 20) - 1)
#: Bytes of surroundings that a task sorts at a time; a larger group of one anchor is sorted as a whole.
CHUNK = 900_000
#: An anchor with more different surroundings than this is compared string by string instead, dealt out by the strings' hashes.
MOST = 20_000


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the K = 32 bytes from each place, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    base, n = 0x9E3779B97F4A7C15, 1
    while n < K:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % (1 << 64), 2 * n
    return _scramble(h)


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of each anchor and of the strings that hold it as theirs."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for a in range(0, max(0, len(b) - LENGTH + 1), PIECE):
        h = gram_hashes(b[a : a + PIECE + LENGTH - 1])
        m = (h & ~MASK) | np.arange(len(h), dtype=np.uint64)
        wide = 1
        while 2 * wide <= GRAMS:
            m, wide = np.minimum(m[:-wide], m[wide:]), 2 * wide
        if wide < GRAMS:
            m = np.minimum(m[: len(m) - GRAMS + wide], m[GRAMS - wide :])
        at = (m & MASK).astype(np.int64)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        hi = np.append(lo[1:], len(at)) - 1
        for x, y in zip(out, (h[at[lo]], at[lo] + a, lo + a, hi + a), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def pack(lo: np.ndarray, place: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One number for the first start and the distances from it to the anchor and to the last start; ascends with the first start."""
    return (lo << 14) | ((place - lo) << 7) | (hi - lo)


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            h, place, lo, hi = anchors(np.frombuffer(raw, np.uint8))
            digest = xxhash.xxh3_64_intdigest
            ctx = np.fromiter((digest(raw[i : j + LENGTH], p - i) for i, j, p in zip(lo.tolist(), hi.tolist(), place.tolist(), strict=True)), np.uint64, len(lo))
            for x, y in zip(cols, (h.view(np.int64), ctx.view(np.int64), np.full(len(lo), key, np.int64), pack(lo, place, hi)), strict=True):
                x.append(y)
        if cols[0]:
            h, ctx, key, at = map(np.concatenate, cols)
            order = np.lexsort((at, key, ctx, h))
            h, ctx, key, at = h[order], ctx[order], key[order], at[order]
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1])
            # Repeats within the batch are settled here, so that a frequent passage does not travel; they are spread by a hash.
            h = np.where(same, _scramble((key * 1_000_003 + at).astype(np.uint64)).view(np.int64), h)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.where(same, 0, ctx)), pa.array(key), pa.array(at), pa.array(same)], names=["anchor", "ctx", "key", "at", "gone"])


def _dense(*cols: np.ndarray) -> np.ndarray:
    """Numbers that order rows of the columns as the columns do."""
    bits = [int(c.max(initial=0)).bit_length() for c in cols]
    if sum(bits) > 62:
        cols = tuple(np.unique(c, return_inverse=True)[1] for c in cols)
        bits = [int(c.max(initial=0)).bit_length() for c in cols]
    while len(cols) > 1 and sum(bits) > 62:
        # Each column has at most 2 ** 31 values here, so a pair fits.
        pair = np.unique((cols[0].astype(np.uint64) << np.uint64(bits[1])) | cols[1].astype(np.uint64), return_inverse=True)[1]
        cols, bits = (pair, *cols[2:]), [int(pair.max(initial=0)).bit_length(), *bits[2:]]
    out = cols[0].astype(np.uint64)
    for c, n in zip(cols[1:], bits[1:], strict=True):
        out = (out << np.uint64(n)) | c.astype(np.uint64)
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of a string of positive integers in ascending order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 8:
        t = s.tolist()
        return np.array(sorted(range(n), key=lambda i: t[i:]), np.int64)
    x = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    # If n = 1 modulo 3, an empty suffix of the first kind ends the first half.
    ones, twos = np.arange(1, n + (n0 - n1), 3), np.arange(2, n + (n0 - n1), 3)
    cover = np.concatenate([ones, twos])
    x = np.concatenate([x, np.zeros(3, np.int64)])
    triples = _dense(x[cover], x[cover + 1], x[cover + 2])
    order = np.argsort(triples, kind="stable")
    steps = np.ones(len(order), bool)
    steps[1:] = triples[order][1:] != triples[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(steps)
    if not steps.all():
        order = suffix_array(names)
    sampled = cover[order]
    rank = np.zeros(n + 6, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    at0 = _dense(x[: n + 3], rank[1 : n + 4])
    at2 = _dense(x[: n + 3], x[1 : n + 4], rank[2 : n + 5])
    rest = rest[np.argsort(at0[rest], kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(at0[first], at0[rest]) + np.searchsorted(at2[second], at2[rest])
    out = np.empty(n, np.int64)
    own = below + np.arange(len(rest))
    out[own] = rest
    free = np.ones(n, bool)
    free[own] = False
    out[free] = sampled
    return out


def repeated(contexts: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(key, first start, last start) of the strings in (key, at, bytes) surroundings that an earlier one there equals."""
    size = np.array([len(c[2]) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    s = np.zeros(begin[-1] + LENGTH, np.int64)
    text = np.frombuffer(b"\0".join([c[2] for c in contexts]) + b"\0", np.uint8).astype(np.int64) + 2
    s[: begin[-1]] = text
    s[begin[1:] - 1] = 1
    at = np.array([c[1] for c in contexts])
    count = (at & 127) + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[owner] + offset
    key = np.array([c[0] for c in contexts])[owner]
    place = (at >> 14)[owner] + offset
    earlier = np.empty(len(owner), np.int64)
    earlier[np.lexsort((place, key))] = np.arange(len(owner))
    row = np.full(begin[-1], -1, np.int64)
    row[start] = np.arange(len(owner))
    sa = suffix_array(s[: begin[-1]])
    sa = sa[row[sa] >= 0]
    words = np.zeros(len(s), np.uint64)
    for i in range(8):
        words[: len(s) - i] |= np.maximum(s[i:] - 2, 0).astype(np.uint64) << np.uint64(8 * i)
    equal = np.ones(max(0, len(sa) - 1), bool)
    for i in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        equal &= words[sa[1:] + i] == words[sa[:-1] + i]
    groups = np.flatnonzero(np.concatenate([[True], ~equal]))
    ranks = earlier[row[sa]]
    least = np.repeat(np.minimum.reduceat(ranks, groups), np.diff(np.append(groups, len(sa))))
    gone = np.zeros(len(owner), bool)
    gone[row[sa]] = ranks != least
    rows = np.flatnonzero(gone)
    cutsat = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 1) | (np.diff(owner[rows]) != 0)])) if len(rows) else rows
    ends = np.append(cutsat[1:], len(rows)) - 1 if len(rows) else rows
    a, b = rows[cutsat], rows[ends]
    return list(zip(key[a].tolist(), place[a].tolist(), place[b].tolist(), strict=True))


def _sorted_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    group: list[tuple[int, int, bytes]] = []
    size, anchor = 0, None

    def out(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if found := repeated(rows) if len(rows) > 1 else []:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["key", "lo", "hi"])

    for batch in batches:
        for a, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if a != anchor:
                held += group
                group, anchor = [], a
                if size > CHUNK:
                    yield from out(held)
                    held, size = [], 0
            group.append(tuple(row))
            size += len(row[2])
    yield from out(held + group)


def _bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            rows += [(w["anchor"], key, w["at"], raw[w["at"] >> 14 : (w["at"] >> 14) + (w["at"] & 127) + LENGTH], w["many"]) for w in wanted]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["anchor", "key", "at", "bytes", "many"])


def _strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(xxhash.xxh3_128_digest(raw[i : i + LENGTH]), key, (at >> 14) + i) for key, at, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for i in range((at & 127) + 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["string", "key", "lo"])


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(key, lo, hi): every start of a LENGTH-byte string of (key, text) rows that also starts earlier lies in such a range."""
    spark = keyed.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    occ = keyed.select("key", "text").mapInArrow(_occurrences, "anchor long, ctx long, key long, at long, gone boolean")
    by_anchor, by_both = Window.partitionBy("anchor"), Window.partitionBy("anchor", "ctx")
    here = F.struct("key", "at")
    occ = occ.withColumns({"least": F.min("ctx").over(by_anchor), "most": F.max("ctx").over(by_anchor), "all": F.count("*").over(by_anchor), "first": F.min(here).over(by_both)})
    later = F.col("gone") | (here > F.col("first"))
    kept = occ.where(later | (F.col("least") < F.col("most"))).select("key", "at", F.when(~later, F.col("anchor")).alias("anchor"), (F.col("all") > MOST).alias("many"))
    kept = cut(kept)
    whole = kept.where("anchor IS NULL").select("key", F.shiftright("at", 14).alias("lo"), (F.shiftright("at", 14) + F.col("at").bitwiseAND(127)).alias("hi"))
    asked = kept.where("anchor IS NOT NULL")
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "many")).alias("wanted"))
    found = keyed.select("text", "key").join(wanted, "key").select("key", "text", "wanted").mapInArrow(_bytes, "anchor long, key long, at long, bytes binary, many boolean")
    some = found.where("NOT many").select("anchor", "key", "at", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_out, "key long, lo long, hi long")
    out = whole.union(some)
    if not asked.where("many").isEmpty():
        strings = found.where("many").select("key", "at", "bytes").mapInArrow(_strings, "string binary, key long, lo long")
        first = strings.groupBy("string").agg(F.min(F.struct("key", "lo")).alias("first"))
        out = out.union(strings.join(first, "string").where(F.struct("key", "lo") > F.col("first")).select("key", "lo", F.col("lo").alias("hi")))
    return out


def spans(ranges: list, n: int) -> list[tuple[int, int]]:
    """Maximal removed runs from ranges of starts."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, min(b, n)) for a, b in out]


def dedup_substrings(docs: DataFrame, fn, ddl: str, schema: pa.Schema) -> DataFrame:
    """fn(doc_id, raw bytes, removed runs) -> row, for every row of docs."""
    keyed, distinct, plain = keyed_rows(docs)
    ranges = repeated_ranges(distinct).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).withColumnRenamed("key", "r_key")
    # Where key is doc_id, both joins read the same (key, text) rows by key, so that the texts are shuffled once.
    rows = keyed.join(ranges, F.col("key") == F.col("r_key"), "left").select(F.col("key" if plain else "doc_id").alias("doc_id"), "text", "ranges")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out.append(fn(doc_id, raw, spans(r, len(raw))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, ddl)


def remaining(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, starts, ends): the remaining bytes of each text and the runs that were removed.

    Null texts are empty; texts shorter than LENGTH bytes stay whole; of repeated rows all get the same result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    return dedup_substrings(docs, lambda i, raw, runs: (i, remaining(raw, runs), [a for a, _ in runs], [b for _, b in runs]), "doc_id long, kept binary, starts array<long>, ends array<long>", schema)


def op9(spark, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(doc_id: int, raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(remaining(raw, runs)).hexdigest()

    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", schema)
