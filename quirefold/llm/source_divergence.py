"""Source divergence audit: term counts in mergeable byte tries, divergences of sources from each other and from their language.

Each task counts the terms of its documents in one trie a language: its inner nodes are the first bytes of terms, below each stands
a container of the terms' other bytes, in order, whose leaves count by source. Containers travel by prefix range and are merged
there. A task walks its range in order of UTF-8 bytes, so what it streams is already in the order that breaks ties. Counts of a
pair of sources need only terms that both hold: of f summed over all terms, the terms of one side follow from that side's
histogram of counts, those of neither from the number of terms.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import bound_batches, cut, partitions, tidy

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Counters that a task holds before they are handed on as a trie, and leaves that are merged at once.
COUNTERS = 800_000
LEAVES = 200_000
#: Pairs of counts that a task compares at once, and sums of pairs that it holds.
PAIRS = 1 << 20
BROADCAST_GROUPS = 20_000
#: Bytes of the inner nodes: enough for some ranges a task, as far as letters of one byte go.
LEAST_DEPTH, MOST_DEPTH = 2, 3

#: Letters of ASCII, the large ones made small, and all bytes beyond it make terms; all else parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8; null has none."""
    return text.translate(_FOLD).split() if text else []


def depth_for(ranges: int) -> int:
    return min(MOST_DEPTH, max(LEAST_DEPTH, math.ceil(math.log(8 * ranges, 26))))


class Container(NamedTuple):
    """The terms below one prefix of a language's trie, in order of bytes; of each its documents and its number of counters, and the counters (source, n) of all.

    terms joins what follows the prefix by blanks, which no term holds; numbers holds four runs of 32-bit integers. Both are compressed.
    """

    lang: str
    prefix: bytes | None
    names: list[str]
    leaves: int
    counters: int
    size: int
    terms: bytes | None
    numbers: bytes | None


CONTAINER = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("names", pa.list_(pa.string())), ("leaves", pa.int64()), ("counters", pa.int64()), ("size", pa.int64()), ("terms", pa.binary()), ("numbers", pa.binary())])
CONTAINER_SQL = "lang string, prefix binary, names array<string>, leaves long, counters long, size long, terms binary, numbers binary"


def trie(lang: str, documents: Counter, by_source: dict[str, Counter], depth: int) -> Iterator[Container]:
    """The containers of a language's trie."""
    keys = sorted(documents)
    place = dict(zip(keys, range(len(keys)), strict=True))
    docs = np.fromiter(map(documents.__getitem__, keys), np.uint32, len(keys))
    names = np.array([*by_source, None], object)[:-1]
    leaf = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by_source.values()])
    who = np.repeat(np.arange(len(names), dtype=np.uint32), [len(c) for c in by_source.values()])
    n = np.concatenate([np.fromiter(c.values(), np.uint32, len(c)) for c in by_source.values()])
    order = np.argsort(leaf, kind="stable")
    who, n, sizes = who[order], n[order], np.bincount(leaf, minlength=len(keys)).astype(np.uint32)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    prefixes = [k[:depth] for k in keys]
    cuts = [0, *(i for i in range(1, len(keys)) if prefixes[i] != prefixes[i - 1]), len(keys)]
    pack = pa.Codec("zstd").compress
    for a, b in zip(cuts, cuts[1:], strict=False):
        x, y = ends[a], ends[b]
        own, code = np.unique(who[x:y], return_inverse=True)
        text = b" ".join([k[depth:] for k in keys[a:b]])
        numbers = b"".join(v.astype("<u4", copy=False).tobytes() for v in (docs[a:b], sizes[a:b], code, n[x:y]))
        yield Container(lang, prefixes[a], names[own].tolist(), b - a, int(y - x), len(text), pack(text, asbytes=True), pack(numbers, asbytes=True))


def leaves(c: Container) -> tuple[list[bytes], list[np.ndarray]]:
    """The whole terms of a container, and its documents, numbers of counters, sources and counts."""
    unpack = pa.Codec("zstd").decompress
    found = [c.prefix + rest for rest in unpack(c.terms, c.size, asbytes=True).split(b" ")]
    numbers = np.frombuffer(unpack(c.numbers, 8 * (c.leaves + c.counters), asbytes=True), "<u4").astype(np.int64)
    return found, np.split(numbers, [c.leaves, 2 * c.leaves, 2 * c.leaves + c.counters])


def _batches(rows: Iterable[Container], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    whole = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), CONTAINER, strict=True)], schema=CONTAINER)
    for row in rows:
        held.append(row)
        size += len(row.terms or b"") + len(row.numbers or b"") + 100
        if size > most:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _count(depth: int):
    """Tries of a task's documents; a prefix of null tells the sources of a language, also of documents without terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_source: dict[str, dict[str, Counter]] = {}
        by_lang: dict[str, Counter] = {}
        groups: dict[str, set[str]] = {}

        def tries() -> Iterator[Container]:
            for lang in sorted(by_source):
                yield from trie(lang, by_lang[lang], by_source[lang], depth)
            by_source.clear()
            by_lang.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups.setdefault(lang, set()).add(source)
                if words := terms(text):
                    by_source.setdefault(lang, {}).setdefault(source, Counter()).update(words)
                    by_lang.setdefault(lang, Counter()).update(set(words))
            if sum(len(c) for of in by_source.values() for c in of.values()) > COUNTERS:
                yield from _batches(tries())
        yield from _batches(tries())
        yield from _batches(Container(lang, None, sorted(of), 0, 0, 0, None, None) for lang, of in groups.items())
        tidy()

    return run


KEPT = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("place", pa.int64()), ("first", pa.int32()), ("source", pa.string()), ("n", pa.int64()), ("total", pa.int64())])
KEPT_SQL = "lang string, term binary, place long, first int, source string, n long, total long"


def merge(lang: str, held: list[Container], least: int, low: bytes = b"", high: bytes | None = None, place: int = 0) -> pa.RecordBatch:
    """Counts of the kept terms from low up to high in one language's containers, in order of bytes and source; place numbers the terms."""
    found, parts, names = [], [[] for _ in range(4)], {}
    for c in held:
        own, numbers = leaves(c)
        at = np.array([names.setdefault(x, len(names)) for x in c.names], np.int64)
        docs, sizes, who, n = numbers
        if low or high is not None:
            a, b = bisect_left(own, low), len(own) if high is None else bisect_left(own, high)
            ends = np.append(0, np.cumsum(sizes))
            own, docs, sizes, who, n = own[a:b], docs[a:b], sizes[a:b], who[ends[a] : ends[b]], n[ends[a] : ends[b]]
        found += own
        for part, x in zip(parts, (docs, sizes, at[who], n), strict=True):
            part.append(x)
    docs, sizes, who, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
    seen: dict[bytes, int] = {}
    index = np.fromiter((seen.setdefault(t, len(seen)) for t in found), np.int64, len(found))
    documents = np.zeros(len(seen), np.int64)
    np.add.at(documents, index, docs)
    kept = sorted(t for t, i in seen.items() if documents[i] >= least)
    rank = np.full(len(seen), -1, np.int64)
    rank[[seen[t] for t in kept]] = np.arange(len(kept))
    leaf = rank[np.repeat(index, sizes)]
    stays = leaf >= 0
    known = np.argsort(np.argsort(np.array([*names, ""])[:-1], kind="stable"), kind="stable") if names else np.zeros(0, np.int64)
    keys, inverse = np.unique(leaf[stays] * max(1, len(names)) + known[who[stays]], return_inverse=True)
    counts, totals = np.zeros(len(keys), np.int64), np.zeros(len(kept), np.int64)
    np.add.at(counts, inverse, n[stays])
    leaf, source = np.divmod(keys, max(1, len(names)))
    np.add.at(totals, leaf, counts)
    first = np.diff(leaf, prepend=-1) > 0
    cols = [
        pa.DictionaryArray.from_arrays(np.zeros(len(keys), np.int32), pa.array([lang])).cast(pa.string()), pa.array(kept, pa.binary()).take(pa.array(leaf)), pa.array(leaf + place), pa.array(first.astype(np.int32)),
        pa.array(sorted(names), pa.string()).take(pa.array(source)), pa.array(counts), pa.array(totals[leaf]),
    ]
    return pa.RecordBatch.from_arrays(cols, schema=KEPT)


def _merged(least: int):
    """Merges the containers of a prefix range, which come in order of (lang, prefix), some whole prefixes at once; one with very many leaves in parts of its range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0

        def all_of(held: list[Container]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            ways = -(-sum(c.leaves for c in held) // (2 * LEAVES))
            widest = leaves(max(held, key=lambda c: c.leaves))[0] if ways > 1 else []
            bounds = [b"", *sorted({widest[len(widest) * k // ways] for k in range(1, ways)} - {b""} if widest else ()), None]
            for low, high in zip(bounds, bounds[1:], strict=False):
                out = merge(held[0].lang, held, least, low, high, place)
                place += len(set(out.column(2).to_pylist()))
                yield out

        held: list[Container] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = Container(*row)
                if held and (c.lang != held[0].lang or c.prefix != held[-1].prefix and sum(x.leaves for x in held) >= LEAVES):
                    yield from all_of(held)
                    held = []
                held.append(c)
        if held:
            yield from all_of(held)
        tidy()

    return run


def whole(a: Column, b: Column) -> Column:
    """floor(a / b) of non-negative whole numbers, without rounding."""
    return F.call_function("div", a, b)


def share(count: Column, all_count: Column, kept: Column) -> Column:
    """p = 1 + floor(UNIT * (count + 1) / (N + V)), exactly; null where nothing is kept."""
    part = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(kept > 0, whole(part, (all_count + kept).cast("decimal(20,0)")) + 1)


def gap(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / q)."""
    return whole((p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


STREAMED = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _walked(top: int):
    """Walks a range's terms in order of bytes: sums over terms that both sources of a pair hold, and each source's candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]  # source, value, term; of equal values the earlier term stands first

        def flush(parts: dict[int, int]) -> pa.RecordBatch:
            known = list(names)
            rows = [("pair", *known[k >> 32], known[k & 0xFFFFFFFF][1].encode(), v) for k, v in parts.items()]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, STREAMED, strict=True)], schema=STREAMED)

        def groups(table: pa.Table) -> np.ndarray:
            """A number of each row's (lang, source)."""
            lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            keys, inverse = np.unique(both, return_inverse=True)
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            return np.array([names.setdefault((langs[k // len(sources)], sources[k % len(sources)]), len(names)) for k in keys.tolist()], np.int64)[inverse]

        def terms_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal best, sums
            p, q, p0, place = (table.column(c).to_numpy().astype(np.int64) for c in ("p", "q", "p0", "place"))
            at = groups(table)
            # Candidates: what a source uses more than its language, the best so far of each source.
            more = np.flatnonzero(p > q)
            value = _gap(p[more], q[more])
            order = np.lexsort((-value, at[more]))  # stable, so ties stay in order of bytes
            where = at[more][order]
            more, value = (x[order[np.arange(len(order)) - np.searchsorted(where, where) < top]] for x in (more, value))
            words = table.column("term").take(pa.array(more)).to_pylist()
            cand = [np.concatenate(x) for x in zip(best, (at[more], value, np.array([*words, None], object)[:-1]), strict=True)]
            order = np.lexsort((-cand[1], cand[0]))
            where = cand[0][order]
            best = [x[order[np.arange(len(order)) - np.searchsorted(where, where) < top]] for x in cand]
            # Pairs of sources that hold the same term.
            first = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
            size = np.diff(np.append(first, len(place)))
            start, wide = np.repeat(first, size), np.repeat(size, size)
            ends = np.cumsum(wide)
            i = 0
            while i < len(wide):
                done = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                a = np.repeat(np.arange(i, j), wide[i:j])
                b = start[a] + np.arange(len(a)) - np.repeat(ends[i:j] - wide[i:j] - done, wide[i:j])
                a, b = a[a != b], b[a != b]
                value = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
                keys, inverse = np.unique(at[a] << 32 | at[b], return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, inverse, value)
                for k, v in zip(keys.tolist(), total.tolist(), strict=True):
                    sums[k] = sums.get(k, 0) + v
                if len(sums) > PAIRS:
                    yield flush(sums)
                    sums = {}
                i = j

        rest = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                # The last term may go on in the next batch.
                place = table.column("place").to_numpy()
                n = int(np.searchsorted(place, place[-1]))
                if n:
                    yield from terms_of(table.slice(0, n))
                rest = table.slice(n)
        if rest is not None:
            yield from terms_of(rest)
        yield flush(sums)
        known = list(names)
        cols = [["term"] * len(best[0]), [known[i][0] for i in best[0]], [known[i][1] for i in best[0]], best[2].tolist(), best[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, STREAMED, strict=True)], schema=STREAMED)
        tidy()

    return run


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lang, term binary, place, first, source, n, total) of the kept terms' counts in order of bytes within ranges, and (lang, source) of all rows.

    first is 1 on one row of each term; total is the term's count in its language. Null text, lang and source read as ''.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    counted = cut(rows.mapInArrow(_count(depth_for(partitions(spark))), CONTAINER_SQL))
    groups = counted.where("prefix IS NULL").select("lang", F.explode("names").alias("source")).distinct()
    ranges = counted.where("prefix IS NOT NULL").repartitionByRange(partitions(spark), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    kept = ranges.mapInArrow(_merged(least), KEPT_SQL)
    # A term has one place: its number within its range, after the range's own.
    return cut(kept.withColumn("place", F.spark_partition_id().cast("long") * (1 << 40) + F.col("place"))), groups


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's word use lies from each other source of its language, and the terms that set it apart.

    Counts are smoothed by one; all arithmetic is on whole numbers. part 'pair': all other sources of the language, by value
    descending and item; value is 0 where no term is kept. part 'term': the top terms a source uses more than its
    language. Nulls read as ''; rows repeat as often as they stand there; groups without terms have pairs only; very
    long texts are one document; an empty table gives an empty result. Other columns are not read.
    """
    kept, groups = term_counts(docs, least)
    by_lang = kept.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_n"))
    by_group = kept.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.sum("n").alias("group_n"))
    groups = groups.join(by_group, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")), "left").join(by_lang, F.col("lang") == F.col("l_lang"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), zero("group_n"), zero("kept"), zero("lang_n"))
    groups = cut(groups.withColumn("p0", share(F.lit(0), F.col("group_n"), F.col("kept"))))

    few = groups.count() <= BROADCAST_GROUPS
    near = F.broadcast(groups) if few else groups
    rows = kept.join(near, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    rows = rows.select("lang", "term", "place", "source", share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"), "p0")
    ordered = (rows if few else rows.repartitionByRange(partitions(docs.sparkSession), "place")).sortWithinPartitions("place")
    streamed = cut(ordered.mapInArrow(_walked(top), "part string, lang string, source string, item binary, value long"))

    # What one side's terms add where the other side has none, from the number of its terms of each p.
    pairs = groups.select("g_lang", "g_source", F.col("p0").alias("q0"))
    used = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")).join(pairs, (F.col("lang") == F.col("g_lang")) & (F.col("source") != F.col("g_source")))
    one = F.struct("source", F.col("g_source").alias("item"), (F.col("terms") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    two = F.struct(F.col("g_source").alias("source"), F.col("source").alias("item"), (F.col("terms") * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0")))).alias("value"))
    sides = used.select("lang", F.explode(F.array(one, two)).alias("x")).select("lang", "x.source", "x.item", "x.value")
    every = groups.alias("a").join(pairs.alias("b"), (F.col("a.g_lang") == F.col("b.g_lang")) & (F.col("a.g_source") != F.col("b.g_source")))
    every = every.select(F.col("a.g_lang").alias("lang"), F.col("a.g_source").alias("source"), F.col("b.g_source").alias("item"), F.coalesce(F.col("a.kept") * gap(F.col("a.p0"), F.col("b.q0")), F.lit(0)).alias("value"))
    both = streamed.where("part = 'pair'").select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    found = every.unionByName(sides).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    own = streamed.where("part = 'term'").select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value")
    return ranked.unionByName(own.withColumn("rank", place).where(F.col("rank") <= top))


def op13(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
l AS MATERIALIZED (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT gn.lang, gn.source, k.term, coalesce(x.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(x.c, 0) + 1)) // (gn.n + l.v))::BIGINT AS p
  FROM gn JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = gn.lang AND x.source = gn.source AND x.term = k.term),
q AS (SELECT k.lang, k.term, (1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v))::BIGINT AS q FROM kept k JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= 200)
SELECT lang, source, part, item, value, rank FROM ranked
"""
