"""Divergences of sources against plain Python with fractions, tries against dictionaries, and the query against its SQL."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import pytest

from quirefold.llm import source_divergence as sd
from quirefold.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    rows = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        documents = Counter(t for g, _, ts in rows if g == lang for t in set(ts))
        kept = [t for t, n in documents.items() if n >= least]
        counts = {s: Counter() for g, s, _ in rows if g == lang}
        for g, s, ts in rows:
            if g == lang:
                counts[s].update(t for t in ts if documents[t] >= least)
        share = lambda c, n: 1 + floor(Fraction(10**9 * (c + 1), n + len(kept)))  # noqa: B023, E731
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in counts.items()}
        total = sum(counts.values(), Counter())
        q = {t: share(total[t], sum(total.values())) for t in kept}
        f = lambda a, b: floor(Fraction((a - b) ** 2, b))
        for s in counts:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in counts if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(ordered, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_python(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "B", "É", "é", "éa", "\U0001f600", "z9z", "it's", "ﬁ", "ß"] + [chr(97 + i) * (1 + i % 4) for i in range(20)]
    rows = []
    for i in range(120):
        text = rng.choice([None, "", "12 - 34"]) if i % 9 == 0 else rng.choice([" ", "\x00", "7", "_"]).join(rng.choice(words) for _ in range(rng.randint(1, 40)))
        rows.append((i % 100, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "ü", None])))
    rows += [(1, None, "lone", "x"), (2, "only once", "xx", "y"), (3, "b " * 100_000 + "ab", "en", "s1")]
    monkeypatch.setattr(sd, "PAIRS", 7)
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    top = [200, 3, 1][seed]
    got = sd.divergence(df, top=top)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, top=top)
    # Beyond the bound of a broadcast, groups come by shuffle.
    monkeypatch.setattr(sd, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, sd.divergence(df, top=top).collect())) == plain(rows, top=top)


def test_containers_hold_what_was_counted():
    rng = random.Random(1)
    by_source = {s: Counter({bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(300)}) for s in ("x", "y", "z")}
    documents = Counter(t for c in by_source.values() for t in c)
    found = list(sd.trie("en", documents, by_source, 2))
    assert [c.prefix for c in found] == sorted({t[:2] for t in documents})
    keys, got, docs = [], {s: Counter() for s in by_source}, Counter()
    for c in found:
        own, (d, sizes, who, n) = sd.leaves(c)
        keys += own
        docs.update(dict(zip(own, d.tolist(), strict=True)))
        for t, w, k in zip([t for t, m in zip(own, sizes, strict=True) for _ in range(m)], who, n, strict=True):
            got[c.names[w]][t] += int(k)
    assert keys == sorted(documents) and docs == documents and got == by_source


@pytest.mark.parametrize("most", [1, 4, 10**6])
def test_merged_in_parts(monkeypatch, most):
    """Counters that are full are handed on, and ranges are merged in parts; both ends by hand."""
    import pyarrow as pa

    monkeypatch.setattr(sd, "COUNTERS", 5)
    monkeypatch.setattr(sd, "LEAVES", most)
    rng = random.Random(3)
    rows = [("en", rng.choice("xy"), " ".join("a" * rng.randint(1, 4) + chr(97 + rng.randint(0, 5)) * rng.randint(1, 2) for _ in range(20)).encode()) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7], strict=True)], names=["lang", "source", "text"]) for i in range(0, 60, 7)]
    found = sorted((sd.Container(*r) for b in sd._count(2)(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[1] is not None), key=lambda c: (c.lang, c.prefix))
    got, places = Counter(), {}
    for b in sd._merged(3)(sd._batches(found, 1)):
        for _, term, place, first, source, n, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert (term, source) not in got and first == (term not in places) and places.setdefault(term, place) == place
            got[term, source] = n
    documents = Counter(t for _, _, x in rows for t in set(x.split()))
    want = Counter((t, s) for _, s, x in rows for t in x.split() if documents[t] >= 3)
    assert got == want and sorted(places, key=places.get) == sorted(places)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES["op13_source_divergence"](spark, sf)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(sd.OP13_SQL).fetchall())
