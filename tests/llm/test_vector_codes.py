"""Product codes against plain Python, odd rows, and the query against its SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quirefold.llm import vector_codes
from quirefold.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, terms int, n int"


def plain(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in of.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in found], sum(d for d, _ in found)))
    return out, books


def order(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_python(spark, seed):
    rng = np.random.default_rng(seed)
    dims = [8, 16, 5, 24][seed]
    rows = []
    for i in range(90):
        v = [float(np.float32(x)) for x in rng.normal(0, 1, dims).round(1)]
        rows.append((int(rng.integers(0, 70)), v[: dims - int(rng.integers(0, 3))] if seed == 2 else v, int(rng.integers(0, 3)) if i % 5 else None, 0, 0))
    rows += [(None, rows[0][1], None, 1, 1), (3, None, 1, 0, 0), (4, [float("nan")] * dims, 1, 0, 0), (5, [None] + rows[0][1][1:], 1, 0, 0), (6, [float("inf")] * dims, 2, 0, 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    coded, books = vector_codes.compress(df, parts=4, entries=6, rounds=3, scale=64)
    want, want_books = plain([r[:3] for r in rows], 4, 6, 3, 64)
    assert books.tolist() == want_books
    assert order((r.id, r.label, r.code, r.error) for r in coded.collect()) == order(want)
    total = {}
    for _, lab, _, e in want:
        total[lab] = total.get(lab, 0) + e
    got = vector_codes.label_errors(coded, coded.error).collect()
    assert len(got) == len(want) and all(r.label_error == total[r.label] for r in got)


def test_few_rows_empty_vectors_far_components(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [3e38, -3e38], 0, 0, 0)], SCHEMA))
    assert books.shape == (8, 1, 1) and books[0, 0, 0] == vector_codes.BOUND and [r.error for r in coded.collect()] == [0]
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [], 0, 0, 0), (2, [], 0, 0, 0)], SCHEMA))
    assert [(r.code, r.error) for r in coded.collect()] == [([0] * 8, 0)] * 2
    none = spark.createDataFrame([(1, None, 0, 0, 0)], SCHEMA)
    assert vector_codes.compress(none)[0].collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op11_vector_codes"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(vector_codes.OP11_SQL).fetchall()) and got
    rows = c.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    _, books = plain(rows, 8, 16, 6, 4096)
    flat = ",".join(str(x) for part in books for entry in part for x in entry)
    assert got[0].codebooks_sha256 == hashlib.sha256(flat.encode()).hexdigest()
