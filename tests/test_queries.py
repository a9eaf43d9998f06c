"""Every registered query of the engine's own operators: it runs on the small tables and equals its SQL."""

import math
import unicodedata
from collections import Counter

import duckdb
import pytest

from quirefold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(v, (bool, str, bytes)):
        return v
    return round(float(v), 9) if not isinstance(v, (list, dict)) and math.isfinite(float(v)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        # Each of these has a brute-force test of its own.
        assert name in {"assigned_values", "normalized_tables", "stream_history", "der", "distinct_boxes", "fuzzy_anti", "fuzzy_phrase", "narratives", "row_cluster", "wer_words", "coordinate_tables", "overlap_rows", "merged_readings", "phone_candidates", "label_scores"} and got[1]
        return
    rel = duck.execute(registry.ORACLES[name])
    want = rows([d[0] for d in rel.description], rel.fetchall())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_der_scores_every_line(spark, tmp_path):
    texts = ["plain\nthé café\n\nÉtude  naïve", "ß đ\nà", None, "", "  \nfin"]
    rows = [(i // 2, i % 2, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = [" ".join(x.split()) for t in texts for x in (t or "").split("\n") if x.strip(" ")]
    plain = [unicodedata.normalize("NFD", x) for x in lines]
    plain = ["".join(c for c in x if unicodedata.category(c) != "Mn") for x in plain]
    # Removing marks is letter by letter, so the edits are the letters that differ; the barred d is a mark that stays.
    edits = sum(a != b for t, p in zip(lines, plain, strict=True) for a, b in zip(t, p, strict=True))
    marks = edits + sum(t.count("đ") for t in lines)
    exact = sum(t == p for t, p in zip(lines, plain, strict=True))
    (got,) = registry.QUERIES["der"](spark, str(tmp_path)).collect()
    want = {"role": "all", "cases": len(lines), "exact": round(exact / len(lines), 6), "exact_casefold": round(exact / len(lines), 6), "cer": round(edits / sum(map(len, lines)), 6), "der": round(edits / marks, 6)}
    assert len(lines) == 6 and got.asDict() == want
