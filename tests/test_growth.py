"""What the plans of heavy queries hold: pages streamed instead of grouped in Python, and what several fields read computed once."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from quirefold.operators import forms, geometry, jsontree, tables
from quirefold.plans import registry


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("simple")
    return out.getvalue()


def test_row_clusters_stream_pages_of_any_key(spark):
    rows = [("b", 1, 0.0), ("a", 3, None), ("a", 1, 9.0), ("a", 2, 8.0), (None, 1, 1.0), (None, 2, 2.0), ("b", 2, 20.0)]
    found = geometry.row_clusters(spark.createDataFrame(rows, "page string, box int, y double"), "page", 4.0)
    assert {tuple(r) for r in found.collect()} == {("b", 1, 0), ("b", 2, 1), ("a", 2, 0), ("a", 1, 0), ("a", 3, 0), (None, 1, 0), (None, 2, 0)}
    assert "FlatMapGroups" not in plan(found)


def test_row_clusters_go_on_over_batches(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.range(40).selectExpr("id % 2 AS page", "id AS box", "CAST(id * 2 AS double) AS y")
        got = {(r.page, r.box): r.row for r in geometry.row_clusters(rows, "page", 4.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    for page in (0, 1):
        row, members = -1, []
        for box in range(page, 40, 2):
            if not members or abs(box * 2 - sum(members) / len(members)) > 4.0:
                row, members = row + 1, []
            members.append(box * 2)
            assert got[page, box] == row

def test_one_to_one_streams_pages(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        costs = [(1, 1, 5.0), (1, 2, 1.0), (2, 2, 2.0), (2, 2, 9.0), (3, None, 0.5)]
        pairs = spark.createDataFrame([(f"p{p}" if p else None, a, v, c) for p in range(4) for a, v, c in costs], "page string, a int, v int, c double").withColumn("n", F.lit(1))
        found = tables.one_to_one(pairs, ["page", "n"], "a", "v", "c")
        got = sorted((r.page or "", r.n, r.label, r.value) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == [(p, 1, a, v) for p in ("", "p1", "p2", "p3") for a, v in ((1, 1), (2, 2), (3, None))]
    assert "FlatMapGroups" not in plan(found)


def test_cheapest_reads_each_pair_once():
    class Counted(dict):
        read = 0

        def __iter__(self):
            for x in super().__iter__():
                self.read += 1
                yield x

    costs = Counted({(a, v): float((a * 7 + v) % 11) for a in range(60) for v in range(a, a + 3)})
    got = tables.cheapest(costs)
    assert len(got) == 60 == len({v for _, v in got}) and costs.read <= 2 * len(costs)


#: What a query's plan may call at most: each folded text, match and value is written once, however many fields read it.
CALLS = {
    "sanitized_summary": ("regexp_extract(", 24),
    "family_fields": ("regexp_extract(", 24),
    "leave_form": ("regexp_extract(", 40),
    "overtime_form": ("regexp_extract(", 60),
    "scanned_overtime": ("regexp_extract(", 90),
    "cv_form": ("translate(", 16),
    "card_form": ("translate(", 10),
    "contract_form": ("regexp_extract(", 100),
}


@pytest.mark.parametrize("name", CALLS)
def test_plans_name_each_match_once(spark, name):
    call, most = CALLS[name]
    text = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < text.count(call) <= most


def test_keys_of_blocks_folded_together(spark):
    texts = ["1. Số HĐ: 5", "\n- Mã\nNV ", "--", " ", "Straße", "", None, "x\n\ny", "İ 5"]
    df = spark.createDataFrame([([(t, "ocr", 0.9) for t in texts],), ([],), (None,)], "blocks array<struct<text: string, kind: string, confidence: double>>")
    got = [r.b for r in df.select(forms.keyed_blocks(F.col("blocks")).alias("b")).collect()]
    want = [r.k for r in df.select(F.transform("blocks", lambda b: forms.key_of(F.coalesce(b["text"], F.lit("")))).alias("k")).collect()]
    bare = [r.k for r in df.select(F.transform("blocks", lambda b: forms.key_of(F.regexp_replace(b["text"], forms.PREFIX, ""))).alias("k")).collect()]
    assert [x.key for x in got[0]] == want[0] and [x.bare_key for x in got[0] if x.text is not None] == [k for k in bare[0] if k is not None]
    assert all(x.lead == f"{x.key} " for x in got[0]) and got[1:] == [[], None]


def test_strict_json_parses_a_document_once(spark):
    rules = {"$": ("object",), "$.a": ("number",), "$.b": ("object", "?"), "$.b.c": ("string", "null")}
    docs = [(1, '{"a": 1, "b": {"c": null}}'), (2, '{"a": "x", "b": {}, "d": [1, {"e": 2}]}'), (3, "{"), (4, None), (5, "[]"), (6, '{"b": {"c": 1}}')]
    df = lambda rows: spark.createDataFrame(rows, "k int, j string")
    found = jsontree.problems(df(docs), "k", "j", rules)
    want = {(2, "$.a", "KIND"), (2, "$.b.c", "MISSING"), (2, "$.d", "UNKNOWN"), (3, "$", "BROKEN"), (5, "$", "KIND"), (6, "$.a", "MISSING"), (6, "$.b.c", "KIND")}
    assert {tuple(r) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    # What one document of a key has is not missing in another.
    twice = jsontree.problems(df([*docs, (2, '{"a": 2, "b": {"c": "y"}}')]), "k", "j", rules)
    assert {tuple(r) for r in twice.collect()} == want - {(2, "$.b.c", "MISSING")}


def test_json_nesting_apart_from_strings(spark):
    rows = [('{"a{[": [{"b\\\\": "]}"}]}', 3), ("5", 0), ("[[], {}]", 2)]
    got = spark.createDataFrame(rows, "j string, n int").select(jsontree.nesting(jsontree.brackets(F.col("j"))).alias("x"), "n").collect()
    assert all(r.x == r.n for r in got)
