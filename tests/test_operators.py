"""Golden cases of the engine's operators."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quirefold.functions import dates, numbers
from quirefold.functions import text as t
from quirefold.operators import classify, geometry, governance, matching, metrics, observe, quality
from quirefold.streaming import replay


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("fold", "want"),
    [(t.fold_key, "hop dong lao dong"), (t.fold_strict, "hop ong lao ong"), (t.fold_ocr, "hop dong: lao dong"), (t.fold_match, "hợp đồng: lao động"), (t.compact_key, "hopdonglaodong"), (t.without_vietnamese_marks, "HOP DONG:  Lao dong")],
)
def test_folds_differ(spark, fold, want):
    assert one(spark, fold(F.col("s")), s="HỢP ĐỒNG:  Lao động") == want


def test_rates_round_to_even_and_zero_denominators(spark):
    assert one(spark, numbers.rate(F.col("n"), F.col("d")), n=1, d=128) == 0.007812
    assert one(spark, numbers.rate(F.col("n"), F.col("d")), n=1, d=0) == 0.0


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert rows.agg(numbers.nearest_rank("v", 0.95).alias("p")).first().p == 19.0
    assert rows.where("v <= 20 AND v IN (10, 20)").agg(numbers.nearest_rank("v", 0.5).alias("p")).first().p == 10.0


@pytest.mark.parametrize(("text", "want"), [("ngày 5 tháng 2 năm 2024", "2024-02-05"), ("on 31/02/2024", None), ("7.3.2023 to 8.3.2023", "2023-03-07"), ("none", None)])
def test_first_date(spark, text, want):
    got = one(spark, dates.first_date(F.col("s")), s=text)
    assert (got.isoformat() if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("1.234,50", 1234.5), ("1,234.5", 1234.5), ("12.000", 12000.0), ("12,5", 12.5), ("1.234.567", 1234567.0), ("x", None)])
def test_decimal_token(spark, text, want):
    got = one(spark, numbers.decimal_token(F.col("s")), s=text)
    assert (float(got) if got is not None else None) == want


def test_label_value(spark):
    label, value = t.label_value(F.col("s"))
    for s, want in [("Họ tên: Linh", ("Họ tên", "Linh")), ("a： b: c", ("a： b", "c")), (": x", (None, None)), ("plain", (None, None)), ("k：v", ("k", "v"))]:
        r = spark.createDataFrame([(s,)], "s string").select(label.alias("l"), value.alias("v")).first()
        assert (r.l, r.v) == want


def test_metric_triple(spark):
    pairs = spark.createDataFrame([("PHẠM THỊ LINH", "PHAM THI LINH"), ("Quận 1", "quận 1"), ("CỘNG   HÒA", "CỘNG HÒA")], "truth string, pred string")
    r = metrics.text_errors(pairs, words=True).first()
    assert (r.cases, r.exact, r.exact_casefold) == (3, 0.333333, 0.666667)
    assert r.cer == round(3 / (13 + 6 + 8), 6)
    assert 0 < r.der <= 1 and r.wer == round(3 / 7, 6)


def test_macro_f1_of_two_cases(spark):
    pairs = spark.createDataFrame([("CV", "CV"), ("EMPLOYEE_PROFILE", "UNKNOWN")], "truth string, pred string")
    r = metrics.class_macro(metrics.class_report(pairs)).first()
    assert (r.macro_f1, r.unknown_rate) == (0.5, 0.5)


def test_classifier(spark):
    docs = spark.createDataFrame([(1, "Curriculum Vitae\nKy nang: SQL"), (2, "nothing"), (3, None), (4, "my CV"), (5, "cvx")], "doc_id long, text string")
    got = {r.doc_id: (r.document_type, round(r.confidence, 4)) for r in classify.classify(docs).collect()}
    assert got == {1: ("CV", round(4 / 5.5, 4)), 2: ("UNKNOWN", 1.0), 3: ("UNKNOWN", 1.0), 4: ("CV", round(2 / 3.5, 4)), 5: ("UNKNOWN", 1.0)}


def test_template_tie_detects_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    rules = [("A", ["alpha"], 1), ("B", ["beta"], 1)]
    assert {r.doc_id: r.template for r in classify.detect_templates(docs, rules).collect()} == {1: None, 2: "A"}


def test_decision_table_has_no_default(spark):
    row = (1, "REVIEW_REQUIRED", False, False, False, False, True, 0.95, True)
    rows = spark.createDataFrame([row], "k int, status string, review boolean, sensitive boolean, critical boolean, inconsistent boolean, complete boolean, confidence double, auto boolean")
    assert quality.decide(rows).first().action is None
    assert quality.route(rows).first().action == "USER_REVIEW"


def test_lines_are_dense_and_null_has_none(spark):
    docs = spark.createDataFrame([(1, " a1 \n\n b"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.seq, r.text) for r in observe.lines(docs).orderBy("doc_id", "seq").collect()] == [(1, 0, "a1"), (1, 1, "b")]


def test_shared_tokens_is_a_multiset(spark):
    assert one(spark, t.shared_tokens(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "y", "y", "x", "x"]) == 3


def test_match_ratio_is_not_symmetric_in_general(spark):
    from difflib import SequenceMatcher

    a, b = "tide", "diet"
    assert one(spark, t.match_ratio(F.col("a"), F.col("b")), a=a, b=b) == SequenceMatcher(None, a, b).ratio()


def test_fuzzy_anti_equals_brute_force(spark):
    from difflib import SequenceMatcher

    left, right = ["alpha beta", "alpha bet", "gamma", "delta x"], ["alpha beta!", "gamme"]
    l, r = (spark.createDataFrame([(1, x) for x in xs], "g int, text string") for xs in (left, right))  # noqa: E741
    want = {x for x in left if not any(SequenceMatcher(None, y, x).ratio() >= 0.86 for y in right)}
    assert {x.text for x in matching.fuzzy_anti(l, r, "g", "text").collect()} == want


def test_row_clusters_follow_the_running_mean(spark):
    rows = spark.createDataFrame([(1, i, y) for i, y in enumerate([0.0, 3.0, 5.0, 20.0, 21.0])], "page long, box long, y double")
    got = [r.row for r in geometry.row_clusters(rows, "page", 4.0).orderBy("box").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_corrections_need_the_current_hash(spark, tmp_path):
    # Not in the order in which they were made: seq tells it.
    rows = [("c", 4, "h1", "h9"), ("c", 2, "h1", "h2"), ("c", 3, "h1", "h2"), ("c", 1, "", "h1")]
    spark.createDataFrame(rows, "case_id string, seq long, base_hash string, new_hash string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("case_id string, seq long, base_hash string, new_hash string").parquet(str(tmp_path / "in"))
    out = replay.collected(replay.corrections(stream), "append").collect()
    assert sorted((r.version, r.outcome) for r in out) == [(1, "ACCEPTED"), (2, "ACCEPTED"), (2, "CONFLICT"), (2, "REPLAY")]


def test_daily_totals_drop_late_rows(spark, tmp_path):
    for i, (day, n) in enumerate([("2024-01-01", 2), ("2024-01-20", 1), ("2024-01-21", 1), ("2024-01-01", 5)]):
        spark.sql(f"SELECT timestamp'{day} 10:00:00' AS ts, 'a' AS event_type, 1.0D AS value FROM range({n})").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    src = tmp_path / "src"
    src.mkdir()
    for i in range(4):
        next((tmp_path / f"in{i}").glob("part-*")).rename(src / f"{i}.parquet")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {r.day.isoformat()[:10]: r.events for r in replay.collected(replay.daily_totals(stream), "append").collect()}
    assert got == {"2024-01-01": 2}


def test_case_numbers_over_9999_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(governance, "cut", lambda df, cut=governance.cut: blocks.append(cut(df)) or blocks[-1])
    blocks = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    category = F.when(F.col("id") % 7 == 0, "b").when(F.col("id") % 11 != 0, "a")
    rows = spark.range(0, 25_000, 1, 5).select((F.col("id") * 7919 % 25_000).alias("k"), category.alias("c"))
    want = {c: 0 for c in ("a", "b", None)}
    try:
        got = governance.number_cases(rows, "c", "k").orderBy("k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 25_000 and blocks[0].where("c = 'a'").select("_range").distinct().count() > 1
    for r in got:
        want[r.c] += 1
        assert r.case_id == (r.c and f"{r.c}-{want[r.c]:04d}")
    assert want["a"] > 9999
