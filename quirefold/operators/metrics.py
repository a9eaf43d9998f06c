"""Evaluation: pairing, confusion metrics, field metrics, error rates, latency, gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.numbers import harmonic, rate
from quirefold.functions.text import casefold, collapse, composed, mark_count, without_vietnamese_marks, word_edits
from quirefold.operators.quantiles import nearest, order_statistics


def pairing(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """One row: how many keys pair, lack a side, or repeat; is_bijection says whether truth and prediction pair one to one."""
    t = truth.groupBy(key).agg(F.count("*").alias("t"))
    p = pred.groupBy(key).agg(F.count("*").alias("p"))
    both = t.join(p, key, "full_outer")
    out = both.agg(
        F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("matched"),
        F.count_if(F.col("p").isNull()).alias("missing_prediction"),
        F.count_if(F.col("t").isNull()).alias("missing_truth"),
        F.count_if((F.col("t") > 1) | (F.col("p") > 1)).alias("repeated"),
    )
    return out.withColumn("is_bijection", (F.col("missing_prediction") + F.col("missing_truth") + F.col("repeated")) == 0)


def class_report(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, support, predicted, true_positive, precision, recall, f1) over the union of the labels. F1 is of the rounded rates."""
    counts = pairs.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")),
    )).alias("x")).select("x.*")
    out = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("tp").alias("true_positive"))
    out = out.withColumns({"precision": rate(F.col("true_positive"), F.col("predicted")), "recall": rate(F.col("true_positive"), F.col("support"))})
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def class_macro(report: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """Means over the labels with support, and the rate of unknown predictions."""
    has = F.col("support") > 0
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(has, F.col(c))), 6), F.lit(0.0)).alias(f"macro_{c}")
    unknowns = F.sum(F.when(F.col("label") == unknown, F.col("predicted")).otherwise(0))
    return report.agg(F.sum("support").alias("cases"), mean("precision"), mean("recall"), mean("f1"), rate(F.coalesce(unknowns, F.lit(0)), F.sum("support")).alias("unknown_rate"))


def field_report(truth: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Field metrics by `by`: truth (case_id, name, value, sensitive, ...), pred (case_id, name, value, status).

    A field is exact if any of its predictions equals it; several predictions of a field count as predicted, once as exact.
    Predictions of fields that were not expected count as predicted alone, under the case's own `by` values.
    """
    t = truth.select("case_id", "name", "value", *[c for c in by if c != "name"])
    p = pred.groupBy("case_id", "name").agg(F.count("*").alias("n"), F.collect_set("value").alias("values"))
    known = t.join(p, ["case_id", "name"], "left").select(
        *by,
        F.lit(1).alias("expected"),
        F.coalesce("n", F.lit(0)).alias("predicted"),
        F.coalesce(F.array_contains("values", F.col("value")), F.lit(False)).cast("int").alias("exact"),
        F.col("n").isNull().cast("int").alias("not_found"),
    )
    extra = p.join(t.select("case_id", "name"), ["case_id", "name"], "left_anti")
    if rest := [c for c in by if c != "name"]:
        extra = extra.join(t.select("case_id", *rest).distinct(), "case_id")
    extra = extra.select(*by, F.lit(0).alias("expected"), F.col("n").alias("predicted"), F.lit(0).alias("exact"), F.lit(0).alias("not_found"))
    out = known.unionByName(extra).groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("expected", "predicted", "exact", "not_found")))
    return out.withColumns({"exact_match": rate(F.col("exact"), F.col("expected")), "precision": rate(F.col("exact"), F.col("predicted")), "recall": rate(F.col("exact"), F.col("expected"))})


def quality_rates(cases: DataFrame) -> DataFrame:
    """cases (expected_status, status, expected_review, review): false PASS, false REJECT, review rate and review precision."""
    n = F.count("*")
    return cases.agg(
        n.alias("cases"),
        rate(F.count_if((F.col("status") == "PASS") & (F.col("expected_status") != "PASS")), F.count_if(F.col("expected_status") != "PASS")).alias("false_pass_rate"),
        rate(F.count_if((F.col("status") == "REJECTED") & (F.col("expected_status") != "REJECTED")), F.count_if(F.col("expected_status") != "REJECTED")).alias("false_reject_rate"),
        rate(F.count_if("review"), n).alias("review_rate"),
        rate(F.count_if(F.col("review") & F.col("expected_review")), F.count_if("review")).alias("review_precision"),
    )


def sensitive_acceptance(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Number of sensitive fields that a prediction accepted, right or wrong."""
    names = truth.where("sensitive").select("case_id", "name").distinct()
    return pred.where("status = 'ACCEPTED'").select("case_id", "name").distinct().join(names, ["case_id", "name"], "left_semi").agg(F.count("*").alias("sensitive_accepted"))


def latency(rows: DataFrame, value: str, failed: Column, by: list[str] | None = None) -> DataFrame:
    """(by, cases, p50, p95, failure_rate): p50 and p95 by nearest rank. Values of a hot group are narrowed down, never gathered."""
    by = by or []
    sums = rows.groupBy(*by).agg(F.count("*").alias("cases"), rate(F.count_if(failed), F.count("*")).alias("failure_rate"))
    return with_ranks(sums, rows, by, value).select(*by, "cases", "p50", "p95", "failure_rate")


def with_ranks(sums: DataFrame, rows: DataFrame, by: list[str], value: str, digits: int = 3) -> DataFrame:
    """sums (by, ...), a row a group of rows, with samples, p50 and p95 by nearest rank; null where a group has no value."""
    found = order_statistics(rows, by, value, {"p50": nearest(0.5), "p95": nearest(0.95)})
    sides = [F.col(f"_{b}").eqNullSafe(F.col(b)) for b in by] or [F.lit(True)]  # without groups both have one row
    ranks = found.select(*(F.col(b).alias(f"_{b}") for b in by), "samples", *(F.bround(p, digits).alias(p) for p in ("p50", "p95")))
    return sums.join(ranks, reduce(lambda a, b: a & b, sides), "left").drop(*(f"_{b}" for b in by))


def text_errors(pairs: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] | None = None, words: bool = False, fold: Callable[[Column], Column] = collapse) -> DataFrame:
    """Exactness, character and diacritic error rates of text pairs; a missing prediction counts as all deletions.

    Spacing is folded first, or what `fold` says: the corpus rates fold nothing. The diacritic rate counts, row by row, the character edits that vanish when marks do.
    """
    t, p = fold(F.coalesce(F.col(truth), F.lit(""))), fold(F.coalesce(F.col(pred), F.lit("")))
    rows = pairs.select(*(by or []), t.alias("t"), p.alias("p"))
    rows = rows.withColumns(
        {
            "edits": F.levenshtein("t", "p"),
            "base_edits": F.levenshtein(without_vietnamese_marks(F.col("t")), without_vietnamese_marks(F.col("p"))),
            "marks": mark_count(F.col("t")),
            "chars": F.length("t"),
        }
    )
    if words:
        split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
        rows = rows.withColumns({"word_edits": word_edits(split("t"), split("p")), "words": F.size(split("t"))})
    aggs = [
        F.count("*").alias("cases"),
        rate(F.count_if(F.col("t") == F.col("p")), F.count("*")).alias("exact"),
        rate(F.count_if(casefold(F.col("t")) == casefold(F.col("p"))), F.count("*")).alias("exact_casefold"),
        rate(F.sum("edits"), F.sum("chars")).alias("cer"),
        rate(F.sum(F.greatest(F.lit(0), F.col("edits") - F.col("base_edits"))), F.sum("marks")).alias("der"),
    ]
    if words:
        aggs.append(rate(F.sum("word_edits"), F.sum("words")).alias("wer"))
    return rows.groupBy(*(by or [])).agg(*aggs)


#: Confidence from which a reading counts as accepted (fixed value).
ACCEPTED_FROM = 0.95


def recognition_report(pairs: DataFrame, by: list[str], threshold: float = ACCEPTED_FROM) -> DataFrame:
    """All counts and rates of recognized texts by `by`: pairs (by, truth, pred, confidence, duration).

    Texts are composed and their spacing folded; a missing prediction counts as empty. Predictions that were not composed are violations. Accepted are
    those of at least the threshold; percentiles of the durations are narrowed down, all else is one pass of sums.
    """
    c, n = F.col, F.count("*")
    fold = lambda x: collapse(composed(F.coalesce(x, F.lit(""))))
    rows = pairs.select(*by, fold(c("truth")).alias("t"), fold(c("pred")).alias("p"), (composed(c("pred")) != c("pred")).alias("loose"), (c("confidence") >= threshold).alias("sure"), c("duration").cast("double").alias("duration"))
    split = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    plain = lambda x: without_vietnamese_marks(c(x))
    rows = rows.withColumns({
        "exact": c("t") == c("p"), "chars": F.length("t"), "edits": F.levenshtein("t", "p"), "base": F.levenshtein(plain("t"), plain("p")), "marks": mark_count(c("t")), "words": F.size(split(c("t"))), "word_edits": word_edits(split(c("t")), split(c("p"))),
    })
    total = lambda x: F.sum(x).cast("long")
    sums = rows.groupBy(*by).agg(
        n.alias("cases"), F.count_if("exact").alias("exact"), total("chars").alias("chars"), total("edits").alias("char_errors"), total("words").alias("words"), total("word_edits").alias("word_errors"), total("marks").alias("marks"),
        total(F.greatest(F.lit(0), c("edits") - c("base"))).alias("mark_errors"), F.count_if("loose").alias("nfc_violations"), F.count_if("sure").alias("accepted"), F.count_if(c("sure") & c("exact")).alias("accepted_exact"),
    )
    rates = {"exact_rate": ("exact", "cases"), "cer": ("char_errors", "chars"), "wer": ("word_errors", "words"), "der": ("mark_errors", "marks"), "accepted_precision": ("accepted_exact", "accepted")}
    out = sums.withColumns({k: rate(c(a), c(b)) for k, (a, b) in rates.items()}).withColumn("threshold", F.lit(threshold))
    return with_ranks(out, rows, by, "duration").drop("samples")


def error_class(truth: Column, pred: Column) -> Column:
    """exact, empty, diacritic_only, else missing, extra or substitution by length."""
    t, p = collapse(F.coalesce(truth, F.lit(""))), collapse(F.coalesce(pred, F.lit("")))
    return (
        F.when(t == p, "exact").when(p == "", "empty")
        .when(without_vietnamese_marks(t) == without_vietnamese_marks(p), "diacritic_only")
        .when(F.length(p) < F.length(t), "missing").when(F.length(p) > F.length(t), "extra").otherwise("substitution")
    )
