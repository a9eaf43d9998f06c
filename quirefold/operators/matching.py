"""Matching of predicted and true field values, fuzzy anti join, regressions, thresholds, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.dates import date_key, duration_key
from quirefold.functions.numbers import plain_number, rate
from quirefold.functions.text import collapse, once, shared_tokens, tokens
from quirefold.operators.likeness import like_known


#: Least share of the true tokens for a soft match (fixed value).
SOFT = 0.8


def _pair(truth: Column, pred: Column) -> Column:
    """Both sides composed and collapsed, their tokens, and how many they share."""
    t, p = (collapse(F.coalesce(x, F.lit(""))) for x in (truth, pred))
    return once(
        F.struct(t.alias("t"), p.alias("p"), tokens(t).alias("a"), tokens(p).alias("b")),
        lambda x: F.struct(x["t"].alias("t"), x["p"].alias("p"), F.size(x["a"]).alias("n"), F.size(x["b"]).alias("m"), shared_tokens(x["a"], x["b"]).alias("shared")),
    )


def _part(n: Column, d: Column) -> Column:
    return n / F.greatest(F.lit(1), d)


def match_fields(truth: Column, pred: Column, soft: Column) -> Column:
    """struct<match_type, exact, matched, coverage, diagnosis>: equal text, else for soft fields equal but for case, or four fifths of the true tokens."""

    def of(x: Column) -> Column:
        cover = _part(x["shared"], x["n"])
        none, absent, fold = x["t"] == "", x["p"] == "", F.lower(x["t"]) == F.lower(x["p"])
        kind = (
            F.when(x["t"] == x["p"], "EXACT").when(none, "EXTRA_PREDICTION").when(absent, "NOT_FOUND").when(~soft, "MISMATCH")
            .when(fold, "CASE_INSENSITIVE").when(cover >= SOFT, "PARTIAL_80").otherwise("PARTIAL_BELOW_80")
        )
        why = F.element_at(F.create_map(*(F.lit(v) for kv in DIAGNOSES.items() for v in kv)), kind)
        full = kind.isin("EXACT", "CASE_INSENSITIVE")
        return F.struct(kind.alias("match_type"), (kind == "EXACT").alias("exact"), kind.isin("EXACT", "CASE_INSENSITIVE", "PARTIAL_80").alias("matched"), F.when(full, 1.0).when(kind.startswith("PARTIAL"), F.bround(cover, 6)).otherwise(0.0).alias("coverage"), why.alias("diagnosis"))

    return once(_pair(truth, pred), of)


#: Why a field does not match, by kind (fixed values).
DIAGNOSES = {"EXTRA_PREDICTION": "PREDICTION_FOR_ABSENT_FIELD", "NOT_FOUND": "OCR_NOT_RECOGNIZED", "MISMATCH": "OCR_RECOGNIZED_PARSER_MISSED", "PARTIAL_BELOW_80": "PARTIAL_TEXT_BELOW_80"}
#: Canonical forms and what they say of two texts that agree in them (fixed values).
CANONICAL = {"date": "DATE_FORMAT_ONLY", "duration": "DURATION_LABEL_ONLY", "decimal": "DECIMAL_FORMAT_ONLY", "tokens": "CASE_PUNCTUATION_LAYOUT_ONLY"}


def canonical_fields(truth: Column, pred: Column, form: Column, soft: Column) -> Column:
    """struct<match_type, exact, matched, coverage, precision, over_extraction, reason, diagnosis> by equal text, equal canonical form, or soft coverage.

    form names the field's canonical form (date, duration, decimal, tokens) or is null.
    """

    def of(x: Column) -> Column:
        keyed = lambda s: F.when(form == "date", date_key(s).cast("string")).when(form == "duration", duration_key(s)).when(form == "decimal", plain_number(s).cast("string")).when(form == "tokens", F.nullif(F.array_join(tokens(s), " "), F.lit("")))
        same = F.coalesce(keyed(x["t"]) == keyed(x["p"]), F.lit(False))
        cover, precision = F.bround(_part(x["shared"], x["n"]), 6), F.bround(_part(x["shared"], x["m"]), 6)
        kind = (
            F.when((x["t"] == "") & (x["p"] != ""), "EXTRA_PREDICTION").when(x["t"] == x["p"], "RAW_EXACT").when(x["p"] == "", "NOT_FOUND")
            .when(same, "CANONICAL_EXACT").when(soft & (cover >= SOFT), "ACCEPTED_PARTIAL").otherwise("MISMATCH")
        )
        compared = soft & kind.isin("ACCEPTED_PARTIAL", "MISMATCH")
        why = F.when(compared & (kind == "MISMATCH"), "PARTIAL_TEXT_BELOW_80").otherwise(F.element_at(F.create_map(*(F.lit(v) for kv in DIAGNOSES.items() for v in kv)), kind))
        return F.struct(
            kind.alias("match_type"), kind.isin("RAW_EXACT", "CANONICAL_EXACT").alias("exact"), kind.isin("RAW_EXACT", "CANONICAL_EXACT", "ACCEPTED_PARTIAL").alias("matched"),
            F.when(compared, cover).when(kind.isin("RAW_EXACT", "CANONICAL_EXACT") & (x["t"] != ""), 1.0).otherwise(0.0).alias("coverage"), F.when(compared, precision).alias("precision"),
            ((kind == "ACCEPTED_PARTIAL") & (precision < 1)).alias("over_extraction"), F.when(kind == "CANONICAL_EXACT", F.element_at(F.create_map(*(F.lit(v) for kv in CANONICAL.items() for v in kv)), form)).alias("reason"), why.alias("diagnosis"),
        )

    return once(_pair(truth, pred), of)


def compared_file(fields: DataFrame, by: list[str]) -> DataFrame:
    """(by, fields, compared, exact, accepted, mismatched, missing, unreviewed, decision) of fields (truth, pred, reviewed, form, soft).

    PASS needs every field reviewed and none wrong; without fields it is HOLD.
    """
    m = canonical_fields(F.col("truth"), F.col("pred"), F.col("form"), F.col("soft"))
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    status = (
        F.when(~F.col("reviewed"), "NEEDS_REVIEW").when(filled("truth") & ~filled("pred"), "MISSING")
        .when(F.col("m.exact"), "EXACT").when(F.col("m.matched"), "ACCEPTED").otherwise("MISMATCH")
    )
    rows = fields.withColumn("m", m).withColumn("s", status)
    n = lambda s: F.count_if(F.col("s") == s)
    good = (F.count("*") > 0) & (n("NEEDS_REVIEW") == 0) & (n("MISMATCH") + n("MISSING") == 0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("fields"), F.count_if(F.col("s") != "NEEDS_REVIEW").alias("compared"), n("EXACT").alias("exact"), n("ACCEPTED").alias("accepted"), n("MISMATCH").alias("mismatched"), n("MISSING").alias("missing"),
        n("NEEDS_REVIEW").alias("unreviewed"), F.when(good, "PASS").otherwise("HOLD").alias("decision"),
    )


def fuzzy_anti(rows: DataFrame, known: DataFrame, group: str, text: str, least: float = 0.86) -> DataFrame:
    """Rows whose text is like no known text of their group: the best match ratio is below `least`.

    Texts meet by rare q-grams that any pair of that ratio must share, so a large group costs no pair of all its texts. Null texts are like nothing.
    """
    return rows.join(like_known(rows, known, group, text, least), [group, text], "left_anti")


def merged_readings(native: DataFrame, scanned: DataFrame, group: str, text: str, least: float = 0.86) -> DataFrame:
    """All native rows of a page, and the recognized ones that are like none of them; source tells which is which."""
    new = fuzzy_anti(scanned, native, group, text, least)
    return native.withColumn("source", F.lit("native")).unionByName(new.select(*native.columns).withColumn("source", F.lit("ocr")))


def regressions(truth: DataFrame, base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys at which the baseline's value is exact and the candidate's is not."""
    j = truth.join(base.withColumnRenamed("value", "base_value"), keys).join(new.withColumnRenamed("value", "new_value"), keys)
    return j.where((F.col("base_value") == F.col("value")) & ~F.coalesce(F.col("new_value") == F.col("value"), F.lit(False))).select(*keys, "base_value", "new_value")


def thresholds(lines: DataFrame, choices: list[float], document: str = "document") -> DataFrame:
    """(document, threshold): for each document the threshold chosen on all the other documents.

    lines (document, confidence, base_exact, other_exact): below the threshold the other reading is used. Best is fewest
    losses, then most exact, then fewest switches, then the smaller threshold. The totals less a document's own sums stand for
    all the rest, so nothing is done twice.
    """
    each = lines.withColumn("threshold", F.explode(F.array(*map(F.lit, choices))))
    switch = F.col("confidence") < F.col("threshold")
    sums = each.groupBy(document, "threshold").agg(
        F.count_if(switch & F.col("base_exact") & ~F.col("other_exact")).alias("losses"),
        F.count_if(F.when(switch, F.col("other_exact")).otherwise(F.col("base_exact"))).alias("exact"),
        F.count_if(switch).alias("switches"),
    )
    totals = sums.groupBy("threshold").agg(*(F.sum(c).alias(f"all_{c}") for c in ("losses", "exact", "switches")))
    rest = sums.join(F.broadcast(totals), "threshold")  # one row a choice
    left = lambda c: F.col(f"all_{c}") - F.col(c)
    best = F.min(F.struct(left("losses").alias("losses"), (-left("exact")).alias("exact"), left("switches").alias("switches"), "threshold"))
    return rest.groupBy(document).agg(best["threshold"].alias("threshold"), (-best["exact"]).alias("rest_exact"))


def consensus(candidates: DataFrame, keys: list[str], folded: Column) -> DataFrame:
    """(keys, value, members, families, rule, accepted): the value on which at least two readers agree exactly, else without accents, else a sole one.

    candidates (keys, reader, family, value, confidence). Among values the one of most readers wins, then most families,
    then mean confidence, then the smaller value. It is accepted only if its readers come from two families.
    """
    rows = candidates.where("value IS NOT NULL AND value <> ''").withColumn("_fold", folded)
    exact = rows.groupBy(*keys, "_fold", "value").agg(F.collect_set("reader").alias("r"), F.collect_set("family").alias("f"), F.bround(F.avg("confidence"), 6).alias("confidence"))
    each = F.collect_list(F.struct("value", F.size("r").alias("members"), F.size("f").alias("families"), "confidence"))
    near = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    loose = exact.groupBy(*keys, "_fold").agg(each.alias("each"), near("r").alias("members"), near("f").alias("families"))

    def rank(v: Column) -> Column:
        """What comes first is least."""
        agreed = v["members"] >= 2
        level = F.when(agreed, 2).when(F.col("members") >= 2, 1).otherwise(0)
        members, families = (F.when(agreed, v[c]).otherwise(F.col(c)).cast("long") for c in ("members", "families"))
        return F.struct((-level).alias("level"), (-members).alias("members"), (-families).alias("families"), (-v["confidence"]).alias("confidence"), v["value"].alias("value"))

    top = loose.groupBy(*keys).agg(F.min(F.array_min(F.transform("each", rank))).alias("t"))
    rule = F.element_at(F.array(F.lit("SINGLE"), F.lit("FOLDED"), F.lit("EXACT")), 1 - F.col("t.level"))
    return top.select(*keys, "t.value", (-F.col("t.members")).alias("members"), (-F.col("t.families")).alias("families"), rule.alias("rule"), ((F.col("t.level") < 0) & (F.col("t.families") <= -2)).alias("accepted"))


def recover(baseline: DataFrame, agreed: DataFrame, keys: list[str]) -> DataFrame:
    """Fills only empty baseline values, and only from a value of two readers of two families; such a field still needs review."""
    a = agreed.where("members >= 2 AND families >= 2").select(*keys, F.col("value").alias("_v"))
    rows = baseline.join(a, keys, "left")
    empty = F.col("value").isNull() | (F.trim("value") == "")
    use = empty & F.col("_v").isNotNull()
    return rows.select(*keys, F.when(use, F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(use, "NEEDS_REVIEW").otherwise(F.col("status")).alias("status"), use.alias("recovered"))


def unique_or_null(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, conflict): the one distinct value (case folded) of a key, as first written; null and a conflict if there are several."""
    filled = F.trim(F.col(value)) != ""
    n = F.countDistinct(F.when(filled, F.lower(F.trim(F.col(value)))))
    first = F.min_by(F.when(filled, F.trim(F.col(value))), F.when(filled, F.col(order)))
    return rows.groupBy(key).agg(F.when(n == 1, first).alias("value"), (n > 1).alias("conflict"))


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, compared as text."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.col(value).cast("string")).alias("distinct_values")).where("distinct_values > 1")


def fold_votes(choices: DataFrame, threshold: str, count: str = "votes") -> DataFrame:
    """(threshold, votes): the choice that most documents made; of equals the smaller."""
    n = choices.groupBy(threshold).agg(F.count("*").alias(count))
    best = F.min(F.struct((-F.col(count)).alias("n"), F.col(threshold).alias("t")))
    return n.agg(best["t"].alias(threshold), (-best["n"]).alias(count))


def oracle(rows: DataFrame, left: str, right: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Two readers: how often either is right, how often they agree strictly and but for case, and how often the agreed text is right.

    Precision is over the agreements, at least one.
    """
    l, r, t = (collapse(F.coalesce(F.col(c), F.lit(""))) for c in (left, right, truth))  # noqa: E741
    rows = rows.select(*(by or []), l.alias("l"), r.alias("r"), t.alias("t"))
    filled = F.col("l") != ""
    strict, loose = filled & (F.col("l") == F.col("r")), filled & (F.lower("l") == F.lower("r"))
    some = lambda c: F.greatest(F.lit(1), F.count_if(c))
    part = lambda a, b: F.bround(F.count_if(a) / b, 6)
    n = F.greatest(F.lit(1), F.count("*"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), part((F.col("l") == F.col("t")) | (F.col("r") == F.col("t")), n).alias("oracle"), part(strict, n).alias("strict_agreement"), part(loose, n).alias("casefold_agreement"),
        part(strict & (F.col("l") == F.col("t")), some(strict)).alias("strict_precision"), part(loose & (F.lower("l") == F.lower("t")), some(loose)).alias("casefold_precision"),
    )


def agreement(rows: DataFrame, left: str, right: str, truth: str) -> DataFrame:
    """Coverage and precision of two readers' agreement on filled readings, and how often either is right."""
    filled = F.col(left) != ""
    same = filled & (F.col(left) == F.col(right))
    return rows.agg(
        F.count("*").alias("cases"),
        rate(F.count_if(same), F.count("*")).alias("agreement"),
        rate(F.count_if(same & (F.col(left) == F.col(truth))), F.count_if(same)).alias("agreement_precision"),
        rate(F.count_if((F.col(left) == F.col(truth)) | (F.col(right) == F.col(truth))), F.count("*")).alias("oracle"),
    )
