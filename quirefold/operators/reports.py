"""Reports and gates over evaluated fields and lines: one pass of conditional counts each, grouping sets where a report has levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import casefold, collapse, fold_key, mark_count, without_vietnamese_marks
from quirefold.operators.metrics import with_ranks


def share(n: Column, d: Column) -> Column:
    """n / max(1, d), six digits."""
    return F.bround(n / F.greatest(F.lit(1), d), 6)


def aggregate(fields: DataFrame, category: str = "category") -> DataFrame:
    """Field metrics by category, and in all with a null category.

    fields: one row a field of an included document: truth, pred, sensitive, scanned, and m, the struct that
    matching.canonical_fields gives.
    """
    filled = lambda c: collapse(F.coalesce(F.col(c), F.lit(""))) != ""
    m = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(False))
    n, has = F.count("*"), F.count_if
    applicable, found = has(filled("truth")), has(filled("truth") & filled("pred"))
    out = fields.groupingSets([[category], []], category).agg(
        n.alias("fields"), has(m("exact")).alias("exact"), share(has(m("exact")), n).alias("exact_rate"),
        has(F.col("m.match_type") == "RAW_EXACT").alias("raw_exact"), share(has(F.col("m.match_type") == "RAW_EXACT"), n).alias("raw_exact_rate"),
        has(m("matched")).alias("accepted"), share(has(m("matched")), n).alias("accepted_rate"), has(filled("pred")).alias("present"), share(has(filled("pred")), n).alias("presence_rate"),
        has("scanned").alias("scanned_fields"), has(F.col("scanned") & m("exact")).alias("scanned_exact"), share(has(F.col("scanned") & m("exact")), has("scanned")).alias("scanned_exact_rate"),
        applicable.alias("applicable"), found.alias("applicable_present"), share(found, applicable).alias("applicable_rate"),
        has(F.col("sensitive") & m("matched") & ~m("exact")).alias("sensitive_false_acceptance"), has(m("over_extraction")).alias("over_extracted"),
    )
    return out


def diagnoses(fields: DataFrame, category: str = "category") -> DataFrame:
    """(category, diagnosis, fields) of the fields that do not match; a field that native text lacks was missed by the parser."""
    why = F.when((F.col("m.diagnosis") == "OCR_NOT_RECOGNIZED") & ~F.col("scanned"), "PARSER_MISSED").otherwise(F.col("m.diagnosis"))
    rows = fields.select(category, why.alias("diagnosis")).where("diagnosis IS NOT NULL")
    return rows.groupingSets([[category, "diagnosis"], ["diagnosis"]], category, "diagnosis").agg(F.count("*").alias("fields"))


def document_counts(docs: DataFrame) -> DataFrame:
    """One row: documents (category, predicted, included, scanned, action); the accuracy's denominator counts the excluded ones too."""
    inc = F.col("included")
    scans = F.count_if(inc & F.col("scanned"))
    manual, auto = F.count_if(inc & F.col("scanned") & (F.col("action") == "MANUAL_REVIEW")), F.count_if(inc & F.col("scanned") & (F.col("action") == "AUTO_CONTINUE"))
    right = F.count_if(inc & (F.col("category") == F.col("predicted")))
    return docs.agg(
        F.count("*").alias("documents"), F.count_if(inc).alias("evaluated"), F.count_if(~inc).alias("excluded"), right.alias("classified"), share(right, F.count("*")).alias("accuracy"),
        scans.alias("scanned"), manual.alias("manual_reviews"), share(manual, scans).alias("manual_review_rate"), auto.alias("false_auto"), ((scans > 0) & (manual == scans) & (auto == 0)).alias("always_reviewed"),
    )


def by_profile(cases: DataFrame, predictions: str, truth: str) -> DataFrame:
    """One (profile, truth, pred) row for each reader of a case: its map of predictions spread out."""
    return cases.select(F.col(truth).alias("truth"), F.explode(predictions).alias("profile", "pred"))


def replay(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a policy's selection changes: lines (truth, primary, selected); a switch is a change but for case and spacing."""
    t, p, s = (collapse(F.coalesce(F.col(c), F.lit(""))) for c in ("truth", "primary", "selected"))
    rows = lines.select(*(by or []), t.alias("t"), p.alias("p"), s.alias("s"))
    moved = casefold(F.col("p")) != casefold(F.col("s"))
    was, now = F.col("p") == F.col("t"), F.col("s") == F.col("t")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("lines"), F.count_if(moved).alias("switches"), F.count_if(moved & ~was & now).alias("recovered"), F.count_if(moved & was & ~now).alias("lost"),
        F.count_if(was).alias("baseline_exact"), F.count_if(now).alias("selected_exact"),
    )


def document_changes(lines: DataFrame, document: str) -> DataFrame:
    """One row: documents with more, fewer and as many exact lines after the selection as before."""
    each = replay(lines, [document]).withColumn("gain", F.col("selected_exact") - F.col("baseline_exact"))
    return each.agg(F.count("*").alias("documents"), F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") < 0).alias("regressed"), F.count_if(F.col("gain") == 0).alias("unchanged"))


def field_error(expected: Column, predicted: Column, contaminated: Column, single: Column, rule: Column) -> Column:
    """What is wrong with a field, the first of eleven kinds that holds."""
    e, p = collapse(F.coalesce(expected, F.lit(""))), collapse(F.coalesce(predicted, F.lit("")))
    base, tight = fold_key, lambda x: F.replace(fold_key(x), F.lit(" "), F.lit(""))
    ce, cp = tight(e), tight(p)
    # Whether the prediction's letters stand in the expected text in order: each letter eats the text up to its next place.
    eaten = F.aggregate(F.filter(F.split(cp, ""), lambda c: c != ""), ce, lambda rest, c: F.when(F.instr(rest, c) > 0, F.substr(rest, F.instr(rest, c) + 1)))
    parts = lambda x: F.split(F.translate(x, "-.", "//"), "/")
    dated = rule.isin("valid_calendar_date", "expiry_after_birth") & (F.size(parts(e)) == 3) & (F.size(parts(p)) == 3)
    return (
        F.when(p == "", "not_found").when(e == p, "exact").when(base(e) == base(p), "diacritics_only").when(contaminated, "label_contamination").when(ce == cp, "line_merge_or_split")
        .when((F.length(cp) < F.length(ce)) & eaten.isNotNull(), "character_omission")
        .when(single & ((F.length(cp) < F.length(ce) * 0.55) | (F.length(cp) > F.length(ce) * 1.8)), "region_mismatch")
        .when(rule == "known_enum", "enum_confusion")
        .when(dated & (F.get(parts(e), F.lit(2)) != F.get(parts(p), F.lit(2))), "year_mismatch").when(dated, "date_component_mismatch").otherwise("character_substitution")
    )


def identity_fields(fields: DataFrame, field: str = "field") -> DataFrame:
    """Metrics by field, and in all with a null field: fields (truth, pred, status, sensitive, error); fields without a truth do not count."""
    rows = fields.where(collapse(F.coalesce(F.col("truth"), F.lit(""))) != "")
    n, has, is_ = F.count("*"), F.count_if, lambda e: F.col("error") == e
    accepted = F.col("status") == "accepted"
    ascii_equal = fold_key(F.coalesce(F.col("truth"), F.lit(""))) == fold_key(F.coalesce(F.col("pred"), F.lit("")))
    return rows.groupingSets([[field], []], field).agg(
        n.alias("evaluated"), share(has(is_("exact")), n).alias("exact"), share(has(ascii_equal), n).alias("ascii_exact"), share(has(is_("character_omission")), n).alias("omission"), share(has(~is_("not_found")), n).alias("presence"),
        share(has(accepted & is_("exact")), has(accepted)).alias("accepted_precision"), share(has(accepted), n).alias("accepted_coverage"),
        share(has(~F.col("error").isin("region_mismatch", "label_contamination", "not_found")), n).alias("region"), has(F.col("sensitive") & accepted & ~is_("exact")).alias("sensitive_false"),
    )


def candidate_oracle(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidates, strict, ascii): how many of the readers' values (truth, value) equal the truth, and without accents."""
    return candidates.groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(F.col("value") == F.col("truth")).alias("strict"), F.count_if(fold_key(F.col("value")) == fold_key(F.col("truth"))).alias("ascii"))


def family_report(docs: DataFrame, fields: DataFrame, cells: DataFrame, family: str = "family") -> DataFrame:
    """One row a family and one in all (null): classification, fields, completeness and tables.

    docs (document, family, subtype_right, family_right, completeness), fields (family, truth, pred), cells (document, family,
    row, column, truth, pred): the rows of all families are pooled again for the whole, it is no mean of families.
    """
    sets = lambda df: df.groupingSets([[family], []], family)
    n = F.count("*")
    d = sets(docs).agg(n.alias("documents"), share(F.count_if("subtype_right"), n).alias("subtype_accuracy"), share(F.count_if("family_right"), n).alias("family_accuracy"), F.bround(F.avg("completeness"), 6).alias("completeness"))
    t, p = (collapse(F.coalesce(F.col(c), F.lit(""))) for c in ("truth", "pred"))
    lines = fields.select(family, t.alias("t"), p.alias("p"))
    edits = F.levenshtein("t", "p")
    base = F.levenshtein(without_vietnamese_marks(F.col("t")), without_vietnamese_marks(F.col("p")))
    part = lambda a, b: F.coalesce(F.bround(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6), F.lit(0.0))
    f = sets(lines).agg(n.alias("fields"), F.count_if(F.col("t") == F.col("p")).alias("exact"), share(F.count_if(F.col("t") == F.col("p")), n).alias("exact_rate"), part(edits, F.length("t")).alias("cer"), part(F.greatest(F.lit(0), edits - base), mark_count(F.col("t"))).alias("der"))
    hit = t == p
    rows = cells.select("document", family, "row", hit.alias("hit")).groupBy("document", family, "row").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    c = sets(rows).agg(n.alias("table_rows"), share(F.count_if(F.col("n") == F.col("k")), n).alias("row_accuracy"), F.sum("n").alias("table_cells"), F.bround(F.sum("k") / F.greatest(F.lit(1), F.sum("n")), 6).alias("cell_accuracy"))
    out = d
    for other in (f, c):
        right = other.withColumnRenamed(family, "_f")
        out = out.join(right, F.col(family).eqNullSafe(F.col("_f")), "left").drop("_f")
    return out


def page_errors(pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, cer) of pages (truth, pred): edits over max(1, length), so an empty truth gives the number of edits."""
    t, p = F.coalesce(F.col("truth"), F.lit("")), F.coalesce(F.col("pred"), F.lit(""))
    return pages.select(*by, F.bround(F.levenshtein(t, p) / F.greatest(F.lit(1), F.length(t)), 6).alias("cer"))


def order_accuracy(cases: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Share of cases whose lines are the true ones in the true order; cases without true lines do not count."""
    rows = cases.where(F.size(truth) > 0)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("cases"), share(F.count_if(F.col(truth) == F.col(pred)), F.count("*")).alias("reading_order"))


def recovery(fields: DataFrame, by: list[str]) -> DataFrame:
    """Per field: how many baselines were empty or unsafe, how many a candidate replaced, and how many of those are right."""
    need = (F.coalesce(F.trim("baseline"), F.lit("")) == "") | F.col("unsafe")
    used = F.coalesce(F.col("final") != F.col("baseline"), F.col("final").isNotNull())
    return fields.groupBy(*by).agg(F.count("*").alias("fields"), F.count_if(need).alias("eligible"), F.count_if(used).alias("recovered"), F.count_if(used & (F.col("final") == F.col("truth"))).alias("right"), F.count_if(used & (F.col("baseline") == F.col("truth"))).alias("lost"))


def review_progress(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, total, pending, confirmed, skipped, complete)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return cases.groupBy(*(by or [])).agg(F.count("*").alias("total"), n("PENDING_REVIEW").alias("pending"), n("CONFIRMED").alias("confirmed"), n("SKIPPED").alias("skipped"), (n("PENDING_REVIEW") == 0).alias("complete"))


def reference(*keys: Column, size: int = 16) -> Column:
    """A reference that tells nothing of its keys: the first signs of their joined digest."""
    return F.substring(F.sha2(F.concat_ws(":", *keys), 256), 1, size)


def shadow_review(rows: DataFrame, by: list[str], key: str, payload: str) -> DataFrame:
    """(by, rows, duplicate_references, idempotency_mismatches): references that occur again, and those that occur with another payload."""
    each = rows.groupBy(*by, key).agg(F.count("*").alias("n"), F.countDistinct(payload).alias("p"))
    return each.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_references"), F.count_if(F.col("p") > 1).alias("idempotency_mismatches"))


def dashboard(prepared: DataFrame, processed: DataFrame, category: str = "category") -> DataFrame:
    """(category, prepared, processed, ready, review) over the categories of both."""
    a = prepared.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("prepared"))
    b = processed.groupBy(category).agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "READY").alias("ready"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("review"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, F.col("_c") == F.col(category), "full_outer").select(F.coalesce("_c", category).alias(category), *(zero(c) for c in ("prepared", "processed", "ready", "review")))


def confidences(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, least, status): the mean and the least confidence of lines with one, null without; a document is as sure as its least line."""
    least = F.min("confidence")
    return lines.groupBy(*by).agg(F.bround(F.avg("confidence"), 4).alias("mean"), least.alias("least"), F.when(least.isNull(), "NO_TEXT").when(least < 0.85, "NEEDS_REVIEW").otherwise("COMPLETED").alias("status"))


def stage_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, samples, p50, p95) by nearest rank; nulls do not count."""
    return with_ranks(samples.select(*by).distinct(), samples, by, value).select(*by, F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), "p50", "p95")


# --- gates -----------------------------------------------------------------------------------------------------


def checked(rows: DataFrame, checks: dict[str, Column], good: str = "PASS", bad: str = "HOLD", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, code, passed, status): one row a check, in all its fate the row's status: good if all pass. A check without a value fails."""
    each = F.array(*(F.struct(F.lit(k).alias("code"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()))
    status = F.when(F.forall("_each", lambda c: c["passed"]), good).otherwise(bad)
    return rows.withColumn("_each", each).withColumn("status", status).select(*keys, F.explode("_each").alias("c"), "status").select(*keys, "c.*", "status")


#: A challenger's policy (fixed values).
PROMOTION = {"improvement": 0.01, "p95_ms": 5000.0, "review_increase": 0.02, "failure_rate": 0.01, "pages": 30, "ocr_cases": 1}


def promotion_checks(b: dict[str, Column], c: dict[str, Column], dataset: dict[str, Column], evidence: dict[str, Column], policy: dict[str, float] = PROMOTION) -> dict[str, Column]:
    """All checks of a challenger's metrics c against the baseline's b, in order."""
    return {
        "DATASET_AUTHORIZATION_ACTIVE": authorized(dataset["status"], dataset["approved_at"], dataset["retention_until"], dataset["as_of"]),
        "MINIMUM_BENCHMARK_PAGES": dataset["pages"] >= policy["pages"],
        "FIELD_EXACT_MATCH_IMPROVEMENT": c["exact_match"] - b["exact_match"] >= policy["improvement"],
        "MINIMUM_OCR_CASES": c["ocr_cases"] >= policy["ocr_cases"],
        "OCR_CER_NON_REGRESSION": c["cer"] <= b["cer"],
        "OCR_WER_NON_REGRESSION": c["wer"] <= b["wer"],
        "READING_ORDER_NON_REGRESSION": c["reading_order"] >= b["reading_order"],
        "NO_SENSITIVE_FALSE_ACCEPTANCE_INCREASE": c["sensitive_false"] <= b["sensitive_false"],
        "NO_FALSE_PASS_INCREASE": c["false_pass_rate"] <= b["false_pass_rate"],
        "LATENCY_SLO": c["p95"] <= policy["p95_ms"],
        "REVIEW_EFFORT": c["review_rate"] <= b["review_rate"] + policy["review_increase"],
        "FAILURE_RATE": c["failure_rate"] <= policy["failure_rate"],
        "CONTRACT_REGRESSION": evidence["contract_tests"],
        "PRIVACY_APPROVAL": evidence["privacy"],
        "LICENSE_APPROVAL": evidence["license"],
        "MODEL_PROVENANCE_APPROVAL": evidence["provenance"],
    }


def authorized(status: Column, approved_at: Column, retention_until: Column, as_of: Column) -> Column:
    return (status == "APPROVED") & as_of.between(approved_at, retention_until)


def data_gate(m: dict[str, Column], families: dict[str, Column]) -> dict[str, Column]:
    """Checks of an aggregate report before its data may be used: m by metric, families by their exact rate."""
    every = F.lit(True)
    for rate in families.values():
        every &= F.coalesce(rate, F.lit(0.0)) >= 0.8
    return {
        "strictOverallAtLeast80": m["exact_rate"] >= 0.8,
        "strictEachFamilyAtLeast80": every,
        "applicableCompletenessAtLeast95": (m["applicable"] > 0) & (m["applicable_rate"] >= 0.95),
        "classificationAtLeast95": m["accuracy"] >= 0.95,
        "schemaErrorsZero": m["schema_errors"] == 0,
        "sensitiveFalseAcceptanceZero": m["sensitive_false"] == 0,
        "parserCorrectRegressionZero": m["regressions"] == 0,
        "scanAlwaysManualReview": m["always_reviewed"],
        "falseAutoContinueZero": m["false_auto"] == 0,
    }


def identity_gates(b: dict[str, Column], a: dict[str, Column], counts: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """(development, readiness) checks of an identity reader's metrics a against b."""
    development = {
        "schemaErrorsZero": counts["schema_errors"] == 0,
        "noExactRegression": counts["regressions"] == 0,
        "targetImprovement": counts["improvements"] >= 1,
        "exactNotWorse": a["exact"] >= b["exact"],
        "asciiNotWorse": a["ascii_exact"] >= b["ascii_exact"],
        "cerNotWorse": a["cer"] <= b["cer"],
        "derNotWorse": a["der"] <= b["der"],
        "presenceNotWorse": a["presence"] >= b["presence"],
        "manualReviewOnly": counts["manual_only"],
        "protectedFieldsPreserved": counts["protected_regressions"] == 0,
    }
    readiness = {
        "fullNameAsciiExactMatch": a["name_ascii"] >= 0.9,
        "addressAsciiExactMatch": a["address_ascii"] >= 0.85,
        "fieldPresence": a["presence"] >= 0.95,
        "noSensitiveFalseAcceptance": a["sensitive_false"] == 0,
        "noExactRegression": counts["regressions"] == 0,
        "acceptedPrecision": (a["accepted_coverage"] == 0) | F.coalesce(a["accepted_precision"] == 1, F.lit(True)),
        "protectedFieldsPreserved": counts["protected_regressions"] == 0,
    }
    return development, readiness


def format_gates(formats: DataFrame, least: float = 0.8) -> DataFrame:
    """(format, code, passed, status) of formats (format, available, processed, technical_errors, unsupported, classified, exact_rate, schema_errors, false_auto, manual_reviews).

    Native formats must be exact, scanned ones reach `least` and always be reviewed.
    """
    c, scan = F.col, F.col("format").isin("image", "scan_pdf")
    return checked(formats, {
        "all_available_processed": (c("available") > 0) & (c("processed") == c("available")) & (c("technical_errors") == 0) & (c("unsupported") == 0),
        "classification": c("classified") == c("processed"),
        "required_field_em": c("exact_rate") >= F.when(scan, least).otherwise(1.0),
        "schema": c("schema_errors") == 0,
        "no_false_auto_continue": c("false_auto") == 0,
        "review_routing": ~scan | (c("manual_reviews") == c("processed")),
    }, keys=("format",))


def blinded_problems(hidden: Column, has_truth: Column, confirmed: Column, same_queue: Column, same_dataset: Column, unmatched: Column, pending: Column, empty: Column, profiles_missing: Column) -> Column:
    """What forbids a blinded evaluation, in order; empty if nothing does."""
    rules = [
        (~hidden, "SNAPSHOT_NOT_BLINDED"), (has_truth, "SNAPSHOT_CONTAINS_GROUND_TRUTH"), (~confirmed, "CONFIRMATION_INCOMPLETE"), (~same_queue, "QUEUE_DIGESTS_DIFFER"), (~same_dataset, "DATASETS_DIFFER"),
        (unmatched > 0, "CASE_IDS_DO_NOT_MATCH"), (pending > 0, "REVIEW_NOT_COMPLETE"), (empty > 0, "CONFIRMED_LINE_EMPTY"), (profiles_missing > 0, "PROFILE_MISSING"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), code) for c, code in rules)))


def blinded_decision(documents: Column, least: int, lost: Column, exact_before: Column, exact_after: Column, der_before: Column, der_after: Column) -> Column:
    """struct<signals, sample, pilot>: a pilot needs enough documents and no signal against it; production is never granted."""
    good = (lost == 0) & (exact_after >= exact_before) & (der_after <= der_before)
    enough = documents >= least
    pilot = F.when(~enough, "NOT_PROMOTED_INSUFFICIENT_DOCUMENTS").when(good, "ELIGIBLE_FOR_CONTROLLED_PILOT").otherwise("NOT_PROMOTED")
    return F.struct(F.when(good, "QUALITY_SIGNALS_PASS").otherwise("QUALITY_SIGNALS_FAIL").alias("signals"), F.when(enough, "PASS").otherwise("INSUFFICIENT_DOCUMENTS").alias("sample"), pilot.alias("pilot"))


def manifest_problems(templates: DataFrame, key: str = "template_id") -> DataFrame:
    """Adds problems to templates (template_id, version, schema_ref, anchors, minimum, required, optional, digest): several rows of an id and version, a minimum that no text can reach, fields that are both required and optional."""
    same = F.count("*").over(Window.partitionBy(key, "version")) > 1
    rules = [
        (same, "DUPLICATE_VERSION"), (~F.col("version").rlike(r"^\d+\.\d+(\.\d+)?$"), "VERSION_NOT_SEMANTIC"), (F.coalesce(F.col("schema_ref"), F.lit("")) == "", "SCHEMA_MISSING"),
        ((F.col("minimum") < 1) | (F.col("minimum") > F.size("anchors")), "MINIMUM_OUT_OF_RANGE"), (F.size(F.array_distinct("anchors")) < F.size("anchors"), "ANCHOR_REPEATED"),
        (F.size(F.array_intersect("required", "optional")) > 0, "FIELD_REQUIRED_AND_OPTIONAL"), (~F.col("digest").rlike("^sha256:[0-9a-f]{64}$"), "DIGEST_MALFORMED"),
    ]
    return templates.withColumn("problems", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), code) for c, code in rules))))


def seal_problems(confirmed_by_user: Column, already_sealed: Column, open_fields: Column, locked: Column, current: Column) -> Column:
    """What forbids sealing a reviewed dataset; empty if nothing does."""
    rules = [(~confirmed_by_user, "CONFIRMATION_REQUIRED"), (already_sealed, "ALREADY_SEALED"), (open_fields > 0, "REVIEW_INCOMPLETE"), (locked != current, "LOCK_HASH_MISMATCH")]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), code) for c, code in rules)))


#: Least improvement of the scanned fields for a fallback (fixed value).
FALLBACK_GAIN = 0.1


def data_decisions(fields: DataFrame, by: list[str], families: list[str], fallback: bool = True) -> DataFrame:
    """(by, code, passed, decision, fallback, gain): the thirteen checks of each evaluation, its decision, and whether its candidate may stand in for the baseline on scans.

    fields (by, family, truth, pred, base, scan, sensitive, accepted, review, auto, readable, typed, broken): one row a field of the evaluation set; base is the baseline's value,
    null where it was not run. Every check is a sum over the rows of an evaluation, so a large one is added up before any shuffle. An evaluation without scans has a
    scan rate of 0; a family without fields fails its check. With fallback the decision also asks for the fallback's own conditions.
    """
    c, n = F.col, F.count("*")
    exact, right = c("pred").eqNullSafe(c("truth")), c("base").eqNullSafe(c("truth"))
    part = lambda x, y: F.coalesce(F.count_if(x) / F.nullif(F.count_if(y), F.lit(0)), F.lit(0.0))
    filled = lambda x: F.coalesce(c(x), F.lit("")) != ""
    own = [part(exact & (c("family") == f), c("family") == f) >= 0.8 for f in families]
    scanned = F.count_if(c("scan"))
    m = fields.groupBy(*by).agg(
        (F.count_if(exact) / n).alias("exact"), F.least(*(x.cast("int") for x in own)).alias("families"), F.count_if(filled("truth")).alias("applicable"), part(filled("truth") & filled("pred"), filled("truth")).alias("complete"), (F.count_if("typed") / n).alias("accuracy"),
        F.count_if("broken").alias("schema_errors"), F.count_if(c("sensitive") & c("accepted") & ~exact).alias("sensitive_false"), F.count_if(right & ~exact & c("base").isNotNull()).alias("regressions"), F.count_if(c("base").isNull()).alias("without_base"),
        F.count_if(c("scan") & ~c("review")).alias("unreviewed"), F.count_if(c("scan") & c("auto")).alias("false_auto"), F.count_if(c("scan") & ~c("readable")).alias("unreadable"), F.count("accepted").alias("reported"),
        part(exact & c("scan"), c("scan")).alias("scan_exact"), part(right & c("scan") & c("base").isNotNull(), c("scan")).alias("scan_base"), F.count_if(c("scan") & right & ~exact & c("base").isNotNull()).alias("scan_regressions"), F.count_if(c("scan") & c("base").isNull()).alias("scan_without_base"), scanned.alias("scans"), n.alias("n"),
    )
    checks = {
        "strictOverallAtLeast80": c("exact") >= 0.8, "strictEachFamilyAtLeast80": c("families") == 1, "applicableCompletenessAtLeast95": (c("applicable") > 0) & (c("complete") >= 0.95), "classificationAtLeast95": c("accuracy") >= 0.95,
        "schemaErrorsZero": c("schema_errors") == 0, "sensitiveFalseAcceptanceZero": c("sensitive_false") == 0, "parserCorrectRegressionZero": c("regressions") == 0, "parserRegressionComparisonReady": c("without_base") == 0, "scanAlwaysManualReview": c("unreviewed") == 0,
        "falseAutoContinueZero": c("false_auto") == 0, "unsupportedOcrZero": c("unreadable") == 0, "acceptedTextReportedSeparately": c("reported") == c("n"), "semanticMetricNotUsedAsStrictGate": F.lit(True),
    }
    gain = F.when(c("scan_without_base") == 0, F.bround(c("scan_exact") - c("scan_base"), 6))
    stands = F.coalesce((gain >= FALLBACK_GAIN) & (c("scan_regressions") == 0) & (c("schema_errors") == 0) & (c("unreviewed") == 0) & (c("false_auto") == 0) & (c("scans") > 0), F.lit(False))
    passed = F.array(*(F.struct(F.lit(k).alias("code"), v.alias("passed")) for k, v in checks.items()))
    rows = m.select(*by, passed.alias("checks"), gain.alias("gain"), (stands if fallback else F.lit(None).cast("boolean")).alias("stands"))
    good = F.forall("checks", lambda x: x["passed"]) & (F.coalesce("stands", F.lit(True)))
    state = F.when(F.col("stands").isNull(), "NOT_EVALUATED").when(F.col("stands"), "PASS").otherwise("HOLD")
    each = rows.select(*by, F.explode("checks").alias("c"), F.when(good, "PASS").otherwise("HOLD").alias("decision"), state.alias("fallback"), "gain")
    return each.select(*by, "c.code", "c.passed", "decision", "fallback", "gain")
