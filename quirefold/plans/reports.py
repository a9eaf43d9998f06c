"""Queries over reports and gates. Truth and readings are columns of the star schema and fixed functions of their keys."""

from pyspark.sql import functions as F

from quirefold.operators import matching, metrics, quantiles, reports
from quirefold.plans.evaluation import PAIRS, name_pairs
from quirefold.plans.registry import query, table

KEY = "p_partkey"


def fields(spark, sf_dir):
    """Part names as fields of documents, some of them scanned or sensitive; every fifth is a soft field."""
    k = F.col(KEY)
    rows = name_pairs(spark, sf_dir).withColumns({"category": F.concat(F.lit("C"), (k % 3).cast("string")), "scanned": k % 2 == 0, "sensitive": k % 4 == 0})
    rows = rows.withColumn("truth", F.when(k % 13 == 0, "").otherwise(F.col("truth")))
    return rows.withColumn("m", matching.canonical_fields(F.col("truth"), F.col("pred"), F.when(k % 7 == 0, "tokens"), k % 5 == 0))


FIELDS = f"""p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE truth END AS truth, coalesce(pred, '') AS pred, 'C' || p_partkey % 3 AS category, p_partkey % 2 = 0 AS scanned, p_partkey % 4 = 0 AS sensitive, p_partkey % 5 = 0 AS soft, p_partkey % 7 = 0 AS tok FROM ({PAIRS})),
q AS (SELECT *, list_filter(string_split_regex(lower(truth), '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(pred), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM p),
w AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS shared FROM q),
m AS (SELECT *, CASE WHEN truth = '' AND pred <> '' THEN 'EXTRA_PREDICTION' WHEN truth = pred THEN 'RAW_EXACT' WHEN pred = '' THEN 'NOT_FOUND' WHEN tok AND len(a) > 0 AND a = b THEN 'CANONICAL_EXACT' WHEN soft AND round_even(shared / greatest(1, len(a))::DOUBLE, 6) >= 0.8 THEN 'ACCEPTED_PARTIAL' ELSE 'MISMATCH' END AS kind, shared / greatest(1, len(b))::DOUBLE AS prec FROM w),
f AS (SELECT *, kind IN ('RAW_EXACT', 'CANONICAL_EXACT') AS exact, kind IN ('RAW_EXACT', 'CANONICAL_EXACT', 'ACCEPTED_PARTIAL') AS matched, kind = 'ACCEPTED_PARTIAL' AND round_even(prec, 6) < 1 AS over,
  CASE WHEN kind = 'EXTRA_PREDICTION' THEN 'PREDICTION_FOR_ABSENT_FIELD' WHEN kind = 'NOT_FOUND' THEN CASE WHEN scanned THEN 'OCR_NOT_RECOGNIZED' ELSE 'PARSER_MISSED' END WHEN kind = 'MISMATCH' THEN CASE WHEN soft THEN 'PARTIAL_TEXT_BELOW_80' ELSE 'OCR_RECOGNIZED_PARSER_MISSED' END END AS why FROM m)"""
_n = lambda c: f"count(*) FILTER ({c})"
_share = lambda c, d="count(*)": f"round_even({_n(c)} / greatest(1, {d})::DOUBLE, 6)"


@query(
    f"""WITH {FIELDS} SELECT category, count(*) AS fields, {_n('exact')} AS exact, {_share('exact')} AS exact_rate, {_n("kind = 'RAW_EXACT'")} AS raw_exact, {_share("kind = 'RAW_EXACT'")} AS raw_exact_rate, {_n('matched')} AS accepted, {_share('matched')} AS accepted_rate, {_n("pred <> ''")} AS present, {_share("pred <> ''")} AS presence_rate,
 {_n('scanned')} AS scanned_fields, {_n('scanned AND exact')} AS scanned_exact, {_share('scanned AND exact', _n('scanned'))} AS scanned_exact_rate, {_n("truth <> ''")} AS applicable, {_n("truth <> '' AND pred <> ''")} AS applicable_present, {_share("truth <> '' AND pred <> ''", _n("truth <> ''"))} AS applicable_rate,
 {_n('sensitive AND matched AND NOT exact')} AS sensitive_false_acceptance, {_n('over')} AS over_extracted FROM f GROUP BY GROUPING SETS ((category), ())"""
)
def field_report(spark, sf_dir):
    return reports.aggregate(fields(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT category, why AS diagnosis, count(*) AS fields FROM f WHERE why IS NOT NULL GROUP BY GROUPING SETS ((category, why), (why))")
def diagnosis_counts(spark, sf_dir):
    return reports.diagnoses(fields(spark, sf_dir))


def documents(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.when(o % 9 == 0, "OTHER").otherwise(F.col("o_orderpriority")).alias("predicted"), (o % 17 != 0).alias("included"), (o % 3 == 0).alias("scanned"), F.when(o % 6 == 0, "MANUAL_REVIEW").when(o % 33 == 0, "AUTO_CONTINUE").otherwise("USER_REVIEW").alias("action"))


@query(
    f"""WITH d AS (SELECT o_orderkey % 9 <> 0 AS good, o_orderkey % 17 <> 0 AS inc, o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 AS s, CASE WHEN o_orderkey % 6 = 0 THEN 'M' WHEN o_orderkey % 33 = 0 THEN 'A' END AS act FROM orders)
SELECT count(*) AS documents, {_n('inc')} AS evaluated, {_n('NOT inc')} AS excluded, {_n('inc AND good')} AS classified, {_share('inc AND good')} AS accuracy, {_n('s')} AS scanned, {_n("s AND act = 'M'")} AS manual_reviews, {_share("s AND act = 'M'", _n('s'))} AS manual_review_rate, {_n("s AND act = 'A'")} AS false_auto,
 ({_n('s')} > 0 AND {_n("s AND act = 'M'")} = {_n('s')} AND {_n("s AND act = 'A'")} = 0) AS always_reviewed FROM d"""
)
def document_report(spark, sf_dir):
    return reports.document_counts(documents(spark, sf_dir))


def readings(spark, sf_dir):
    """Three readers' texts of each part name, and a policy's choice among them."""
    k = F.col(KEY)
    rows = name_pairs(spark, sf_dir)
    second = F.when(k % 4 == 0, F.col("truth")).otherwise(F.lower("truth"))
    return rows.withColumns({"primary": F.coalesce("pred", F.lit("")), "second": second, "selected": F.when(k % 6 == 0, second).otherwise(F.coalesce("pred", F.lit("")))})


READINGS = f"(SELECT p_partkey, p_brand, truth, coalesce(pred, '') AS prim, CASE WHEN p_partkey % 4 = 0 THEN truth ELSE lower(truth) END AS second, CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN truth ELSE lower(truth) END ELSE coalesce(pred, '') END AS sel FROM ({PAIRS}))"


@query(
    f"""WITH x AS (SELECT profile, truth, pred FROM (SELECT truth, unnest(['primary', 'second']) AS profile, unnest([prim, second]) AS pred FROM {READINGS}))
SELECT profile, count(*) AS cases, round_even({_n('truth = pred')} / count(*)::DOUBLE, 6) AS exact, round_even({_n('lower(truth) = lower(pred)')} / count(*)::DOUBLE, 6) AS exact_casefold, round_even(sum(levenshtein(truth, pred)) / sum(length(truth))::DOUBLE, 6) AS cer, 0::DOUBLE AS der FROM x GROUP BY profile"""
)
def profile_metrics(spark, sf_dir):
    spread = reports.by_profile(readings(spark, sf_dir).withColumn("readers", F.create_map(F.lit("primary"), F.col("primary"), F.lit("second"), F.col("second"))), "readers", "truth")
    return metrics.text_errors(spread, by=["profile"])


_MOVED = "lower(prim) <> lower(sel)"


@query(f"SELECT p_brand, count(*) AS lines, {_n(_MOVED)} AS switches, {_n(_MOVED + ' AND prim <> truth AND sel = truth')} AS recovered, {_n(_MOVED + ' AND prim = truth AND sel <> truth')} AS lost, {_n('prim = truth')} AS baseline_exact, {_n('sel = truth')} AS selected_exact FROM {READINGS} GROUP BY p_brand")
def policy_replay(spark, sf_dir):
    return reports.replay(readings(spark, sf_dir), ["p_brand"])


@query(f"WITH g AS (SELECT p_brand, {_n('sel = truth')} - {_n('prim = truth')} AS gain FROM {READINGS} GROUP BY p_brand) SELECT count(*) AS documents, {_n('gain > 0')} AS improved, {_n('gain < 0')} AS regressed, {_n('gain = 0')} AS unchanged FROM g")
def document_changes(spark, sf_dir):
    return reports.document_changes(readings(spark, sf_dir), "p_brand")


@query(
    f"""SELECT p_brand, count(*) AS cases, {_share('prim = truth OR second = truth')} AS oracle, {_share("prim <> '' AND prim = second")} AS strict_agreement, {_share("prim <> '' AND lower(prim) = lower(second)")} AS casefold_agreement,
 {_share("prim <> '' AND prim = second AND prim = truth", _n("prim <> '' AND prim = second"))} AS strict_precision, {_share("prim <> '' AND lower(prim) = lower(second) AND lower(prim) = lower(truth)", _n("prim <> '' AND lower(prim) = lower(second)"))} AS casefold_precision FROM {READINGS} GROUP BY p_brand"""
)
def reader_oracle(spark, sf_dir):
    return matching.oracle(readings(spark, sf_dir), "primary", "second", "truth", ["p_brand"])


@query("SELECT threshold, votes FROM (SELECT l_discount AS threshold, count(*) AS votes FROM lineitem GROUP BY 1 ORDER BY votes DESC, threshold LIMIT 1)")
def fold_votes(spark, sf_dir):
    return matching.fold_votes(table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("threshold")), "threshold")


_BASE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
ERRORS = f"""e AS (SELECT p_partkey, p_brand, truth, coalesce(pred, '') AS pred, {_BASE.format('truth')} AS bt, {_BASE.format("coalesce(pred, '')")} AS bp, p_partkey % 9 = 0 AS dirty, p_partkey % 2 = 0 AS single, CASE WHEN p_partkey % 8 = 0 THEN 'known_enum' END AS rule FROM ({PAIRS})),
x AS (SELECT *, replace(bt, ' ', '') AS ct, replace(bp, ' ', '') AS cp FROM e),
c AS (SELECT *, CASE WHEN pred = '' THEN 'not_found' WHEN truth = pred THEN 'exact' WHEN bt = bp THEN 'diacritics_only' WHEN dirty THEN 'label_contamination' WHEN ct = cp THEN 'line_merge_or_split'
  WHEN length(cp) < length(ct) AND regexp_matches(ct, array_to_string(string_split(cp, ''), '.*')) THEN 'character_omission' WHEN single AND (length(cp) < length(ct) * 0.55 OR length(cp) > length(ct) * 1.8) THEN 'region_mismatch' WHEN rule = 'known_enum' THEN 'enum_confusion' ELSE 'character_substitution' END AS error,
  CASE WHEN p_partkey % 3 = 0 THEN 'accepted' ELSE 'needs_review' END AS status FROM x)"""


def identity(spark, sf_dir):
    k = F.col(KEY)
    error = reports.field_error(F.col("truth"), F.col("pred"), k % 9 == 0, k % 2 == 0, F.when(k % 8 == 0, "known_enum"))
    return name_pairs(spark, sf_dir).withColumns({"field": F.col("p_brand"), "error": error, "status": F.when(k % 3 == 0, "accepted").otherwise("needs_review"), "sensitive": k % 4 == 0})


@query(f"WITH {ERRORS} SELECT p_brand, error, count(*) AS fields FROM c GROUP BY ALL")
def field_errors(spark, sf_dir):
    return identity(spark, sf_dir).groupBy("p_brand", "error").agg(F.count("*").alias("fields"))


@query(
    f"""WITH {ERRORS} SELECT p_brand AS field, count(*) AS evaluated, {_share("error = 'exact'")} AS exact, {_share('bt = bp')} AS ascii_exact, {_share("error = 'character_omission'")} AS omission, {_share("error <> 'not_found'")} AS presence, {_share("status = 'accepted' AND error = 'exact'", _n("status = 'accepted'"))} AS accepted_precision, {_share("status = 'accepted'")} AS accepted_coverage,
 {_share("error NOT IN ('region_mismatch', 'label_contamination', 'not_found')")} AS region, {_n("p_partkey % 4 = 0 AND status = 'accepted' AND error <> 'exact'")} AS sensitive_false FROM c GROUP BY GROUPING SETS ((p_brand), ())"""
)
def identity_report(spark, sf_dir):
    return reports.identity_fields(identity(spark, sf_dir))


@query(f"SELECT p_brand, profile, count(*) AS candidates, {_n('pred = truth')} AS strict, {_n('lower(pred) = lower(truth)')} AS ascii FROM (SELECT p_brand, truth, unnest(['primary', 'second']) AS profile, unnest([prim, second]) AS pred FROM {READINGS}) GROUP BY ALL")
def candidate_oracle(spark, sf_dir):
    rows = readings(spark, sf_dir).select("p_brand", "truth", F.explode(F.create_map(F.lit("primary"), F.col("primary"), F.lit("second"), F.col("second"))).alias("profile", "value"))
    return reports.candidate_oracle(rows, ["p_brand", "profile"])


@query(
    f"""WITH d AS (SELECT o_orderpriority AS family, o_orderkey % 7 <> 0 AS s, o_orderkey % 9 <> 0 AS g, (o_orderkey % 10) / 10.0::DOUBLE AS c FROM orders),
f AS (SELECT 'C' || p_partkey % 3 AS family, truth, coalesce(pred, '') AS pred FROM ({PAIRS}) UNION ALL SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END FROM orders),
r AS (SELECT o_orderpriority AS family, l_orderkey AS d, l_linenumber AS r, count(*) * 2 AS n, count(*) FILTER (l_partkey % 5 <> 0) + count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
dd AS (SELECT family, count(*) AS documents, {_share('s')} AS subtype_accuracy, {_share('g')} AS family_accuracy, round_even(avg(c), 6) AS completeness FROM d GROUP BY GROUPING SETS ((family), ())),
ff AS (SELECT family, count(*) AS fields, {_n('truth = pred')} AS exact, {_share('truth = pred')} AS exact_rate, round_even(sum(levenshtein(truth, pred)) / sum(length(truth))::DOUBLE, 6) AS cer, 0::DOUBLE AS der FROM f GROUP BY GROUPING SETS ((family), ())),
rr AS (SELECT family, count(*) AS table_rows, {_share('n = k')} AS row_accuracy, sum(n)::BIGINT AS table_cells, round_even(sum(k) / greatest(1, sum(n))::DOUBLE, 6) AS cell_accuracy FROM r GROUP BY GROUPING SETS ((family), ()))
SELECT dd.*, ff.* EXCLUDE (family), rr.* EXCLUDE (family) FROM dd LEFT JOIN ff ON dd.family IS NOT DISTINCT FROM ff.family LEFT JOIN rr ON dd.family IS NOT DISTINCT FROM rr.family"""
)
def family_report(spark, sf_dir):
    k = F.col(KEY)
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    docs = o.select(F.col("o_orderpriority").alias("family"), (key % 7 != 0).alias("subtype_right"), (key % 9 != 0).alias("family_right"), ((key % 10) / F.lit(10.0)).alias("completeness"))
    names = name_pairs(spark, sf_dir).select(F.concat(F.lit("C"), (k % 3).cast("string")).alias("family"), "truth", "pred")
    fs = names.unionByName(o.select(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("truth"), F.when(key % 5 != 0, F.col("o_orderstatus")).alias("pred")))
    line = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == key)
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("column"), F.lit("x").alias("truth"), F.when(F.col("l_partkey") % 5 != 0, "x").alias("pred")), F.struct(F.lit(1).alias("column"), F.col("l_returnflag").alias("truth"), F.col("l_returnflag").alias("pred"))))
    cells = line.select(F.col("l_orderkey").alias("document"), F.col("o_orderpriority").alias("family"), F.col("l_linenumber").alias("row"), pairs.alias("c")).select("document", "family", "row", "c.*")
    return reports.family_report(docs, fs, cells)


@query(f"SELECT p_partkey, round_even(levenshtein(t, coalesce(pred, '')) / greatest(1, length(t))::DOUBLE, 6) AS cer FROM (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE truth END AS t FROM ({PAIRS}))")
def page_cer(spark, sf_dir):
    k = F.col(KEY)
    return reports.page_errors(name_pairs(spark, sf_dir).withColumn("truth", F.when(k % 13 == 0, "").otherwise(F.col("truth"))), ["p_partkey"])


@query("WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS t, list(CASE WHEN conv_id % 4 = 0 THEN 'x' ELSE role END ORDER BY turn) AS p FROM conversations GROUP BY conv_id) SELECT conv_id % 3 AS part, count(*) AS cases, round_even(count(*) FILTER (t = p) / count(*)::DOUBLE, 6) AS reading_order FROM c GROUP BY 1")
def reading_order_accuracy(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    cases = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("truth"))
    cases = cases.withColumns({"part": F.col("conv_id") % 3, "pred": F.when(F.col("conv_id") % 4 == 0, F.transform("truth", lambda _: F.lit("x"))).otherwise(F.col("truth"))})
    return reports.order_accuracy(cases, "truth", "pred", ["part"])


@query("WITH f AS (SELECT o_orderpriority AS field, o_orderstatus AS truth, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS baseline, o_orderkey % 5 = 0 AS unsafe, CASE WHEN o_orderkey % 15 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'Y' WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS fin FROM orders) SELECT field, count(*) AS fields, count(*) FILTER (baseline = '' OR unsafe) AS eligible, count(*) FILTER (fin <> baseline) AS recovered, count(*) FILTER (fin <> baseline AND fin = truth) AS \"right\", count(*) FILTER (fin <> baseline AND baseline = truth) AS lost FROM f GROUP BY field")
def recovery_counts(spark, sf_dir):
    o, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), s.alias("truth"), F.when(o % 3 == 0, "").when(o % 5 == 0, "X").otherwise(s).alias("baseline"), (o % 5 == 0).alias("unsafe"), F.when(o % 15 == 0, s).when(o % 3 == 0, "Y").when(o % 5 == 0, "X").otherwise(s).alias("final"))
    return reports.recovery(rows, ["field"])


CASES = "SELECT o_orderpriority AS batch, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PENDING_REVIEW' ELSE 'SKIPPED' END AS status FROM orders"


def cases(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), "o_orderkey", F.when(s == "F", "CONFIRMED").when(s == "O", "PENDING_REVIEW").otherwise("SKIPPED").alias("status"))


@query(f"SELECT batch, count(*) AS total, {_n(chr(39).join(['status = ', 'PENDING_REVIEW', '']))} AS pending, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'PENDING_REVIEW') = 0 AS complete FROM ({CASES}) GROUP BY batch")
def review_progress(spark, sf_dir):
    return reports.review_progress(cases(spark, sf_dir), ["batch"])


@query(f"SELECT batch, min(o_orderkey) AS next_pending FROM ({CASES}) WHERE status = 'PENDING_REVIEW' GROUP BY batch")
def next_pending(spark, sf_dir):
    return cases(spark, sf_dir).where("status = 'PENDING_REVIEW'").groupBy("batch").agg(F.min("o_orderkey").alias("next_pending"))


@query("WITH e AS (SELECT event_type, user_id, props FROM events), g AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT props) AS p FROM e GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_references, count(*) FILTER (p > 1) AS idempotency_mismatches FROM g GROUP BY event_type")
def shadow_review(spark, sf_dir):
    return reports.shadow_review(table(spark, sf_dir, "events"), ["event_type"], "user_id", "props")


@query("SELECT event_id, substr(sha256(event_id || ':' || user_id || ':' || event_type || ':' || props), 1, 16) AS reference FROM events")
def opaque_reference(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "events").select("event_id", reports.reference(text("event_id"), text("user_id"), F.col("event_type"), F.col("props")).alias("reference"))


@query("WITH a AS (SELECT c_mktsegment AS category, count(*) AS prepared FROM customer GROUP BY 1), b AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'LATE' ELSE c_mktsegment END AS category, count(*) AS processed, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'O') AS review FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT coalesce(a.category, b.category) AS category, coalesce(prepared, 0) AS prepared, coalesce(processed, 0) AS processed, coalesce(ready, 0) AS ready, coalesce(review, 0) AS review FROM a FULL JOIN b ON a.category = b.category")
def dashboard_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("category", F.col("c_mktsegment"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumns({"category": F.when(F.col("o_orderkey") % 9 == 0, "LATE").otherwise(F.col("c_mktsegment")), "status": F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW")})
    return reports.dashboard(c, o)


@query("WITH l AS (SELECT l_orderkey AS doc, CASE WHEN l_linenumber % 5 <> 0 THEN 1 - l_discount END AS confidence FROM lineitem) SELECT doc, round_even(avg(confidence), 4) AS mean, min(confidence) AS least, CASE WHEN min(confidence) IS NULL THEN 'NO_TEXT' WHEN min(confidence) < 0.85 THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS status FROM l GROUP BY doc")
def document_confidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") % 5 != 0, 1 - F.col("l_discount")).alias("confidence"))
    return reports.confidences(lines, ["doc"])


@query("SELECT event_type, count(v) AS samples, round_even(quantile_disc(v, 0.5), 3) AS p50, round_even(quantile_disc(v, 0.95), 3) AS p95 FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) GROUP BY event_type")
def stage_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return reports.stage_summary(rows, ["event_type"], "v")


# --- gates -----------------------------------------------------------------------------------------------------

MEASURED = """m AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 <> 0) / count(*)::DOUBLE AS b, count(*) FILTER (o_orderkey % 9 <> 0) / count(*)::DOUBLE AS c, quantile_disc(o_totalprice / 100, 0.95) AS p95, count(*) FILTER (o_orderstatus = 'P') / count(*)::DOUBLE AS failed FROM orders)"""


def measured(spark, sf_dir):
    o = F.col("o_orderkey")
    part = lambda x: F.count_if(x) / F.count("*")
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.col("o_totalprice") / 100)
    sums = orders.agg(F.count("*").alias("n"), part(o % 7 != 0).alias("b"), part(o % 9 != 0).alias("c"), part(F.col("o_orderstatus") == "P").alias("failed"))
    return sums.crossJoin(quantiles.order_statistics(orders, [], "cents", {"p95": quantiles.nearest(0.95)}).select("p95"))  # one row each


def listed_checks(codes_and_sql):
    return f"unnest([{', '.join(repr(c) for c, _ in codes_and_sql)}]) AS code, unnest([{', '.join(s for _, s in codes_and_sql)}]) AS passed"


PROMOTION_SQL = [
    ("DATASET_AUTHORIZATION_ACTIVE", "true"), ("MINIMUM_BENCHMARK_PAGES", "n >= 30"), ("FIELD_EXACT_MATCH_IMPROVEMENT", "c - b >= 0.01"), ("MINIMUM_OCR_CASES", "n >= 1"), ("OCR_CER_NON_REGRESSION", "1 - c <= 1 - b"), ("OCR_WER_NON_REGRESSION", "1 - c <= 1 - b"),
    ("READING_ORDER_NON_REGRESSION", "c >= b"), ("NO_SENSITIVE_FALSE_ACCEPTANCE_INCREASE", "true"), ("NO_FALSE_PASS_INCREASE", "1 - c <= 1 - b"), ("LATENCY_SLO", "p95 <= 5000"), ("REVIEW_EFFORT", "1 - c <= 1 - b + 0.02"), ("FAILURE_RATE", "failed <= 0.01"),
    ("CONTRACT_REGRESSION", "true"), ("PRIVACY_APPROVAL", "true"), ("LICENSE_APPROVAL", "false"), ("MODEL_PROVENANCE_APPROVAL", "true"),
]


@query(f"WITH {MEASURED}, k AS (SELECT {listed_checks(PROMOTION_SQL)} FROM m) SELECT code, passed, CASE WHEN bool_and(passed) OVER () THEN 'PROMOTE' ELSE 'HOLD' END AS status FROM k")
def promotion_gate(spark, sf_dir):
    side = lambda c: {"exact_match": F.col(c), "ocr_cases": F.col("n"), "cer": 1 - F.col(c), "wer": 1 - F.col(c), "reading_order": F.col(c), "sensitive_false": F.lit(0), "false_pass_rate": 1 - F.col(c), "p95": F.col("p95"), "review_rate": 1 - F.col(c), "failure_rate": F.col("failed")}
    day = lambda d: F.lit(d).cast("date")
    dataset = {"status": F.lit("APPROVED"), "approved_at": day("2024-01-01"), "retention_until": day("2024-12-31"), "as_of": day("2024-06-30"), "pages": F.col("n")}
    evidence = {"contract_tests": F.lit(True), "privacy": F.lit(True), "license": F.lit(False), "provenance": F.lit(True)}
    return reports.checked(measured(spark, sf_dir), reports.promotion_checks(side("b"), side("c"), dataset, evidence), "PROMOTE")


DATA_SQL = [
    ("strictOverallAtLeast80", "rate >= 0.8"), ("strictEachFamilyAtLeast80", "least_rate >= 0.8"), ("applicableCompletenessAtLeast95", "app > 0 AND app_rate >= 0.95"), ("classificationAtLeast95", "0.96 >= 0.95"), ("schemaErrorsZero", "true"), ("sensitiveFalseAcceptanceZero", "sens = 0"),
    ("parserCorrectRegressionZero", "true"), ("scanAlwaysManualReview", "true"), ("falseAutoContinueZero", "true"),
]


@query(
    f"""WITH {FIELDS}, r AS (SELECT category, {_share('exact')} AS rate FROM f GROUP BY category), t AS (SELECT {_share('exact')} AS rate, (SELECT min(rate) FROM r) AS least_rate, {_n("truth <> ''")} AS app, {_share("truth <> '' AND pred <> ''", _n("truth <> ''"))} AS app_rate, {_n('sensitive AND matched AND NOT exact')} AS sens FROM f),
k AS (SELECT {listed_checks(DATA_SQL)} FROM t) SELECT code, passed, CASE WHEN bool_and(passed) OVER () THEN 'PASS' ELSE 'HOLD' END AS status FROM k"""
)
def data_gate(spark, sf_dir):
    rates = F.map_from_entries(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "exact_rate"))))
    all_ = lambda c: F.max(F.when(F.col("category").isNull(), F.col(c))).alias(c)
    row = reports.aggregate(fields(spark, sf_dir)).agg(rates.alias("rates"), *(all_(c) for c in ("exact_rate", "applicable", "applicable_rate", "sensitive_false_acceptance")))
    m = {"exact_rate": F.col("exact_rate"), "applicable": F.col("applicable"), "applicable_rate": F.col("applicable_rate"), "accuracy": F.lit(0.96), "schema_errors": F.lit(0), "sensitive_false": F.col("sensitive_false_acceptance"), "regressions": F.lit(0), "always_reviewed": F.lit(True), "false_auto": F.lit(0)}
    return reports.checked(row, reports.data_gate(m, {c: F.col("rates")[c] for c in ("C0", "C1", "C2")}))


IDENTITY_SQL = (
    [("schemaErrorsZero", "true"), ("noExactRegression", "true"), ("targetImprovement", "n >= 1"), ("exactNotWorse", "c >= b"), ("asciiNotWorse", "c >= b"), ("cerNotWorse", "1 - c <= 1 - b"), ("derNotWorse", "1 - c <= 1 - b"), ("presenceNotWorse", "c >= b"), ("manualReviewOnly", "true"), ("protectedFieldsPreserved", "true")],
    [("fullNameAsciiExactMatch", "c >= 0.9"), ("addressAsciiExactMatch", "c >= 0.85"), ("fieldPresence", "c >= 0.95"), ("noSensitiveFalseAcceptance", "true"), ("noExactRegression", "true"), ("acceptedPrecision", "true"), ("protectedFieldsPreserved", "true")],
)


@query(
    f"""WITH {MEASURED}, k AS (SELECT 'development' AS gate, {listed_checks(IDENTITY_SQL[0])} FROM m), h AS (SELECT 'readiness' AS gate, {listed_checks(IDENTITY_SQL[1])} FROM m)
SELECT gate, code, passed, CASE WHEN bool_and(passed) OVER () THEN 'DEVELOPMENT_IMPROVED' ELSE 'HOLD' END AS status FROM k UNION ALL SELECT gate, code, passed, CASE WHEN bool_and(passed) OVER () THEN 'READY_FOR_NEW_HELDOUT' ELSE 'HOLD' END FROM h"""
)
def identity_gate(spark, sf_dir):
    side = lambda c: {"exact": F.col(c), "ascii_exact": F.col(c), "cer": 1 - F.col(c), "der": 1 - F.col(c), "presence": F.col(c), "name_ascii": F.col(c), "address_ascii": F.col(c), "sensitive_false": F.lit(0), "accepted_coverage": F.lit(0.4), "accepted_precision": F.lit(1.0)}
    counts = {"schema_errors": F.lit(0), "regressions": F.lit(0), "improvements": F.col("n"), "manual_only": F.lit(True), "protected_regressions": F.lit(0)}
    development, readiness = reports.identity_gates(side("b"), side("c"), counts)
    row = measured(spark, sf_dir)
    one = lambda gate, checks, good: reports.checked(row, checks, good).select(F.lit(gate).alias("gate"), "code", "passed", "status")
    return one("development", development, "DEVELOPMENT_IMPROVED").unionByName(one("readiness", readiness, "READY_FOR_NEW_HELDOUT"))


@query(
    f"""WITH f AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'image' WHEN '2-HIGH' THEN 'scan_pdf' ELSE lower(o_orderpriority) END AS format, count(*) AS a, {_n("o_orderstatus <> 'P'")} AS p, {_n('o_orderkey % 97 <> 0')} / count(*)::DOUBLE AS r FROM orders GROUP BY 1),
k AS (SELECT format, unnest(['all_available_processed', 'classification', 'required_field_em', 'schema', 'no_false_auto_continue', 'review_routing']) AS code, unnest([a > 0 AND p = a, true, r >= CASE WHEN format IN ('image', 'scan_pdf') THEN 0.8 ELSE 1.0 END, true, true, format NOT IN ('image', 'scan_pdf') OR format = 'image']) AS passed FROM f)
SELECT *, CASE WHEN bool_and(passed) OVER (PARTITION BY format) THEN 'PASS' ELSE 'HOLD' END AS status FROM k"""
)
def format_gates(spark, sf_dir):
    name = F.col("o_orderpriority")
    fmt = F.when(name == "1-URGENT", "image").when(name == "2-HIGH", "scan_pdf").otherwise(F.lower(name))
    done = F.count_if(F.col("o_orderstatus") != "P")
    rows = table(spark, sf_dir, "orders").groupBy(fmt.alias("format")).agg(F.count("*").alias("available"), done.alias("processed"), done.alias("classified"), (F.count_if(F.col("o_orderkey") % 97 != 0) / F.count("*")).alias("exact_rate"))
    rows = rows.withColumns({"technical_errors": F.lit(0), "unsupported": F.lit(0), "schema_errors": F.lit(0), "false_auto": F.lit(0), "manual_reviews": F.when(F.col("format") == "image", F.col("processed")).otherwise(F.lit(0))})
    return reports.format_gates(rows)


@query(
    f"""WITH x AS (SELECT p_brand, count(*) AS n, {_n(_MOVED + ' AND prim = truth AND sel <> truth')} AS lost, {_n('prim = truth')} / count(*)::DOUBLE AS b, {_n('sel = truth')} / count(*)::DOUBLE AS a FROM {READINGS} GROUP BY p_brand)
SELECT p_brand, CASE WHEN lost = 0 AND a >= b THEN 'QUALITY_SIGNALS_PASS' ELSE 'QUALITY_SIGNALS_FAIL' END AS signals, CASE WHEN n >= 8 THEN 'PASS' ELSE 'INSUFFICIENT_DOCUMENTS' END AS sample, CASE WHEN n < 8 THEN 'NOT_PROMOTED_INSUFFICIENT_DOCUMENTS' WHEN lost = 0 AND a >= b THEN 'ELIGIBLE_FOR_CONTROLLED_PILOT' ELSE 'NOT_PROMOTED' END AS pilot FROM x"""
)
def blinded_decision(spark, sf_dir):
    c = F.col
    rows = reports.replay(readings(spark, sf_dir), ["p_brand"])
    found = reports.blinded_decision(c("lines"), 8, c("lost"), c("baseline_exact") / c("lines"), c("selected_exact") / c("lines"), F.lit(0.0), F.lit(0.0))
    return rows.select("p_brand", found.alias("d")).select("p_brand", "d.*")


@query(
    """SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'SNAPSHOT_NOT_BLINDED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'QUEUE_DIGESTS_DIFFER' END, CASE WHEN o_orderkey % 4 > 2 THEN 'REVIEW_NOT_COMPLETE' END], lambda x: x IS NOT NULL), ',') AS problems,
 array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMATION_REQUIRED' END, CASE WHEN o_orderstatus = 'F' THEN 'ALREADY_SEALED' END, CASE WHEN o_orderkey % 4 > 0 THEN 'REVIEW_INCOMPLETE' END, CASE WHEN o_orderkey % 2 = 1 THEN 'LOCK_HASH_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS seal FROM orders"""
)
def preconditions(spark, sf_dir):
    o = F.col("o_orderkey")
    yes, none = F.lit(True), F.lit(0)
    blind = reports.blinded_problems(o % 5 != 0, F.lit(False), yes, o % 7 != 0, yes, none, F.when(o % 4 > 2, 1).otherwise(0), none, none)
    seal = reports.seal_problems(o % 3 != 0, F.col("o_orderstatus") == "F", o % 4, F.lit("a"), F.when(o % 2 == 1, "b").otherwise("a"))
    return table(spark, sf_dir, "orders").select(o.alias("k"), F.array_join(blind, ",").alias("problems"), F.array_join(seal, ",").alias("seal"))


@query(
    """WITH t AS (SELECT p_partkey, p_brand AS template_id, CASE WHEN p_size % 7 = 0 THEN 'v1' ELSE (p_size % 4) || '.0' END AS version, CASE WHEN p_size % 9 = 0 THEN '' ELSE 's' END AS schema_ref, p_size % 5 AS minimum FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN count(*) OVER (PARTITION BY template_id, version) > 1 THEN 'DUPLICATE_VERSION' END, CASE WHEN version = 'v1' THEN 'VERSION_NOT_SEMANTIC' END, CASE WHEN schema_ref = '' THEN 'SCHEMA_MISSING' END, CASE WHEN minimum < 1 OR minimum > 3 THEN 'MINIMUM_OUT_OF_RANGE' END], lambda x: x IS NOT NULL), ',') AS problems FROM t"""
)
def template_governance(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("template_id"), F.when(size % 7 == 0, "v1").otherwise(F.concat((size % 4).cast("string"), F.lit(".0"))).alias("version"), F.when(size % 9 == 0, "").otherwise("s").alias("schema_ref"),
        (size % 5).alias("minimum"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("anchors"), F.array(F.lit("x")).alias("required"), F.array(F.lit("y")).alias("optional"), F.concat(F.lit("sha256:"), F.sha2(F.col("p_name"), 256)).alias("digest"), "p_partkey",
    )
    return reports.manifest_problems(rows).select("p_partkey", F.array_join("problems", ",").alias("problems"))


@query(
    """WITH f AS (SELECT l_orderkey AS doc, l_returnflag AS t, CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 5 = 0 THEN lower(l_returnflag) WHEN l_linenumber % 7 = 0 THEN 'Z' ELSE l_returnflag END AS p, l_linenumber <= 6 AS reviewed, l_linenumber % 2 = 0 OR l_linenumber % 5 = 0 AS tok FROM lineitem),
s AS (SELECT *, CASE WHEN NOT reviewed THEN 'U' WHEN t <> '' AND p = '' THEN 'M' WHEN t = p OR (tok AND lower(t) = lower(p)) THEN 'E' ELSE 'X' END AS st FROM f)
SELECT doc, count(*) AS fields, count(*) FILTER (st <> 'U') AS compared, count(*) FILTER (st = 'E') AS exact, 0::BIGINT AS accepted, count(*) FILTER (st = 'X') AS mismatched, count(*) FILTER (st = 'M') AS missing, count(*) FILTER (st = 'U') AS unreviewed, CASE WHEN count(*) FILTER (st IN ('U', 'X', 'M')) = 0 THEN 'PASS' ELSE 'HOLD' END AS decision FROM s GROUP BY doc"""
)
def file_comparison(spark, sf_dir):
    n, t = F.col("l_linenumber"), F.col("l_returnflag")
    pred = F.when(n % 4 == 0, "").when(n % 5 == 0, F.lower(t)).when(n % 7 == 0, "Z").otherwise(t)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), t.alias("truth"), pred.alias("pred"), (n <= 6).alias("reviewed"), F.when((n % 2 == 0) | (n % 5 == 0), "tokens").alias("form"), F.lit(False).alias("soft"))
    return matching.compared_file(rows, ["doc"])


@query(f"WITH p AS (SELECT p_brand, truth, coalesce(pred, '') AS pred FROM ({PAIRS})) SELECT p_brand, count(*) AS cases, round_even(count(*) FILTER (truth = pred) / count(*)::DOUBLE, 6) AS exact, round_even(count(*) FILTER (lower(truth) = lower(pred)) / count(*)::DOUBLE, 6) AS exact_casefold, round_even(sum(levenshtein('  ' || truth || ' ', pred)) / sum(length(truth) + 3)::DOUBLE, 6) AS cer, 0::DOUBLE AS der FROM p GROUP BY p_brand".replace("(truth = pred)", "('  ' || truth || ' ' = pred)").replace("lower(truth) = lower(pred)", "'  ' || lower(truth) || ' ' = lower(pred)"))
def corpus_cer(spark, sf_dir):
    """Corpus rates without any normalisation: spacing counts."""
    rows = name_pairs(spark, sf_dir).withColumn("truth", F.concat(F.lit("  "), "truth", F.lit(" ")))
    return metrics.text_errors(rows, by=["p_brand"], fold=lambda x: x)


#: Twelve evaluations of one set; each but the first three breaks one thing.
EVALUATED = """SELECT l_suppkey % 12 AS run, 'C' || (l_linenumber % 3) AS family, l_returnflag AS truth, CASE WHEN l_suppkey % 12 = 3 AND l_orderkey % 3 = 0 OR l_suppkey % 12 = 4 AND l_linenumber % 3 = 1 AND l_orderkey % 4 = 0 OR l_orderkey % 40 = 7 THEN 'x' WHEN l_suppkey % 12 = 5 AND l_orderkey % 10 = 1 THEN '' ELSE l_returnflag END AS pred,
 CASE WHEN l_suppkey % 12 = 8 AND l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 40 = 7 AND l_suppkey % 12 <> 9 OR l_suppkey % 12 <> 1 AND l_orderkey % 5 = 2 THEN 'y' ELSE CASE WHEN l_suppkey % 12 IN (3, 4, 5) AND l_orderkey % 3 > 0 THEN 'y' ELSE l_returnflag END END AS base, l_orderkey % 2 = 0 AS scan, l_linenumber = 1 AS sensitive, NOT (l_orderkey % 40 = 7 AND l_suppkey % 12 <> 7) AS accepted, NOT (l_suppkey % 12 = 10 AND l_orderkey % 8 = 0) AS review,
 l_suppkey % 12 = 11 AND l_orderkey % 6 = 0 AS auto, NOT (l_suppkey % 12 = 2 AND l_orderkey % 30 = 0) AS readable, NOT (l_suppkey % 12 = 6 AND l_orderkey % 9 = 0) AS typed, l_suppkey % 12 = 6 AND l_orderkey % 90 = 1 AS broken"""
_DATA = [
    ("strictOverallAtLeast80", "exact >= 0.8"), ("strictEachFamilyAtLeast80", "fam"), ("applicableCompletenessAtLeast95", "app > 0 AND comp >= 0.95"), ("classificationAtLeast95", "acc >= 0.95"), ("schemaErrorsZero", "br = 0"), ("sensitiveFalseAcceptanceZero", "sf = 0"), ("parserCorrectRegressionZero", "reg = 0"),
    ("parserRegressionComparisonReady", "nb = 0"), ("scanAlwaysManualReview", "ur = 0"), ("falseAutoContinueZero", "fa = 0"), ("unsupportedOcrZero", "un = 0"), ("acceptedTextReportedSeparately", "true"), ("semanticMetricNotUsedAsStrictGate", "true"),
]


@query(
    f"""WITH f AS ({EVALUATED} FROM lineitem), m AS (SELECT run, avg((pred = truth)::INT) AS exact, min(fam) >= 0.8 AND count(DISTINCT family) = 3 AS fam, count(*) FILTER (truth <> '') AS app, count(*) FILTER (pred <> '') / count(*)::DOUBLE AS comp, avg(typed::INT) AS acc, count(*) FILTER (broken) AS br, count(*) FILTER (sensitive AND accepted AND pred <> truth) AS sf,
 count(*) FILTER (base = truth AND pred <> truth) AS reg, count(*) FILTER (base IS NULL) AS nb, count(*) FILTER (scan AND NOT review) AS ur, count(*) FILTER (scan AND auto) AS fa, count(*) FILTER (scan AND NOT readable) AS un, count(*) FILTER (scan AND pred = truth) / count(*) FILTER (scan)::DOUBLE AS sc, count(*) FILTER (scan AND base = truth) / count(*) FILTER (scan)::DOUBLE AS sb,
 count(*) FILTER (scan AND base = truth AND pred <> truth) AS sr, count(*) FILTER (scan AND base IS NULL) AS snb FROM (SELECT *, avg((pred = truth)::INT) OVER (PARTITION BY run, family) AS fam FROM f) GROUP BY run),
g AS (SELECT *, CASE WHEN snb = 0 THEN round_even(sc - sb, 6) END AS gain FROM m), h AS (SELECT *, coalesce(gain >= 0.1, false) AND sr = 0 AND br = 0 AND ur = 0 AND fa = 0 AS stands FROM g),
k AS (SELECT run, stands, gain, {listed_checks(_DATA)} FROM h) SELECT run, code, passed, CASE WHEN bool_and(passed) OVER (PARTITION BY run) AND stands THEN 'PASS' ELSE 'HOLD' END AS decision, CASE WHEN stands THEN 'PASS' ELSE 'HOLD' END AS fallback, gain FROM k"""
)
def data_decisions(spark, sf_dir):
    rows = spark.sql(f"{EVALUATED} FROM {{lineitem}}", lineitem=table(spark, sf_dir, "lineitem"))
    return reports.data_decisions(rows, ["run"], ["C0", "C1", "C2"])
