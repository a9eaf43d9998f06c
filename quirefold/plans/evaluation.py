"""Evaluation queries. Truth and predictions are the star schema's own columns and fixed perturbations of them."""

from pyspark.sql import functions as F

from quirefold.functions import text as t
from quirefold.functions.numbers import rate
from quirefold.operators import matching, metrics, observe, recovery
from quirefold.plans.documents import CLASSIFIED, classified
from quirefold.plans.registry import query, table

PRF = f"""WITH {CLASSIFIED},
lab AS (SELECT lang AS label FROM cls UNION SELECT document_type FROM cls),
k AS (SELECT label, (SELECT count(*) FROM cls WHERE lang = label) AS support, (SELECT count(*) FROM cls WHERE document_type = label) AS predicted, (SELECT count(*) FROM cls WHERE lang = label AND document_type = label) AS true_positive FROM lab),
q AS (SELECT *, coalesce(round_even(true_positive / nullif(predicted, 0)::DOUBLE, 6), 0) AS precision, coalesce(round_even(true_positive / nullif(support, 0)::DOUBLE, 6), 0) AS recall FROM k),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN round_even(2 * precision * recall / (precision + recall), 6) ELSE 0 END AS f1 FROM q)"""


def report(spark, sf_dir):
    return metrics.class_report(classified(spark, sf_dir), "lang", "document_type")


@query(f"{PRF} SELECT * FROM rep")
def class_prf(spark, sf_dir):
    return report(spark, sf_dir)


@query(f"{PRF} SELECT sum(support)::BIGINT AS cases, round_even(avg(precision) FILTER (support > 0), 6) AS macro_precision, round_even(avg(recall) FILTER (support > 0), 6) AS macro_recall, round_even(avg(f1) FILTER (support > 0), 6) AS macro_f1, round_even(coalesce(sum(predicted) FILTER (label = 'UNKNOWN'), 0) / sum(support)::DOUBLE, 6) AS unknown_rate FROM rep")
def class_macro(spark, sf_dir):
    return metrics.class_macro(report(spark, sf_dir))


def predicted_orders(spark, sf_dir):
    """Orders as predictions: every 37th is missing, every 41st is there twice."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 37 <> 0")
    return o.unionByName(o.where("o_orderkey % 41 = 0"))


@query(
    """WITH p AS (SELECT * FROM orders WHERE o_orderkey % 37 <> 0), p2 AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE o_orderkey % 41 = 0),
a AS (SELECT o_orderkey AS k, count(*) AS t FROM orders GROUP BY 1), b AS (SELECT o_orderkey AS k, count(*) AS p FROM p2 GROUP BY 1)
SELECT count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS matched, count(*) FILTER (p IS NULL) AS missing_prediction, count(*) FILTER (t IS NULL) AS missing_truth,
  count(*) FILTER (t > 1 OR p > 1) AS repeated, (count(*) FILTER (p IS NULL OR t IS NULL OR t > 1 OR p > 1)) = 0 AS is_bijection FROM a FULL JOIN b USING (k)"""
)
def truth_pred_pairing(spark, sf_dir):
    return metrics.pairing(table(spark, sf_dir, "orders"), predicted_orders(spark, sf_dir), "o_orderkey")


TRUTH_FIELDS = "SELECT o_orderkey AS case_id, o_orderpriority AS family, unnest(['status', 'customer']) AS name, unnest([o_orderstatus, o_custkey::VARCHAR]) AS value, unnest([false, true]) AS sensitive FROM orders"
PRED_FIELDS = f"""SELECT case_id, name, CASE WHEN name = 'status' AND case_id % 7 = 0 THEN 'X' WHEN name = 'customer' AND case_id % 9 = 0 THEN '0' || value ELSE value END AS value,
  CASE WHEN case_id % 5 = 0 THEN 'NEEDS_REVIEW' ELSE 'ACCEPTED' END AS status FROM ({TRUTH_FIELDS}) WHERE NOT (name = 'customer' AND case_id % 11 = 0)
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, 'ACCEPTED' FROM orders WHERE o_orderkey % 13 = 0
  UNION ALL SELECT o_orderkey, 'note', 'n', 'ACCEPTED' FROM orders WHERE o_orderkey % 17 = 0"""


def field_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cells = lambda *xs: F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"), F.lit(s).alias("sensitive")) for n, v, s in xs)))
    truth = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("family"), cells(("status", F.col("o_orderstatus"), False), ("customer", F.col("o_custkey"), True)).alias("f")).select("case_id", "family", "f.*")
    k, name = F.col("case_id"), F.col("name")
    value = F.when((name == "status") & (k % 7 == 0), "X").when((name == "customer") & (k % 9 == 0), F.concat(F.lit("0"), "value")).otherwise(F.col("value"))
    pred = truth.where(~((name == "customer") & (k % 11 == 0))).select("case_id", "name", value.alias("value"), F.when(k % 5 == 0, "NEEDS_REVIEW").otherwise("ACCEPTED").alias("status"))
    more = lambda m, n, v: orders.where(f"o_orderkey % {m} = 0").select(F.col("o_orderkey").alias("case_id"), F.lit(n).alias("name"), v.alias("value"), F.lit("ACCEPTED").alias("status"))
    return truth, pred.unionByName(more(13, "status", F.col("o_orderstatus"))).unionByName(more(17, "note", F.lit("n")))


@query(
    f"""WITH t AS ({TRUTH_FIELDS}), p AS ({PRED_FIELDS}), g AS (SELECT case_id, name, count(*) AS n, list(value) AS vs FROM p GROUP BY ALL),
k AS (SELECT family, name, 1 AS e, coalesce(n, 0) AS q, coalesce(list_contains(vs, value), false)::INT AS x, (n IS NULL)::INT AS z FROM t LEFT JOIN g USING (case_id, name)
  UNION ALL SELECT c.family, g.name, 0, g.n, 0, 0 FROM g JOIN (SELECT DISTINCT case_id, family FROM t) c USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = g.case_id AND t.name = g.name)),
s AS (SELECT family, name, sum(e)::BIGINT AS expected, sum(q)::BIGINT AS predicted, sum(x)::BIGINT AS exact, sum(z)::BIGINT AS not_found FROM k GROUP BY ALL)
SELECT *, coalesce(round_even(exact / nullif(expected, 0)::DOUBLE, 6), 0) AS exact_match, coalesce(round_even(exact / nullif(predicted, 0)::DOUBLE, 6), 0) AS precision, coalesce(round_even(exact / nullif(expected, 0)::DOUBLE, 6), 0) AS recall FROM s"""
)
def field_prf(spark, sf_dir):
    return metrics.field_report(*field_tables(spark, sf_dir), ["family", "name"])


@query(f"WITH t AS ({TRUTH_FIELDS}), p AS ({PRED_FIELDS}) SELECT name, count(*) AS unexpected FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = p.case_id AND t.name = p.name) GROUP BY name")
def field_unexpected(spark, sf_dir):
    truth, pred = field_tables(spark, sf_dir)
    return pred.join(truth, ["case_id", "name"], "left_anti").groupBy("name").agg(F.count("*").alias("unexpected"))


@query(f"WITH t AS ({TRUTH_FIELDS}), p AS ({PRED_FIELDS}) SELECT count(*) AS sensitive_accepted FROM (SELECT DISTINCT case_id, name FROM p WHERE status = 'ACCEPTED' AND (case_id, name) IN (SELECT (case_id, name) FROM t WHERE sensitive))")
def sensitive_acceptance(spark, sf_dir):
    return metrics.sensitive_acceptance(*field_tables(spark, sf_dir))


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END"


def quality_cases(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").otherwise("REJECTED")
    k = F.col("o_orderkey")
    got = F.when(k % 19 == 0, "PASS").when(k % 23 == 0, "REJECTED").otherwise(s)
    return table(spark, sf_dir, "orders").select(k.alias("case_id"), s.alias("expected_status"), got.alias("status"), (s != "PASS").alias("expected_review"), (got != "PASS").alias("review"))


@query(
    f"""WITH c AS (SELECT {STATUS} AS e, CASE WHEN o_orderkey % 19 = 0 THEN 'PASS' WHEN o_orderkey % 23 = 0 THEN 'REJECTED' ELSE {STATUS} END AS s FROM orders)
SELECT count(*) AS cases, coalesce(round_even(count(*) FILTER (s = 'PASS' AND e <> 'PASS') / nullif(count(*) FILTER (e <> 'PASS'), 0)::DOUBLE, 6), 0) AS false_pass_rate,
 coalesce(round_even(count(*) FILTER (s = 'REJECTED' AND e <> 'REJECTED') / nullif(count(*) FILTER (e <> 'REJECTED'), 0)::DOUBLE, 6), 0) AS false_reject_rate,
 round_even(count(*) FILTER (s <> 'PASS') / count(*)::DOUBLE, 6) AS review_rate, coalesce(round_even(count(*) FILTER (s <> 'PASS' AND e <> 'PASS') / nullif(count(*) FILTER (s <> 'PASS'), 0)::DOUBLE, 6), 0) AS review_precision FROM c"""
)
def quality_rates(spark, sf_dir):
    return metrics.quality_rates(quality_cases(spark, sf_dir))


@query("SELECT event_type, count(*) AS cases, round_even(quantile_disc(value, 0.5), 3) AS p50, round_even(quantile_disc(value, 0.95), 3) AS p95, round_even(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS failure_rate FROM events GROUP BY event_type")
def latency_pctl(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "value", F.col("value") > 50, ["event_type"])


def name_pairs(spark, sf_dir):
    """Part names read with losses: every third without its e, every fifth with the first word gone, every seventh in capitals, every eleventh not at all."""
    k, n = F.col("p_partkey"), F.col("p_name")
    read = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.upper(n)).when(k % 5 == 0, F.regexp_replace(n, "^[^ ]* ", "")).when(k % 3 == 0, F.replace(n, F.lit("e"), F.lit(""))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", n.alias("truth"), read.alias("pred"))


PAIRS = "SELECT p_partkey, p_brand, p_name AS truth, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 0 THEN regexp_replace(p_name, '^[^ ]* ', '') WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', '') ELSE p_name END AS pred FROM part"


@query(f"SELECT p_brand, count(*) AS cases, round_even(count(*) FILTER (truth = coalesce(pred, '')) / count(*)::DOUBLE, 6) AS exact, round_even(count(*) FILTER (lower(truth) = lower(coalesce(pred, ''))) / count(*)::DOUBLE, 6) AS exact_casefold, round_even(sum(levenshtein(truth, coalesce(pred, ''))) / sum(length(truth))::DOUBLE, 6) AS cer, 0::DOUBLE AS der FROM ({PAIRS}) GROUP BY p_brand")
def cer_ascii(spark, sf_dir):
    return metrics.text_errors(name_pairs(spark, sf_dir), by=["p_brand"])


@query()
def wer_words(spark, sf_dir):
    return metrics.text_errors(name_pairs(spark, sf_dir), by=["p_brand"], words=True)


@query()
def der(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(observe.lines_of(F.col("text"))).alias("seq", "truth"))
    return metrics.text_errors(lines.withColumn("pred", t.without_marks(F.col("truth"))).withColumn("role", F.lit("all")), by=["role"])


@query(f"SELECT p_brand, CASE WHEN truth = coalesce(pred, '') THEN 'exact' WHEN coalesce(pred, '') = '' THEN 'empty' WHEN length(pred) < length(truth) THEN 'missing' WHEN length(pred) > length(truth) THEN 'extra' ELSE 'substitution' END AS error_class, count(*) AS lines FROM ({PAIRS}) GROUP BY ALL")
def error_taxonomy(spark, sf_dir):
    rows = name_pairs(spark, sf_dir).withColumn("error_class", metrics.error_class(F.col("truth"), F.col("pred")))
    return rows.groupBy("p_brand", "error_class").agg(F.count("*").alias("lines"))


TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
SHARED = "list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))"


@query(f"WITH p AS (SELECT p_partkey, {TOKENS.format('truth')} AS a, {TOKENS.format('pred')} AS b FROM ({PAIRS})) SELECT p_partkey, CASE WHEN b IS NULL THEN 0 ELSE coalesce({SHARED}, 0)::INT END AS shared, len(a)::INT AS truth_tokens FROM p")
def token_overlap(spark, sf_dir):
    a, b = t.tokens(F.col("truth")), t.tokens(F.col("pred"))
    return name_pairs(spark, sf_dir).select("p_partkey", t.shared_tokens(a, b).alias("shared"), F.size(a).alias("truth_tokens"))


@query(
    f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE truth END AS truth, coalesce(pred, '') AS pred, p_partkey % 4 <> 0 AS soft FROM ({PAIRS})), q AS (SELECT *, {TOKENS.format('truth')} AS a, {TOKENS.format('pred')} AS b FROM p), k AS (SELECT *, coalesce({SHARED}, 0) / greatest(1, len(a))::DOUBLE AS cover FROM q),
m AS (SELECT *, CASE WHEN truth = pred THEN 'EXACT' WHEN truth = '' THEN 'EXTRA_PREDICTION' WHEN pred = '' THEN 'NOT_FOUND' WHEN NOT soft THEN 'MISMATCH' WHEN lower(truth) = lower(pred) THEN 'CASE_INSENSITIVE' WHEN cover >= 0.8 THEN 'PARTIAL_80' ELSE 'PARTIAL_BELOW_80' END AS match_type FROM k)
SELECT p_partkey, match_type, match_type IN ('EXACT', 'CASE_INSENSITIVE', 'PARTIAL_80') AS matched, CASE WHEN match_type IN ('EXACT', 'CASE_INSENSITIVE') THEN 1.0 WHEN match_type LIKE 'PARTIAL%' THEN round_even(cover, 6) ELSE 0.0 END AS coverage,
 CASE match_type WHEN 'EXTRA_PREDICTION' THEN 'PREDICTION_FOR_ABSENT_FIELD' WHEN 'NOT_FOUND' THEN 'OCR_NOT_RECOGNIZED' WHEN 'MISMATCH' THEN 'OCR_RECOGNIZED_PARSER_MISSED' WHEN 'PARTIAL_BELOW_80' THEN 'PARTIAL_TEXT_BELOW_80' END AS diagnosis FROM m"""
)
def soft_match(spark, sf_dir):
    k = F.col("p_partkey")
    truth = F.when(k % 13 == 0, "").otherwise(F.col("truth"))
    rows = name_pairs(spark, sf_dir).withColumn("m", matching.match_fields(truth, F.col("pred"), k % 4 != 0))
    return rows.select("p_partkey", "m.match_type", "m.matched", "m.coverage", "m.diagnosis")


@query(
    """WITH p AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%-d/%-m/%Y') AS e, o_totalprice::DECIMAL(18,2) AS v FROM orders),
f AS (SELECT k, 'date' AS form, d AS t, CASE WHEN k % 3 = 0 THEN d WHEN k % 3 = 1 THEN e ELSE NULL END AS p FROM p UNION ALL SELECT k, 'decimal', v::VARCHAR, CASE WHEN k % 2 = 0 THEN replace(v::VARCHAR, '.', ',') ELSE v::VARCHAR END FROM p
  UNION ALL SELECT k, 'duration', 'hơn ' || k % 9 || ' năm', CASE WHEN k % 2 = 0 THEN 'HƠN ' || k % 9 || ' Năm kinh nghiệm' ELSE k % 9 || ' năm' END FROM p UNION ALL SELECT k, 'tokens', 'A-' || k || ' / b', CASE WHEN k % 2 = 0 THEN 'a ' || k || ', B' ELSE 'a ' || k || ' B c' END FROM p)
SELECT k, form, CASE WHEN p IS NULL THEN 'NOT_FOUND' WHEN t = p THEN 'RAW_EXACT' WHEN form IN ('date', 'decimal') OR k % 2 = 0 THEN 'CANONICAL_EXACT' WHEN form = 'tokens' THEN 'ACCEPTED_PARTIAL' ELSE 'MISMATCH' END AS match_type,
 CASE WHEN p IS NULL THEN 'OCR_NOT_RECOGNIZED' WHEN form = 'duration' AND k % 2 <> 0 THEN 'OCR_RECOGNIZED_PARSER_MISSED' END AS diagnosis, form = 'tokens' AND k % 2 <> 0 AS over_extraction,
 CASE WHEN p IS NULL OR t = p OR (k % 2 <> 0 AND form IN ('duration', 'tokens')) THEN NULL WHEN form = 'date' THEN 'DATE_FORMAT_ONLY' WHEN form = 'decimal' THEN 'DECIMAL_FORMAT_ONLY' WHEN form = 'duration' THEN 'DURATION_LABEL_ONLY' ELSE 'CASE_PUNCTUATION_LAYOUT_ONLY' END AS reason FROM f"""
)
def canonical_match(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    iso, dmy, price, s = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "d/M/yyyy"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), k.cast("string")
    years = (k % 9).cast("string")
    cells = F.array(
        F.struct(F.lit("date").alias("form"), iso.alias("t"), F.when(k % 3 == 0, iso).when(k % 3 == 1, dmy).alias("p")),
        F.struct(F.lit("decimal").alias("form"), price.alias("t"), F.when(k % 2 == 0, F.replace(price, F.lit("."), F.lit(","))).otherwise(price).alias("p")),
        F.struct(F.lit("duration").alias("form"), F.concat(F.lit("hơn "), years, F.lit(" năm")).alias("t"), F.when(k % 2 == 0, F.concat(F.lit("HƠN "), years, F.lit(" Năm kinh nghiệm"))).otherwise(F.concat(years, F.lit(" năm"))).alias("p")),
        F.struct(F.lit("tokens").alias("form"), F.concat(F.lit("A-"), s, F.lit(" / b")).alias("t"), F.when(k % 2 == 0, F.concat(F.lit("a "), s, F.lit(", B"))).otherwise(F.concat(F.lit("a "), s, F.lit(" B c"))).alias("p")),
    )
    rows = o.select(k.alias("k"), F.explode(cells).alias("c")).select("k", "c.*").withColumn("m", matching.canonical_fields(F.col("t"), F.col("p"), F.col("form"), F.col("form") == "tokens"))
    return rows.select("k", "form", "m.match_type", "m.diagnosis", "m.over_extraction", "m.reason")


@query(f"WITH t AS ({TRUTH_FIELDS}), b AS (SELECT case_id, name, min(value) AS value FROM ({PRED_FIELDS}) GROUP BY ALL), n AS (SELECT case_id, name, CASE WHEN case_id % 8 = 0 THEN 'Y' ELSE value END AS value FROM t) SELECT case_id, name, b.value AS base_value, n.value AS new_value FROM t JOIN b USING (case_id, name) JOIN n USING (case_id, name) WHERE b.value = t.value AND n.value IS DISTINCT FROM t.value")
def regression_join(spark, sf_dir):
    truth, pred = field_tables(spark, sf_dir)
    truth = truth.select("case_id", "name", "value")
    base = pred.groupBy("case_id", "name").agg(F.min("value").alias("value"))
    new = truth.withColumn("value", F.when(F.col("case_id") % 8 == 0, "Y").otherwise(F.col("value")))
    return matching.regressions(truth, base, new, ["case_id", "name"])


CHOICES = [0.01, 0.03, 0.05, 0.07]


@query(
    f"""WITH l AS (SELECT l_suppkey AS document, l_discount AS c, l_quantity > 20 AS b, l_tax > 0.03 AS o, unnest({CHOICES}::DOUBLE[]) AS threshold FROM lineitem),
s AS (SELECT document, threshold, count(*) FILTER (c < threshold AND b AND NOT o) AS losses, count(*) FILTER (CASE WHEN c < threshold THEN o ELSE b END) AS exact, count(*) FILTER (c < threshold) AS switches FROM l GROUP BY ALL),
r AS (SELECT document, threshold, sum(losses) OVER w - losses AS losses, sum(exact) OVER w - exact AS exact, sum(switches) OVER w - switches AS switches FROM s WINDOW w AS (PARTITION BY threshold))
SELECT document, threshold, exact::BIGINT AS rest_exact FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY losses, exact DESC, switches, threshold) AS rn FROM r) WHERE rn = 1"""
)
def lodo_threshold(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.col("l_discount").alias("confidence"), (F.col("l_quantity") > 20).alias("base_exact"), (F.col("l_tax") > 0.03).alias("other_exact"))
    return matching.thresholds(lines, CHOICES)


def readings(spark, sf_dir):
    n = F.col("l_linenumber")
    value = F.when(n % 4 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), n.alias("reader"), (n % 3).alias("family"), value.alias("value"), F.col("l_discount").alias("confidence"))


CONSENSUS = """WITH c AS (SELECT l_orderkey AS case_id, l_linenumber AS reader, l_linenumber % 3 AS family, CASE WHEN l_linenumber % 4 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS value, l_discount AS confidence FROM lineitem),
e AS (SELECT case_id, lower(value) AS f, value, count(DISTINCT reader) AS m, count(DISTINCT family) AS fam, round_even(avg(confidence), 6) AS conf FROM c GROUP BY ALL),
l AS (SELECT case_id, lower(value) AS f, count(DISTINCT reader) AS fm, count(DISTINCT family) AS ff FROM c GROUP BY ALL),
b AS (SELECT case_id, value, CASE WHEN m >= 2 THEN 2 WHEN fm >= 2 THEN 1 ELSE 0 END AS lv, CASE WHEN m >= 2 THEN m ELSE fm END AS mm, CASE WHEN m >= 2 THEN fam ELSE ff END AS gg, conf FROM e JOIN l USING (case_id, f)),
w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY lv DESC, mm DESC, gg DESC, conf DESC, value) AS rn FROM b),
agreed AS (SELECT case_id, value, mm AS members, gg AS families, ['SINGLE', 'FOLDED', 'EXACT'][lv + 1] AS rule, lv > 0 AND gg >= 2 AS accepted FROM w WHERE rn = 1)"""


@query(f"{CONSENSUS} SELECT * FROM agreed")
def consensus_select(spark, sf_dir):
    return matching.consensus(readings(spark, sf_dir), ["case_id"], F.lower("value"))


@query(f"{CONSENSUS}, base AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS value, 'ACCEPTED' AS status FROM orders) SELECT b.case_id, CASE WHEN b.value = '' AND a.value IS NOT NULL THEN a.value ELSE b.value END AS value, CASE WHEN b.value = '' AND a.value IS NOT NULL THEN 'NEEDS_REVIEW' ELSE b.status END AS status, (b.value = '' AND a.value IS NOT NULL) AS recovered FROM base b LEFT JOIN (SELECT * FROM agreed WHERE members >= 2 AND families >= 2) a USING (case_id)")
def guarded_recovery(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"), F.lit("ACCEPTED").alias("status"))
    return matching.recover(base, matching.consensus(readings(spark, sf_dir), ["case_id"], F.lower("value")), ["case_id"])


FIELDS = ["identityNumber", "fullName", "dateOfExpiry", "sex", "placeOfOrigin"]
PROFILES = ["vietocr_vgg_seq2seq", "vietocr_vgg_transformer", "easyocr", "paddle_v4", "other", None]
FIELD_SQL = f"{FIELDS}[{{k}} % 5 + 1]"
READING = """CASE l_orderkey % 5 WHEN 0 THEN CASE WHEN l_linenumber % 4 = 0 THEN 'CCCD ' || l_linenumber ELSE lpad((l_orderkey + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::VARCHAR, 12, '0') END
  WHEN 1 THEN CASE WHEN l_linenumber % 5 = 0 THEN 'Full name An' WHEN l_linenumber % 3 = 0 THEN 'NGUYEN VAN ' || l_returnflag ELSE 'NGUYỄN VĂN ' || l_returnflag END
  WHEN 2 THEN CASE WHEN l_linenumber % 4 = 0 THEN '31/02/2030' WHEN l_linenumber % 4 = 1 AND l_suppkey % 2 = 0 THEN ' ' ELSE '0' || (1 + l_suppkey % 3) || '/12/2030' END
  WHEN 3 THEN CASE WHEN l_linenumber % 3 = 0 THEN 'Nam' WHEN l_linenumber % 3 = 1 THEN 'Nữ' ELSE l_returnflag END
  ELSE CASE WHEN l_linenumber % 4 = 0 THEN 'Quê quán Huế' WHEN l_linenumber % 2 = 0 THEN 'Xã ' || l_returnflag ELSE 'Xa ' || l_returnflag || ' ' END END"""
BASELINE = "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Full name: x' ELSE '' END ELSE ['000000000000', 'TRẦN BÌNH', '01/01/2031', 'Nam', 'Xã Khác'][o_orderkey % 5 + 1] END"
_FOLDED = "trim(regexp_replace(strip_accents(lower({v})), '[^a-z0-9]+', ' ', 'g'))"
_HOLDS = lambda names: f"len(list_filter({names}, lambda x: contains({_FOLDED}, x))) > 0"
_PLACE = [x for f in ("fullName", "dateOfBirth", "placeOfOrigin", "placeOfResidence") for x in recovery.LABELS[f]]
PROBLEM = f"""CASE WHEN coalesce({{v}}, '') = '' THEN 'EMPTY' WHEN NOT CASE {{f}} WHEN 'identityNumber' THEN regexp_full_match({{v}}, '[0-9]{{{{12}}}}') WHEN 'fullName' THEN len(string_split_regex({{v}}, '\\s+')) BETWEEN 2 AND 6 AND NOT regexp_matches({{v}}, '[0-9]')
  WHEN 'dateOfExpiry' THEN regexp_full_match({{v}}, '[0-9]{{{{2}}}}/[0-9]{{{{2}}}}/[0-9]{{{{4}}}}') AND try_strptime({{v}}, '%d/%m/%Y') IS NOT NULL WHEN 'sex' THEN {{v}} IN ('Nam', 'Nữ') ELSE len(string_split_regex({{v}}, '\\s+')) >= 2 END THEN 'INVALID'
  WHEN CASE {{f}} WHEN 'fullName' THEN {_HOLDS(recovery.LABELS["fullName"] + recovery.LABELS["dateOfBirth"])} WHEN 'dateOfExpiry' THEN {_HOLDS(recovery.LABELS["dateOfExpiry"])} WHEN 'placeOfOrigin' THEN {_HOLDS(_PLACE)} ELSE false END THEN 'LABEL' END"""
_FAMILY = "CASE WHEN contains(p, 'vietocr') THEN 'vietocr' WHEN contains(p, 'easyocr') THEN 'easyocr' WHEN contains(p, 'paddle') THEN 'paddle' WHEN p IS NULL THEN 'unknown' ELSE p END"
_WEIGHT = "CASE WHEN contains(p, 'seq2seq') THEN 3 WHEN contains(p, 'transformer') OR contains(p, 'paddle') THEN 2 WHEN contains(p, 'easyocr') THEN 1 ELSE 0 END"


@query(
    f"""WITH r AS (SELECT l_orderkey AS k, {FIELD_SQL.format(k="l_orderkey")} AS field, {[p or "" for p in PROFILES]}[l_linenumber % 6 + 1] AS p0, trim({READING}) AS v, l_discount AS conf FROM lineitem),
a AS (SELECT *, nullif(p0, '') AS p FROM r), b AS (SELECT k, field, v, conf, {_FAMILY} AS fam, {_WEIGHT} AS w, {_FOLDED.format(v="v")} AS fold, len(regexp_replace(v, '[\\x00-\\x7F]', '', 'g')) AS marks, {PROBLEM.format(v="v", f="field")} IS NULL AS safe FROM a),
g AS (SELECT k, field, fold, count(*) AS members, count(DISTINCT fam) AS families, sum(w) AS weight, max(fam = 'vietocr') AS trusted, round_even(avg(conf), 9) AS conf, max({{'w': w, 'c': conf, 'm': marks, 'v': v}}) AS best FROM b WHERE safe GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY families DESC, members DESC, weight DESC, trusted DESC, conf DESC, fold) AS rn FROM g),
n AS (SELECT DISTINCT k, field FROM b), c AS (SELECT n.k, n.field, CASE WHEN members >= 2 AND families >= 2 THEN best.v END AS new, CASE WHEN members IS NULL THEN 'NO_SAFE_READING' WHEN members >= 2 AND families >= 2 THEN 'INDEPENDENT_FAMILIES' ELSE 'TOO_LITTLE_SUPPORT' END AS reason FROM n LEFT JOIN (SELECT * FROM t WHERE rn = 1) t ON t.k = n.k AND t.field = n.field),
o AS (SELECT o_orderkey AS k, {FIELD_SQL.format(k="o_orderkey")} AS field, {BASELINE} AS value FROM orders), d AS (SELECT *, {PROBLEM.format(v="trim(value)", f="field")} AS doubt FROM o),
e AS (SELECT d.*, new, coalesce(reason, 'NO_READING') AS reason, doubt IS NOT NULL AND new IS NOT NULL AS recovered FROM d LEFT JOIN c USING (k, field)), u AS (SELECT k, field, CASE WHEN recovered THEN new ELSE value END AS value, recovered, doubt, reason FROM e)
SELECT k, field, value, CASE WHEN coalesce(trim(value), '') = '' THEN 'NOT_FOUND' ELSE 'NEEDS_REVIEW' END AS status, recovered, doubt, reason FROM u"""
)
def guarded_fields(spark, sf_dir):
    """Readings of one field an order, some unsafe, over a baseline that is missing, unsafe or right."""
    of = lambda k: F.element_at(F.array(*map(F.lit, FIELDS)), (F.col(k) % 5).cast("int") + 1).alias("field")
    as_spark = lambda sql: F.expr(sql.replace("::VARCHAR", "::STRING").replace("['000", "array('000").replace("'Xã Khác'][o_orderkey % 5 + 1]", "'Xã Khác')[o_orderkey % 5]"))
    profile = F.element_at(F.array(*map(F.lit, PROFILES)), (F.col("l_linenumber") % 6).cast("int") + 1)
    readings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), of("l_orderkey"), profile.alias("profile"), as_spark(READING).alias("value"), F.col("l_discount").alias("confidence"))
    baseline = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), of("o_orderkey"), as_spark(BASELINE).alias("value"))
    return recovery.guarded(baseline, readings, ["k"])


@query("SELECT o_custkey, CASE WHEN count(DISTINCT lower(o_orderstatus)) = 1 THEN min(o_orderstatus) END AS value, count(DISTINCT lower(o_orderstatus)) > 1 AS conflict FROM orders GROUP BY o_custkey")
def unique_or_null(spark, sf_dir):
    return matching.unique_or_null(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS distinct_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def conflicts(spark, sf_dir):
    return matching.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT count(*) AS cases, round_even(count(*) FILTER (l_returnflag <> '' AND l_returnflag = l_linestatus) / count(*)::DOUBLE, 6) AS agreement, coalesce(round_even(count(*) FILTER (l_returnflag = l_linestatus AND l_returnflag = o_orderstatus) / nullif(count(*) FILTER (l_returnflag = l_linestatus), 0)::DOUBLE, 6), 0) AS agreement_precision, round_even(count(*) FILTER (l_returnflag = o_orderstatus OR l_linestatus = o_orderstatus) / count(*)::DOUBLE, 6) AS oracle FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def reader_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return matching.agreement(rows, "l_returnflag", "l_linestatus", "o_orderstatus")


@query("SELECT o_orderpriority AS category, o_orderstatus AS status, count(*) AS fields, round_even(count(*) FILTER (o_totalprice > 100000) / count(*)::DOUBLE, 6) AS high_rate, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())")
def aggregate_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    sets = o.groupingSets([["category", "status"], ["category"], []], "category", "status")
    return sets.agg(F.count("*").alias("fields"), rate(F.count_if(F.col("o_totalprice") > 100000), F.count("*")).alias("high_rate"), F.grouping_id().alias("level"))


def pages_of_names(spark, sf_dir):
    """Part names as lines of pages of fifty, the larger parts read by a recognizer, the others native."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("page"), F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_size")
    return part.where("p_size > 25"), part.where("p_size <= 25")


@query()
def fuzzy_anti(spark, sf_dir):
    """Recognized lines that no native line of their page resembles."""
    return matching.fuzzy_anti(*pages_of_names(spark, sf_dir), "page", "text", 0.86)


@query()
def merged_readings(spark, sf_dir):
    scanned, native = pages_of_names(spark, sf_dir)
    return matching.merged_readings(native, scanned, "page", "text", 0.86)


READ = """SELECT p_brand, p_size::DOUBLE AS duration, CASE WHEN p_partkey % 3 = 0 THEN 0.97 ELSE 0.9 END AS confidence, 'Đặng  ' || p_name || ' ế' AS truth, CASE p_partkey % 6 WHEN 0 THEN 'Đặng ' || p_name || ' ế' WHEN 1 THEN ' Dang ' || p_name || ' e' WHEN 2 THEN 'Đặng ' || p_name || ' ế x' WHEN 3 THEN 'Đặng ế' WHEN 4 THEN 'Đ' || loose.a || 'ng ' || p_name || ' ' || loose.e END AS pred, p_partkey % 6 AS m, p_name"""


@query(
    f"""WITH loose(a, e) AS (SELECT 'a' || chr(803) || chr(774), 'e' || chr(770) || chr(769)), r AS ({READ} FROM part, loose),
s AS (SELECT *, 'Đặng ' || p_name || ' ế' AS t, CASE m WHEN 4 THEN 'Đặng ' || p_name || ' ế' WHEN 5 THEN '' ELSE trim(pred) END AS p, len(string_split(p_name, ' ')) + 2 AS w FROM r),
e AS (SELECT *, CASE m WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN length(p_name) + 1 WHEN 4 THEN 0 ELSE length(t) END AS ed, CASE m WHEN 1 THEN 3 ELSE 0 END AS md, CASE m WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN w - 2 WHEN 5 THEN w ELSE 0 END AS wd FROM s)
SELECT p_brand, count(*) AS cases, count(*) FILTER (t = p) AS exact, sum(length(t))::BIGINT AS chars, sum(ed)::BIGINT AS char_errors, sum(w)::BIGINT AS words, sum(wd)::BIGINT AS word_errors, sum(3)::BIGINT AS marks, sum(md)::BIGINT AS mark_errors, count(*) FILTER (m = 4) AS nfc_violations, count(*) FILTER (confidence >= 0.95) AS accepted, count(*) FILTER (confidence >= 0.95 AND t = p) AS accepted_exact,
 round_even(count(*) FILTER (t = p) / count(*)::DOUBLE, 6) AS exact_rate, round_even(sum(ed) / sum(length(t))::DOUBLE, 6) AS cer, round_even(sum(wd) / sum(w)::DOUBLE, 6) AS wer, round_even(sum(md) / (3 * count(*))::DOUBLE, 6) AS der, coalesce(round_even(count(*) FILTER (confidence >= 0.95 AND t = p) / nullif(count(*) FILTER (confidence >= 0.95), 0)::DOUBLE, 6), 0) AS accepted_precision, 0.95::DOUBLE AS threshold, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95 FROM e GROUP BY p_brand"""
)
def recognition_report(spark, sf_dir):
    """Readings of six kinds: right, marks lost, a word more, the middle lost, not composed, none."""
    loose = F.struct(F.lit("a\u0323\u0306").alias("a"), F.lit("e\u0302\u0301").alias("e"))
    parts = table(spark, sf_dir, "part").withColumn("loose", loose)
    rows = spark.sql(f"{READ} FROM {{parts}}".replace("p_size::DOUBLE", "CAST(p_size AS DOUBLE)"), parts=parts)
    return metrics.recognition_report(rows, ["p_brand"])
