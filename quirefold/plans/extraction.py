"""Queries over extraction, field maps and recognizer policies; labelled lines are made from columns of the star schema."""

from pyspark.sql import functions as F

from quirefold.functions import text as t
from quirefold.operators import extract, observe, policy, quantiles
from quirefold.plans.registry import query, table

CONTRACT_LINES = """SELECT o_orderkey AS doc_id, unnest([0, 1, 2, 3, 4])::INT AS seq, unnest(['Số hợp đồng: ' || o_orderkey, 'Signed by employee name: ' || c_name, CASE WHEN o_orderkey % 4 = 0 THEN 'Ngày bắt đầu ' ELSE 'Ngày bắt đầu: ' END || strftime(o_orderdate, '%Y-%m-%d'), 'Salary： ' || o_orderstatus, 'End date:']) AS text FROM orders JOIN customer ON o_custkey = c_custkey"""
KINDS = "CASE WHEN o_orderkey % 5 = 0 THEN 'LEAVE_REQUEST' ELSE 'EMPLOYMENT_CONTRACT' END"


def contracts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    start = F.when(k % 4 == 0, "Ngày bắt đầu ").otherwise("Ngày bắt đầu: ")
    lines = F.array(F.concat(F.lit("Số hợp đồng: "), k.cast("string")), F.concat(F.lit("Signed by employee name: "), "c_name"), F.concat(start, F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Salary： "), "o_orderstatus"), F.lit("End date:"))
    kind = F.when(k % 5 == 0, "LEAVE_REQUEST").otherwise("EMPLOYMENT_CONTRACT")
    return o.select(k.alias("doc_id"), kind.alias("document_type"), F.posexplode(lines).alias("seq", "text"))


LABELLED = f"""l AS (SELECT doc_id, seq, trim(split_part(replace(text, '：', ':'), ':', 1)) AS label, trim(split_part(replace(text, '：', ':'), ':', 2)) AS value, CASE WHEN doc_id % 5 = 0 THEN 'LEAVE_REQUEST' ELSE 'EMPLOYMENT_CONTRACT' END AS kind FROM ({CONTRACT_LINES}) WHERE text LIKE '%:%' OR text LIKE '%：%'),
f AS (SELECT *, trim(regexp_replace(replace(strip_accents(replace(lower(label), 'đ', '#')), '#', ' '), '[^a-z0-9]+', ' ', 'g')) AS lab FROM l WHERE value <> ''),
a(kind, name, sensitive, alias) AS (VALUES {', '.join(f"('{k}', '{n}', {s}, '{x}')" for k, n, s, al in extract.FIELDS for x in dict.fromkeys(map(extract.folded_alias, al)))}),
fields AS (SELECT DISTINCT doc_id, seq, name, value, 0.96::DOUBLE AS confidence, sensitive FROM f JOIN a USING (kind) WHERE lab = alias OR lab LIKE '% ' || alias)"""


@query(f"WITH {LABELLED} SELECT * FROM fields")
def labelled_fields(spark, sf_dir):
    return extract.labelled(contracts(spark, sf_dir))


@query(
    f"""WITH {LABELLED}, d AS (SELECT o_orderkey AS doc_id, {KINDS} AS kind FROM orders), r(kind, name) AS (VALUES {', '.join(f"('{k}', '{n}')" for k, v in extract.REQUIRED.items() for n in v)})
SELECT d.doc_id, coalesce(string_agg(r.name, ',' ORDER BY r.name) FILTER (NOT EXISTS (SELECT 1 FROM fields WHERE fields.doc_id = d.doc_id AND fields.name = r.name)), '') AS missing FROM d JOIN r USING (kind) GROUP BY d.doc_id"""
)
def required_fields(spark, sf_dir):
    lines = contracts(spark, sf_dir)
    kind = F.when(F.col("o_orderkey") % 5 == 0, "LEAVE_REQUEST").otherwise("EMPLOYMENT_CONTRACT")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), kind.alias("document_type"))
    return extract.missing_fields(extract.labelled(lines), docs).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query(
    """WITH p AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS s FROM conversations), q AS (SELECT *, min(CASE WHEN role = 'assistant' AND turn > s THEN turn END) OVER (PARTITION BY conv_id) AS e FROM p)
SELECT conv_id, turn, role FROM q WHERE s IS NULL OR (turn >= s AND (e IS NULL OR turn < e))"""
)
def party_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return extract.party(rows, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


@query()
def narratives(spark, sf_dir):
    return extract.narrative(observe.lines(table(spark, sf_dir, "documents")), "doc_id", "seq", "text")


@query(
    """WITH n AS (SELECT conv_id, turn, role, lead(text, 1) OVER w AS a, lead(text, 2) OVER w AS b, lead(text, 3) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(coalesce(CASE WHEN length(a) < 200 THEN a END, CASE WHEN length(b) < 200 THEN b END, CASE WHEN length(c) < 200 THEN c END)) AS value_md5 FROM n WHERE role = 'user'"""
)
def first_acceptable(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return extract.first_acceptable(rows, "conv_id", "turn", "text", F.col("role") == "user", lambda x: F.length(x) < 200).select("conv_id", "turn", F.md5("value").alias("value_md5"))


@query("SELECT o_orderkey AS k, o_orderstatus AS status_code, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderpriority END AS priority, o_orderkey % 3 = 0 AS corrected FROM orders")
def correction_overlay(spark, sf_dir):
    data = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("derivedTotal"), F.col("o_totalprice").cast("string"))
    fix = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("priority"), F.lit("X")))
    m = extract.renamed(extract.overlay(data, fix, ["derivedTotal"]), {"status": "status_code"})
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), m.alias("m"), fix.isNotNull().alias("corrected"))
    return rows.where("NOT map_contains_key(m, 'derivedTotal')").select("k", F.col("m")["status_code"].alias("status_code"), F.col("m")["priority"].alias("priority"), "corrected")


@query(
    """WITH f AS (SELECT l_orderkey AS case_id, CASE WHEN l_discount > 0.02 THEN l_returnflag END AS value, CASE WHEN l_discount <= 0.02 THEN 'NOT_FOUND' WHEN l_tax > 0.04 THEN 'NEEDS_REVIEW' ELSE 'ACCEPTED' END AS status FROM lineitem)
SELECT case_id, count(*) AS expected, count(value) AS present, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status = 'NOT_FOUND') AS not_found, round_even(count(value) / count(*)::DOUBLE, 6) AS completeness, round_even(count(*) FILTER (status = 'ACCEPTED') / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (status = 'ACCEPTED') = count(*) AS ready FROM f GROUP BY case_id"""
)
def field_summary(spark, sf_dir):
    d = F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(d > 0.02, F.col("l_returnflag")).alias("value"), F.when(d <= 0.02, "NOT_FOUND").when(F.col("l_tax") > 0.04, "NEEDS_REVIEW").otherwise("ACCEPTED").alias("status"))
    return extract.field_summary(rows, ["case_id"])


@query("SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('v', 'w'))), ',') AS unexpected, CASE WHEN props LIKE '%\"k\"%' THEN 'k' ELSE '' END AS forbidden FROM events")
def key_checks(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(extract.unexpected_keys(p, ["v", "w"]), ",").alias("unexpected"), F.array_join(extract.forbidden_keys(p, ["k", "rawtext"]), ",").alias("forbidden"))


@query(
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS o, max(CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0.05 AS INT)) AS p FROM lineitem GROUP BY ALL)
SELECT k, o AS header FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, o) AS rn FROM r WHERE o < 20) WHERE rn = 1"""
)
def header_rows(spark, sf_dir):
    points = (F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int")
    return extract.header_row(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), "k", "l_linenumber", points)


READ = "SELECT p_partkey, p_brand, p_name AS primary_text, (p_size % 10) / 10.0::DOUBLE AS confidence, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_type ELSE '' END AS second, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS third FROM part"


def reads(spark, sf_dir):
    k = F.col("p_partkey")
    second = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.col("p_type")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("primary_text"), ((F.col("p_size") % 10) / F.lit(10.0)).alias("confidence"), second.alias("second"), F.when(k % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("third"))


@query(
    f"""SELECT p_partkey, CASE WHEN second <> '' AND lower(second) = lower(third) AND lower(second) <> lower(primary_text) THEN second WHEN confidence < 0.5 AND lower(third) <> lower(primary_text) THEN third ELSE primary_text END AS text,
 CASE WHEN second <> '' AND lower(second) = lower(third) AND lower(second) <> lower(primary_text) THEN 'AGREEMENT' WHEN confidence < 0.5 AND lower(third) <> lower(primary_text) THEN 'LOW_CONFIDENCE' ELSE 'UNCHANGED' END AS rule, CASE WHEN primary_text = third THEN 'verified' ELSE 'needs_review' END AS status FROM ({READ})"""
)
def switch_policy(spark, sf_dir):
    c = F.col
    text, rule = policy.switched(c("primary_text"), c("confidence"), c("second"), c("third"), 0.5)
    return reads(spark, sf_dir).select("p_partkey", text.alias("text"), rule.alias("rule"), policy.verified(c("primary_text"), c("third")).alias("status"))


@query(
    f"""WITH r AS ({READ}), k AS (SELECT p_brand, CASE WHEN p_partkey % 7 = 0 THEN 'ROI_MISS' WHEN third = primary_text THEN 'EXACT' WHEN p_partkey % 5 = 0 THEN 'PARSER_CONTAMINATION' WHEN primary_text IN (second, third) THEN 'SELECTOR_MISS' WHEN lower(primary_text) IN (lower(second), lower(third)) THEN 'DIACRITIC_MISS' ELSE 'RECOGNIZER_MISS' END AS cause FROM r)
SELECT p_brand, cause, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY p_brand)::DOUBLE, 6) AS share FROM k GROUP BY p_brand, cause"""
)
def root_causes(spark, sf_dir):
    c, k = F.col, F.col("p_partkey")
    cause = policy.root_cause(k % 7 != 0, F.array("second", "third"), c("third"), c("primary_text"), k % 5 == 0)
    return policy.error_shares(reads(spark, sf_dir).withColumn("cause", cause), "p_brand", "cause")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'NOT_IN_SOURCE' WHEN primary_text = second THEN 'EXACT' WHEN second = '' THEN 'NOT_FOUND' WHEN lower(primary_text) = lower(second) THEN 'DIACRITICS_ONLY' WHEN p_partkey % 4 = 0 THEN 'GLARE' ELSE 'MISMATCH' END AS status FROM ({READ})")
def field_comparison(spark, sf_dir):
    k = F.col("p_partkey")
    signals = F.when(k % 4 == 0, F.array(F.lit("glare")))
    return reads(spark, sf_dir).select("p_partkey", policy.field_comparison(k % 6 != 0, F.col("primary_text"), F.col("second"), signals).alias("status"))


@query(
    """WITH m AS (SELECT p_type AS profile, p_brand, avg(p_size) AS exact, min(p_size) AS der, max(p_size) AS precision, sum(p_retailprice) AS p95 FROM part GROUP BY ALL)
SELECT p_brand, profile FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY exact DESC, der, precision DESC, p95, profile) AS rn FROM m) WHERE rn = 1"""
)
def best_recognizer(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("profile"), "p_brand").agg(F.avg("p_size").alias("exact"), F.min("p_size").alias("der"), F.max("p_size").alias("precision"), F.sum("p_retailprice").alias("p95"))
    return policy.best_profile(m, "profile", ["p_brand"])


PHRASES = {"small ring": "Small Ring", "red widget": "Red Widget", "economy": "Economy"}


@query()
def fuzzy_phrase(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit("i"), F.lit("l")).alias("read"))
    return policy.corrected(rows, "read", PHRASES, "text").select("p_partkey", "text")


@query(f"WITH l AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) SELECT r AS letter, r IN (SELECT c FROM l) AS available FROM (SELECT unnest({t.vietnamese_letters()}) AS r)")
def charset_coverage(spark, sf_dir):
    """Which of the 134 letters that Vietnamese needs occur in the documents."""
    have = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("letter")).distinct()
    return extract.letter_coverage(have, t.vietnamese_letters())


@query("SELECT event_type, round_even(quantile_cont(value, 0.5), 6) AS p50, list_sort(list(value))[greatest(1, round_even(0.95 * count(*), 0)::INT)] AS p95, count(value) AS samples FROM events GROUP BY event_type")
def pilot_latency(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    high = F.greatest(F.lit(1), F.bround(0.95 * F.col("samples"), 0))
    middle = (F.col("samples") + 1) / 2
    found = quantiles.order_statistics(events, ["event_type"], "value", {"a": F.floor(middle), "b": F.ceil(middle), "p95": high})
    return found.select("event_type", F.bround(F.col("a") + (F.col("b") - F.col("a")) * 0.5, 6).alias("p50"), "p95", "samples")


@query("SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name || ' ' || p_type)), '[^a-z0-9]+', ' ', 'g')) AS folded, len(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> ''))::INT AS n_tokens FROM part")
def token_folds(spark, sf_dir):
    c = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", t.fold_key(c).alias("folded"), F.size(t.tokens(c)).alias("n_tokens"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
v AS (SELECT *, CASE WHEN m IN (1, 3) THEN 'fixed' WHEN m = 4 THEN NULL ELSE p END AS name, CASE m WHEN 2 THEN '31/12/2024' WHEN 5 THEN ' ' ELSE d END AS day FROM o)
SELECT k, coalesce(name, '') AS name, trim(day) AS day, concat_ws(',', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN m = 5 THEN 'day' END) AS missing,
 concat_ws(',', CASE WHEN m IN (0, 2) THEN 'MULTIPLE_CANDIDATES:name' END, CASE WHEN name IS NULL THEN 'REQUIRED_FIELD_MISSING:name' END, CASE WHEN m = 5 THEN 'REQUIRED_FIELD_MISSING:day' END, CASE WHEN m = 2 THEN 'INVALID_FORMAT:day' END) AS errors,
 CASE WHEN m IN (0, 2, 4, 5) THEN 'MANUAL_REVIEW' ELSE 'AUTO_CONTINUE' END AS action, true AS without_derived FROM v"""
)
def revalidated_corrections(spark, sf_dir):
    """Stored results with old names, conflicts and derived keys, some of them corrected, checked again."""
    m = F.col("o_orderkey") % 6
    old = {"fullName": "name", "startDay": "day"}
    data = F.create_map(F.lit("fullName"), F.when(m != 4, F.col("o_orderpriority")), F.lit("startDay"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("confidence"), F.lit("0.5"))
    pair = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    fixes = F.when(m.isin(1, 3), pair("name", "fixed")).when(m == 2, pair("day", "31/12/2024")).when(m == 5, pair("day", " "))
    stored = F.when(m.isin(0, 1, 2), F.array(F.lit("MULTIPLE_CANDIDATES:fullName"), F.lit("LOW_QUALITY"))).otherwise(F.array(F.lit("REQUIRED_FIELD_MISSING:startDay")))
    r = extract.revalidated(extract.renamed(data, old), fixes, extract.renamed_errors(stored, old), ["name", "day"], ["confidence", "missingFields"], {"day": r"^\d{4}-\d{2}-\d{2}$"})
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), r.alias("r"))
    got = lambda n: F.coalesce(F.trim(F.element_at("r.data", n)), F.lit("")).alias(n)
    return rows.select("k", got("name"), got("day"), F.array_join("r.missing", ",").alias("missing"), F.array_join("r.errors", ",").alias("errors"), "r.action", (~F.map_contains_key("r.data", "confidence")).alias("without_derived"))
