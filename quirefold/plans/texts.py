"""Queries over scalar functions, projections and state. Texts are written from columns, so the SQL knows what comes out."""

from pyspark.sql import functions as F

from quirefold.functions import dates, numbers
from quirefold.functions import text as t
from quirefold.operators import extract, governance, jsontree, observe, state
from quirefold.plans.registry import query, table, wide


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def said(*xs):
    """Columns by name where marked with a colon, other strings as they are, in one text."""
    return F.concat(*(x if not isinstance(x, str) else F.col(x[1:]).cast("string") if x.startswith(":") else F.lit(x) for x in xs))


@query("SELECT p_partkey, 'Kỹ sư Công nghệ n' || p_partkey || 'z' AS repaired, 'n' || p_partkey || 'z sự' AS without_repeat, 'việc ' || p_brand AS trimmed, 'đi khám ' || p_brand AS committed FROM part")
def text_repairs(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "p_partkey",
        t.repaired(said("K sưư  Cng ngh n", ":p_partkey", "z")).alias("repaired"),
        t.without_final_repeat(said("n", ":p_partkey", "z  sựự")).alias("without_repeat"),
        t.trimmed_at(said("việc ", ":p_brand", " Chức VỤ: xyz"), ["không có", "chuc vu:"]).alias("trimmed"),
        t.without_commitment(said("đi khám ", ":p_brand", ". Tôi dự kiến trở lại. Kính mong")).alias("committed"),
    )


@query(
    """SELECT p_partkey, levenshtein(lower(p_name), lower(b)) <= 1 AS near, regexp_matches(p_name, array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: c), '.*')) AS inside
FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'x' WHEN 2 THEN substr(p_name, 2) ELSE p_name || 'xy' END AS b, replace(CASE WHEN p_partkey % 3 = 0 THEN reverse(p_name) ELSE p_name END, 'e', '') AS s FROM part)"""
)
def letter_tests(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(n, F.lit("x"))).when(k % 4 == 2, F.substr(n, F.lit(2))).otherwise(F.concat(n, F.lit("xy")))
    short = F.replace(F.when(k % 3 == 0, F.reverse(n)).otherwise(n), F.lit("e"), F.lit(""))
    return parts(spark, sf_dir).select("p_partkey", t.near_equal(n, other).alias("near"), t.within_in_order(short, n).alias("inside"))


@query(
    """SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') || ',2024-02-29' AS named, strftime(o_orderdate, '%Y-%m-%d') AS typed, CASE WHEN o_orderkey % 2 = 0 THEN 'trên|' ELSE '|' END || o_orderkey % 9 || '.5|' || CASE WHEN o_orderkey % 2 = 0 THEN 'năm' ELSE 'year' END AS duration,
 40.0 + 5.0 * (o_orderkey % 3) AS weekly, (o_orderkey % 7) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.5' END AS shown, o_orderkey % 10 < 19 AND (o_orderkey % 10) / 1 <= 9 AS half FROM orders"""
)
def spoken_values(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = lambda f: F.date_format(d, f)
    named = F.concat(F.lit("NGÀY "), day("d"), F.lit(" tháng "), day("M"), F.lit(" năm "), day("yyyy"), F.lit(", ngày 31 tháng 2 năm 2024 và ngày 29 tháng 2 năm 2024"))
    typed = F.when(k % 3 == 0, day("yyyy-MM-dd")).when(k % 3 == 1, F.concat(F.lit("on "), day("d/M/yyyy"))).otherwise(F.concat(F.lit("ngày"), day("d"), F.lit(" th "), day("M"), F.lit(" năm "), day("yyyy")))
    years = F.when(k % 2 == 0, F.concat(F.lit("Trên  "), (k % 9).cast("string"), F.lit(",5 Năm kinh nghiệm"))).otherwise(F.concat((k % 9).cast("string"), F.lit(".5 years")))
    hours = F.concat(F.lit("8h - 12h, 13h30 - "), (17 + k % 3).cast("string"), F.lit("h30"))
    shown = F.concat((k % 7).cast("string"), F.when(k % 2 == 0, ",0").otherwise(",50"))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.array_join(F.transform(dates.named_dates(named), lambda x: x.cast("string")), ",").alias("named"), dates.typed_date(typed).cast("string").alias("typed"), dates.duration_key(years).alias("duration"),
        dates.weekly_hours(hours).alias("weekly"), numbers.shown_number(shown).alias("shown"), numbers.half_step((k % 10).cast("double")).alias("half"),
    )


@query()
def label_scores(spark, sf_dir):
    """How well a part's name fits a label."""
    return parts(spark, sf_dir).select("p_partkey", t.label_likeness(t.fold_key(F.col("p_name")), F.lit("blue widget")).alias("score"))


@query()
def phone_candidates(spark, sf_dir):
    text = F.concat_ws(" ", F.lit("tel"), F.concat(F.lit("+84 912-345-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")), F.lit("or 0912345678901234 or 0987.654.321"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(t.identifiers(text, "phone"), ",").alias("phones"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'secret:NOT_ALLOWED' WHEN event_id % 3 = 0 THEN 'documentType:NOT_A_SCALAR' WHEN event_id % 7 = 0 THEN 'errorCode:TOO_LONG' ELSE '' END AS problems, CASE WHEN event_id % 2 = 0 THEN 'rawtext' ELSE '' END AS forbidden FROM events")
def process_variables(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when((k % 3 == 0) & (k % 5 != 0), '{"rawText": 1}').otherwise('"CV \\"rawText\\": x"')
    text = F.when((k % 7 == 0) & (k % 3 != 0) & (k % 5 != 0), F.repeat(F.lit("x"), 5000)).otherwise("E1")
    json = F.concat(F.lit('{"documentType": '), kind, F.lit(', "caseVersion": 3, "reviewRequired": true, "missingFields": null, "errorCode": "'), text, F.lit('"'), F.when(k % 5 == 0, ', "secret": 1').otherwise(""), F.lit("}"))
    nested = F.concat(F.lit('{"a": [{"b": {"'), F.when(k % 2 == 0, "Raw_Text").otherwise("fine"), F.lit('": "\\"rawText\\": 1"}}], "c": "rawtext"}'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(extract.variable_problems(json), ",").alias("problems"), F.array_join(extract.forbidden_keys(nested, ["rawtext", "prediction"]), ",").alias("forbidden"))


@query("SELECT event_id, true AS present, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || '7' || chr(10) || 'true' ELSE '' END AS text, event_id % 3 <> 2 AS second FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, false, '', false FROM events WHERE event_id % 3 = 2")
def nested_lookup(spark, sf_dir):
    k = F.col("event_id")
    own = F.concat(F.lit('{"x": {"y": "'), F.col("event_type"), F.lit('"}}'))
    deep = F.concat(F.lit('{"z": [{"a": "'), F.col("event_type"), F.lit('"}, {"b": 7, "c": [true, null]}]}'))
    json = F.when(k % 3 == 0, own).when(k % 3 == 1, deep).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", extract.first_path(json, ["x.y", "z"]).alias("r")).select("event_id", "r.present", "r.text", F.col("r.present").alias("second"))


@query("SELECT l_orderkey AS k, l_linenumber AS f, min(l_returnflag) AS value, min(CASE WHEN l_orderkey % 3 <> 0 THEN l_linestatus END) AS truth FROM lineitem GROUP BY ALL")
def truth_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("f")).agg(F.min("l_returnflag").alias("value"), F.min("l_linestatus").alias("s"))
    return extract.with_truth(rows.select("k", "f", "value"), rows.where("k % 3 <> 0").select("k", "f", F.col("s").alias("value")), ["k", "f"])


@query("WITH f AS (SELECT o_orderkey % 11 <> 0 AS confirmed, o_orderkey % 7 = 0 AS matched, o_orderkey % 3 = 0 AS exact, o_orderkey % 2 = 0 AS raw, o_orderkey % 5 <> 0 AS predicted, o_orderkey % 13 = 0 AS competing FROM orders) SELECT CASE WHEN NOT confirmed THEN 'GROUND_TRUTH_REVIEW' WHEN matched THEN 'NORMALIZATION' WHEN raw AND (NOT predicted OR competing) THEN 'PARSER_BOUNDARY' ELSE 'OCR_RECOGNITION' END AS cause, count(*) AS fields, true AS consistent FROM f WHERE NOT exact GROUP BY 1")
def mismatch_causes(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 11 != 0).alias("confirmed"), (k % 7 == 0).alias("matched"), (k % 3 == 0).alias("exact"), (k % 2 == 0).alias("raw_present"), (k % 5 != 0).alias("predicted"), (k % 13 == 0).alias("competing"))
    return extract.attributed(rows)


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'diacritic_disagreement' WHEN 1 THEN 'character_omission' WHEN 2 THEN 'label_contamination' WHEN 3 THEN 'character_substitution' ELSE 'region_or_line_merge' END AS signals FROM orders")
def reading_signals(spark, sf_dir):
    k = F.col("o_orderkey")
    texts = lambda *xs: F.array(*map(F.lit, xs))
    values = F.when(k % 5 == 0, texts("Bình", "Binh", "")).when(k % 5 == 1, texts("Binh", "Bnh")).when(k % 5 == 2, texts("Họ tên Binh", "Họ tên Binh")).when(k % 5 == 3, texts("Binh", "Bonh")).otherwise(texts("Binh"))
    raw = F.when(k % 5 == 4, texts("Binh Ngày sinh")).otherwise(values)
    found = extract.reading_signals(values, raw, texts(r"ngày\s+sinh"), texts(r"họ\s+tên", r"ngày\s+sinh"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(found, ",").alias("signals"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i)::INT - 1 AS seq, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END AS page, md5(text) AS text_md5 FROM (SELECT conv_id, turn, unnest(CASE WHEN role = 'user' THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ELSE list_filter([trim(text)], lambda x: x <> '') END) AS text, generate_subscripts(CASE WHEN role = 'user' THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ELSE list_filter([trim(text)], lambda x: x <> '') END, 1) AS i FROM conversations)")
def native_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("page", F.when(F.col("turn") % 3 != 0, F.col("turn")))
    return observe.native_lines(rows, "conv_id", "turn", F.col("role") == "user").select("conv_id", "seq", "page", F.md5("text").alias("text_md5"))


@query(
    """WITH a AS (SELECT l_orderkey AS k, 0 AS p, l_linenumber % 2 AS x0, min(l_partkey) AS x1, 0 AS x2, CASE WHEN l_linenumber % 2 = 0 THEN 'k: ' || min(l_returnflag) ELSE min(l_returnflag) END AS text FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey, l_linenumber),
b AS (SELECT DISTINCT l_orderkey AS k, 1 AS p, 0 AS x0, 0 AS x1, 0 AS x2, 'loose' AS text FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS k, 2 AS p, 0 AS x0, -1 AS x1, 0 AS x2, 'Sheet' AS text FROM lineitem WHERE l_linenumber >= 3), c AS (SELECT l_orderkey AS k, 2 AS p, 0 AS x0, l_linenumber AS x1, 0 AS x2, min(l_linestatus) AS text FROM lineitem WHERE l_linenumber >= 3 GROUP BY l_orderkey, l_linenumber)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY p, x0, x1, x2)::INT - 1 AS seq, text FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM s UNION ALL SELECT * FROM c)"""
)
def content_rows(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), F.col("l_linenumber")
    pages = li.where("l_linenumber < 3").groupBy("k", "l_linenumber").agg(F.min("l_partkey").alias("block"), F.min("l_returnflag").alias("text")).select("k", (n % 2).alias("page"), "block", F.when(n % 2 == 0, "key_value").otherwise("paragraph").alias("kind"), "text", F.lit("k").alias("label"))
    pages = pages.unionByName(pages.select("k", "page", (F.col("block") + 1).alias("block"), F.lit("paragraph").alias("kind"), F.lit("  ").alias("text"), "label"))
    loose = li.select("k").distinct().select("k", F.lit(0).alias("block"), F.lit("paragraph").alias("kind"), F.lit(" loose ").alias("text"), F.lit(None).cast("string").alias("label"))
    cells = li.where("l_linenumber >= 3").groupBy("k", "l_linenumber").agg(F.min("l_linestatus").alias("text")).select("k", F.lit(0).alias("sheet_no"), F.lit("Sheet").alias("sheet"), n.alias("row"), F.lit(0).alias("column"), "text")
    return observe.content_rows(pages, loose, cells, "k")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def unassigned_users(spark, sf_dir):
    return state.unassigned(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_regionkey <> 2"), "c_nationkey", "n_nationkey").select("c_custkey")


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def event_log(spark, sf_dir):
    log = spark.range(1).select(F.lit(1000).cast("long").alias("seq"))
    return state.appended(log, table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "seq")


@query("WITH a AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS opened_at, max(event_id) FILTER (event_type = 'purchase') AS e FROM events GROUP BY user_id) SELECT user_id, opened_at, CASE WHEN e > opened_at THEN e END AS finished_at, CASE WHEN e > opened_at THEN 'FINAL' ELSE 'OPEN' END AS status FROM a WHERE opened_at IS NOT NULL ORDER BY opened_at DESC, user_id LIMIT 500")
def archives(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return state.archive(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("SELECT event_id, user_id, event_id % 4 <> 0 AS unread FROM events WHERE event_type = 'purchase'")
def unread_notes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return state.marked_read(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_id % 4 = 0"), ["event_id", "user_id"])


@query(
    """WITH r AS (SELECT doc_id, n_chars > 1000 AS pref, sha256(doc_id::VARCHAR) AS h FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY pref ORDER BY h, doc_id) AS place FROM r), t AS (SELECT *, CASE WHEN pref AND place <= 85 THEN 0 WHEN NOT pref THEN 1 ELSE 2 END AS turn FROM k)
SELECT doc_id FROM t ORDER BY turn, place LIMIT 100"""
)
def backfilled_sample(spark, sf_dir):
    return governance.backfilled_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") > 1000, "doc_id", 100).select("doc_id")


@query(
    """WITH s AS (SELECT o_orderkey AS k, ['SQL Hadop', 'SQL Spark', 'Pythn, Javaa'][(o_orderkey % 3)::INT + 1] AS skills FROM orders) SELECT k, CASE skills WHEN 'SQL Hadop' THEN 'SQL Hadoop' WHEN 'Pythn, Javaa' THEN 'Python, Javaa' ELSE skills END AS skills FROM s"""
)
def skill_repair(spark, sf_dir):
    from quirefold.operators.templates import repaired_skills

    k = F.col("o_orderkey")
    skills = F.element_at(F.array(F.lit("SQL Hadop"), F.lit("SQL Spark"), F.lit("Pythn, Javaa")), (k % 3).cast("int") + 1)
    return table(spark, sf_dir, "orders").select(k.alias("k"), repaired_skills(skills, F.lit("Built Hadoop and Python jobs in Java")).alias("skills"))


@query("SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'An' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Binh' END) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'lead' END AS title FROM orders")
def region_fill(spark, sf_dir):
    from quirefold.operators.templates import filled, region_evidence

    k = F.col("o_orderkey")
    own = F.map_filter(F.create_map(F.lit("name"), F.when(k % 3 == 0, "An")), lambda _, v: v.isNotNull())
    json = F.when(k % 2 == 0, '[{"field": "name", "text": "Binh. "}, {"field": "name", "text": "later"}, {"field": "title", "text": "lead"}, {"text": "x"}]').otherwise("not json")
    both = filled(own, region_evidence(json))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.element_at(both, "name").alias("name"), F.element_at(both, "title").alias("title"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN least((o_orderkey % 10) / 10.0::DOUBLE, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.5 END) ELSE (o_orderkey % 10) / 10.0::DOUBLE END AS confidence FROM orders")
def scanned_confidence(spark, sf_dir):
    from quirefold.operators.templates import scanned_confidence as bounded

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), bounded((k % 10) / F.lit(10.0), k % 2 == 0, F.when(k % 3 != 0, F.lit(0.5))).alias("confidence"))


@query(
    """WITH f AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS missing, o_orderkey % 3 = 0 AS conflict, o_orderkey % 5 = 0 AS sensitive FROM orders)
SELECT k, missing AS critical, NOT missing AS complete, conflict AS inconsistent, sensitive, CASE WHEN missing THEN 'REQUEST_REUPLOAD' WHEN sensitive OR conflict THEN 'HR_REVIEW' ELSE 'USER_REVIEW' END AS action FROM f"""
)
def routing_inputs(spark, sf_dir):
    from quirefold.operators import quality

    k = F.col("o_orderkey")
    issue = lambda c, code: F.when(c, F.struct(F.lit(code).alias("code"), F.lit("ERROR").alias("severity")))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.lit("REVIEW_REQUIRED").alias("quality_status"), F.lit(True).alias("review_required"), F.lit(0.8).alias("score"),
        F.array_compact(F.array(issue(F.col("o_orderstatus") == "F", "REQUIRED_FIELD_MISSING"), issue(k % 3 == 0, "FIELD_CONFLICT"))).alias("issues"), F.array(F.struct((k % 5 == 0).alias("sensitive"), F.lit("NEEDS_REVIEW").alias("status"))).alias("fields"),
    )
    return quality.route(extract.routing_inputs(rows)).select("k", "critical", "complete", "inconsistent", "sensitive", "action")


#: A submission of cases: its members and their kinds; `?` may be absent.
SUBMISSION = {
    "$": ("object",), "$.schemaVersion": ("string",), "$.manifest": ("object",), "$.manifest.id": ("number",), "$.manifest.note": ("string", "null", "?"),
    "$.cases": ("array",), "$.cases[*]": ("object",), "$.cases[*].key": ("string",), "$.cases[*].fields": ("object", "?"), "$.cases[*].fields.total": ("number", "null"), "$.cases[*].tags": ("array", "?"), "$.cases[*].tags[*]": ("string",),
}
DEEP = """CASE WHEN event_id % 13 = 0 THEN '{"schemaVersion": ' ELSE '{"schemaVersion": ' || CASE WHEN event_id % 7 = 0 THEN '1' ELSE '"1.0"' END || ', "manifest": {"id": ' || event_id || CASE WHEN event_id % 3 = 0 THEN ', "note": null' WHEN event_id % 3 = 1 THEN ', "Note": "x"' ELSE '' END || '}'
 || CASE WHEN event_id % 11 = 0 THEN '' ELSE ', "cases": [{"key": "' || event_type || '", "fields": {"total": ' || CASE WHEN event_id % 4 = 0 THEN 'null' WHEN event_id % 4 = 1 THEN '"2"' ELSE '2.5' END || CASE WHEN event_id % 5 = 0 THEN ', "Raw_Text": [{"draft": "{[\\"prediction\\": 1"}]' ELSE '' END || '}}, {' || CASE WHEN event_id % 2 = 0 THEN '"key": "b", ' ELSE '' END || '"tags": ["a", ' || CASE WHEN event_id % 6 = 0 THEN '1, {"predictions": []}' ELSE '"b"' END || ']}]' END || '}' END"""
_TREE = f"""d AS (SELECT event_id, {DEEP} AS j FROM events), ok AS (SELECT event_id, j FROM d WHERE json_valid(j)),
t AS (SELECT event_id, t.fullkey AS path, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS shape, t.key AS name, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM ok, json_tree(ok.j) t)"""
_RULES = ", ".join(f"('{s}', {[k for k in kinds if k != '?']}, {'?' not in kinds}, '{s.rpartition('.')[0]}')" for s, kinds in SUBMISSION.items())


def deep_documents(spark, sf_dir):
    """Events as JSON submissions, some broken, with members that are unknown, missing, of another kind or forbidden at several depths."""
    return wide(spark, sf_dir, "events").select("event_id", F.expr(DEEP.replace('\\"', '\\\\"')).alias("json"))


@query(
    f"""WITH {_TREE}, r(shape, kinds, needed, parent) AS (VALUES {_RULES}), k AS (SELECT t.*, r.kinds, r.shape AS known, regexp_replace(t.shape, '(\\.[^.\\[]*|\\[\\*\\])$', '') AS outer_shape FROM t LEFT JOIN r USING (shape))
SELECT event_id, path, CASE WHEN known IS NULL THEN 'UNKNOWN' ELSE 'KIND' END AS problem FROM k WHERE known IS NULL AND outer_shape IN (SELECT shape FROM r) OR known IS NOT NULL AND NOT list_contains(kinds, kind)
UNION ALL SELECT event_id, '$', 'BROKEN' FROM d WHERE NOT json_valid(j)
UNION ALL SELECT t.event_id, t.path || '.' || split_part(r.shape, '.', -1), 'MISSING' FROM t JOIN r ON t.shape = r.parent AND r.needed AND t.kind = 'object' WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.event_id = t.event_id AND c.path = t.path || '.' || split_part(r.shape, '.', -1))"""
)
def strict_json(spark, sf_dir):
    return jsontree.problems(deep_documents(spark, sf_dir), "event_id", "json", SUBMISSION)


@query(f"WITH {_TREE} SELECT event_id, path FROM t WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN {tuple(jsontree.UNSEEN)}")
def unseen_members(spark, sf_dir):
    return jsontree.forbidden(jsontree.nodes(deep_documents(spark, sf_dir), "event_id", "json"), "event_id", jsontree.UNSEEN)
