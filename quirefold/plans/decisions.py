"""Queries over validation, scores and routing; their inputs are columns of orders and fixed functions of their keys."""

from pyspark.sql import functions as F

from quirefold.functions import dates, numbers
from quirefold.operators import classify, quality
from quirefold.plans.documents import CLASSIFIED, LINES, classified
from quirefold.plans.registry import query, table, wide

INPUTS = """SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS status, o_orderkey % 2 = 0 AS review, o_orderkey % 11 = 0 AS sensitive, o_orderkey % 13 = 0 AS critical,
 o_orderkey % 17 = 0 AS inconsistent, o_orderkey % 19 <> 0 AS complete, (o_orderkey % 101) / 100.0::DOUBLE AS confidence, o_orderkey % 3 = 0 AS auto FROM orders"""


def inputs(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(s == "F", "PASS").when(s == "O", "REVIEW_REQUIRED").otherwise("REJECTED").alias("status"), (k % 2 == 0).alias("review"), (k % 11 == 0).alias("sensitive"),
        (k % 13 == 0).alias("critical"), (k % 17 == 0).alias("inconsistent"), (k % 19 != 0).alias("complete"), ((k % 101) / F.lit(100.0)).alias("confidence"), (k % 3 == 0).alias("auto"),
    )


@query(
    f"""SELECT k, CASE WHEN status = 'REJECTED' OR critical THEN 'REQUEST_REUPLOAD' WHEN sensitive OR inconsistent OR NOT complete THEN 'HR_REVIEW' WHEN confidence < 0.6 THEN 'REQUEST_REUPLOAD'
 WHEN status = 'PASS' AND NOT review AND confidence >= 0.9 AND auto THEN 'AUTO_CONTINUE' ELSE 'USER_REVIEW' END AS action FROM ({INPUTS})"""
)
def route_code(spark, sf_dir):
    return quality.route(inputs(spark, sf_dir)).select("k", "action")


@query(
    f"""WITH i AS ({INPUTS}), r(rule, s, rv, se, cr, ic, co, lo, hi, au, action) AS (VALUES {', '.join('(' + ', '.join([str(n)] + [('NULL' if x is None else f"'{x}'" if isinstance(x, str) else str(x)) for x in d]) + ')' for n, d in enumerate(quality.DECISIONS, 1))}),
h AS (SELECT k, rule, action FROM i JOIN r ON (s IS NULL OR s = status) AND (rv IS NULL OR rv = review) AND (se IS NULL OR se = sensitive) AND (cr IS NULL OR cr = critical) AND (ic IS NULL OR ic = inconsistent) AND (co IS NULL OR co = complete)
 AND (lo IS NULL OR confidence >= lo::DOUBLE) AND (hi IS NULL OR confidence < hi::DOUBLE OR (hi = 1 AND confidence <= 1)) AND (au IS NULL OR au = auto))
SELECT i.k, min(rule)::INT AS rule, arg_min(action, rule) AS action FROM i LEFT JOIN h USING (k) GROUP BY i.k"""
)
def route_dmn(spark, sf_dir):
    return quality.decide(inputs(spark, sf_dir)).select("k", "rule", "action")


GATE_REQUIRED = {"en": ["value"], "fr": ["value", "start_date"], "de": ["end_date", "owner"]}
_req = ", ".join(f"('{k}', '{n}')" for k, ns in GATE_REQUIRED.items() for n in ns)


@query(
    f"""WITH {CLASSIFIED},
g AS (SELECT doc_id, document_type, confidence, ambiguous, CASE WHEN n_chars < 300 THEN 'PARTIAL' WHEN n_chars > 20000 THEN 'FAILED' ELSE 'PARSED' END AS parse_status, document_type IN ('en', 'fr') AS ext, CASE WHEN doc_id % 8 = 0 THEN ['EMPTY_PAGE', 'FONT'] ELSE [] END AS warnings FROM cls JOIN documents USING (doc_id)),
f AS (SELECT doc_id, unnest(list_filter([{{'pos': 0, 'name': CASE WHEN doc_id % 5 <> 0 THEN 'value' END, 'value': 'v' || doc_id % 3, 'conf': (doc_id % 10) / 10.0::DOUBLE, 'sens': doc_id % 4 = 0}}, {{'pos': 1, 'name': CASE WHEN doc_id % 7 = 0 THEN 'value' END, 'value': 'v0', 'conf': 0.9::DOUBLE, 'sens': false}},
  {{'pos': 2, 'name': CASE WHEN doc_id % 11 <> 0 THEN 'start_date' END, 'value': CASE WHEN doc_id % 6 = 0 THEN 'soon' ELSE '2024-03-1' || doc_id % 9 END, 'conf': 0.96::DOUBLE, 'sens': false}}, {{'pos': 3, 'name': CASE WHEN doc_id % 2 = 0 THEN 'end_date' END, 'value': '2024-03-14', 'conf': 0.96::DOUBLE, 'sens': false}}], lambda x: x.name IS NOT NULL), recursive := true) FROM g),
q(kind, name) AS (VALUES {_req}),
d AS (SELECT doc_id, max(CASE WHEN name = 'start_date' THEN try_strptime(value, '%Y-%m-%d') END) AS s, max(CASE WHEN name = 'end_date' THEN try_strptime(value, '%Y-%m-%d') END) AS e, coalesce(bool_or(name = 'start_date' AND try_strptime(value, '%Y-%m-%d') IS NULL), false) AS bad FROM f GROUP BY doc_id),
cf AS (SELECT doc_id, name, min(pos) AS pos FROM f GROUP BY doc_id, name HAVING count(DISTINCT value) > 1),
i AS (
  SELECT doc_id, 0 AS a, 0 AS b, CASE parse_status WHEN 'FAILED' THEN 'PARSE_NOT_USABLE' ELSE 'PARTIAL_PARSE' END AS code, CASE parse_status WHEN 'FAILED' THEN 'ERROR' ELSE 'WARNING' END AS sev, NULL AS name FROM g WHERE parse_status <> 'PARSED'
  UNION ALL SELECT doc_id, 1, generate_subscripts(warnings, 1), 'PARSER_' || unnest(warnings), 'WARNING', NULL FROM g
  UNION ALL SELECT doc_id, 2, 0, CASE WHEN document_type = 'UNKNOWN' THEN 'UNKNOWN_DOCUMENT_TYPE' ELSE 'LOW_CLASSIFICATION_CONFIDENCE' END, 'WARNING', NULL FROM g WHERE document_type = 'UNKNOWN' OR confidence < 0.65
  UNION ALL SELECT doc_id, 3, 0, 'AMBIGUOUS_DOCUMENT_TYPE', 'WARNING', NULL FROM g WHERE ambiguous
  UNION ALL SELECT doc_id, 4, 0, 'NO_FIELD_EXTRACTOR', 'WARNING', NULL FROM g WHERE NOT ext
  UNION ALL SELECT doc_id, 5, row_number() OVER (PARTITION BY doc_id ORDER BY q.name), 'REQUIRED_FIELD_MISSING', 'ERROR', q.name FROM g JOIN q ON kind = document_type WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.name = q.name)
  UNION ALL SELECT doc_id, 6, pos, 'FIELD_CONFLICT', 'ERROR', name FROM cf
  UNION ALL SELECT doc_id, 7, 0, 'INVALID_DATE', 'ERROR', 'start_date' FROM d WHERE bad
  UNION ALL SELECT doc_id, 8, 0, 'DATE_RANGE_CONFLICT', 'ERROR', NULL FROM d WHERE e < s
  UNION ALL SELECT doc_id, 9, pos, 'LOW_FIELD_CONFIDENCE', 'WARNING', name FROM f WHERE conf < 0.85),
nx AS (SELECT doc_id, string_agg(code || coalesce(':' || name, ''), ',' ORDER BY a, b) AS codes, count(*) FILTER (sev = 'ERROR') AS errors, count(*) FILTER (sev = 'WARNING') AS warns FROM i GROUP BY doc_id),
st AS (SELECT f.doc_id, string_agg(f.name || '=' || CASE WHEN cf.name IS NOT NULL OR (f.name = 'start_date' AND bad) OR (f.name IN ('start_date', 'end_date') AND coalesce(e < s, false)) THEN 'INVALID' WHEN sens OR conf < 0.85 THEN 'NEEDS_REVIEW' ELSE 'ACCEPTED' END, ',' ORDER BY f.pos) AS statuses, bool_or(sens) AS sensitive FROM f LEFT JOIN cf USING (doc_id, name) JOIN d USING (doc_id) GROUP BY f.doc_id),
ss AS (SELECT g.doc_id, coalesce(codes, '') AS issues, coalesce(statuses, '') AS statuses, coalesce(errors, 0) AS errors, parse_status, (codes IS NOT NULL OR coalesce(sensitive, false)) AS review, round_even(greatest(0, least(1, 0.4 + 0.6 * confidence - (0.06::DOUBLE * coalesce(warns, 0) + 0.16::DOUBLE * coalesce(errors, 0)))), 4) AS score FROM g LEFT JOIN nx USING (doc_id) LEFT JOIN st USING (doc_id))
SELECT doc_id, issues, statuses, score, CASE WHEN parse_status = 'FAILED' OR (score < 0.25 AND errors > 0) THEN 'REJECTED' WHEN review THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS quality_status FROM ss"""
)
def quality_gate(spark, sf_dir):
    k = F.col("doc_id")
    field = lambda c, name, value, conf, sens: F.when(c, F.struct(F.lit(name).alias("name"), value.alias("value"), conf.cast("double").alias("confidence"), sens.alias("sensitive")))
    fields = F.array_compact(F.array(
        field(k % 5 != 0, "value", F.concat(F.lit("v"), (k % 3).cast("string")), (k % 10) / F.lit(10.0), k % 4 == 0),
        field(k % 7 == 0, "value", F.lit("v0"), F.lit(0.9), F.lit(False)),
        field(k % 11 != 0, "start_date", F.when(k % 6 == 0, "soon").otherwise(F.concat(F.lit("2024-03-1"), (k % 9).cast("string"))), F.lit(0.96), F.lit(False)),
        field(k % 2 == 0, "end_date", F.lit("2024-03-14"), F.lit(0.96), F.lit(False)),
    ))
    rows = classified(spark, sf_dir).withColumns(
        {
            "parse_status": F.when(F.col("n_chars") < 300, "PARTIAL").when(F.col("n_chars") > 20000, "FAILED").otherwise("PARSED"),
            "has_extractor": F.col("document_type").isin("en", "fr"),
            "warnings": F.when(k % 8 == 0, F.array(F.lit("EMPTY_PAGE"), F.lit("FONT"))),
            "fields": fields,
        }
    )
    out = quality.gate(rows, GATE_REQUIRED)
    codes = F.transform("issues", lambda x: F.concat(x["code"], F.coalesce(F.concat(F.lit(":"), x["field"]), F.lit(""))))
    statuses = F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["status"]))
    return out.select("doc_id", F.array_join(codes, ",").alias("issues"), F.array_join(statuses, ",").alias("statuses"), "score", "quality_status")


ACCEPTED = ["CV", "CERTIFICATE", "EMPLOYMENT_CONTRACT"]


@query("SELECT o_orderkey AS k, CASE WHEN d NOT IN ('CV', 'CERTIFICATE', 'EMPLOYMENT_CONTRACT') THEN 'INVALID' WHEN t = 'UNKNOWN' THEN 'UNKNOWN' WHEN d = CASE t WHEN 'CONTRACT_APPENDIX' THEN 'EMPLOYMENT_CONTRACT' WHEN 'CV' THEN 'CV' ELSE 'OTHER_HR_DOCUMENT' END THEN 'CONFIRMED' ELSE 'MISMATCH' END AS status FROM (SELECT o_orderkey, ['CV', 'CERTIFICATE', 'EMPLOYMENT_CONTRACT', 'MEMO'][(o_orderkey % 4)::INT + 1] AS d, ['CV', 'UNKNOWN', 'CONTRACT_APPENDIX'][(o_custkey % 3)::INT + 1] AS t FROM orders)")
def declared_status(spark, sf_dir):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col(k) % len(xs)).cast("int") + 1)
    declared, detected = pick([*ACCEPTED, "MEMO"], "o_orderkey"), pick(["CV", "UNKNOWN", "CONTRACT_APPENDIX"], "o_custkey")
    mapping = {"CV": "CV", "CONTRACT_APPENDIX": "EMPLOYMENT_CONTRACT"}
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), classify.declared_status(declared, detected, mapping, "OTHER_HR_DOCUMENT", ACCEPTED).alias("status"))


DATE_TEXT = "(o_orderkey % 31 + 1) || '/' || (o_custkey % 13 + 1) || '/' || year(o_orderdate)"


@query(f"SELECT o_orderkey AS k, try_strptime(t, '%d/%m/%Y')::DATE AS parsed, try_strptime(t, '%d/%m/%Y') IS NULL AS invalid FROM (SELECT o_orderkey, {DATE_TEXT} AS t FROM orders)")
def date_validate(spark, sf_dir):
    text = F.concat_ws("/", (F.col("o_orderkey") % 31 + 1).cast("string"), (F.col("o_custkey") % 13 + 1).cast("string"), F.year("o_orderdate").cast("string"))
    parsed = dates.first_date(F.concat(F.lit("on "), text, F.lit(".")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), parsed.alias("parsed"), parsed.isNull().alias("invalid"))


LEAVE = "SELECT o_orderkey AS k, o_orderdate::DATE AS s, (o_orderdate::DATE + ((o_orderkey % 9) - 2)::INT) AS e, (o_orderdate::DATE + ((o_custkey % 10) - 1)::INT) AS r, (o_orderkey % 7 - 1)::DOUBLE AS d FROM orders"


@query(
    f"""SELECT k, array_to_string(list_filter([CASE WHEN s > e THEN 'DATE_RANGE_CONFLICT:startDate,endDate' END, CASE WHEN d > (e - s) + 1 THEN 'LEAVE_DAYS_EXCEED_DATE_RANGE' END, CASE WHEN r <= e THEN 'EXPECTED_RETURN_NOT_AFTER_END' END, CASE WHEN d <= 0 THEN 'LEAVE_DAYS_NOT_POSITIVE' END], lambda x: x IS NOT NULL), ';') AS errors FROM ({LEAVE})"""
)
def leave_rules(spark, sf_dir):
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), day.alias("start_date"), F.date_add(day, (F.col("o_orderkey") % 9 - 2).cast("int")).alias("end_date"),
        F.date_add(day, (F.col("o_custkey") % 10 - 1).cast("int")).alias("return_date"), (F.col("o_orderkey") % 7 - 1).cast("double").alias("leave_days"),
    )
    return quality.leave_errors(rows).select("k", F.array_join("errors", ";").alias("errors"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS s, (o_orderdate::DATE + ((o_orderkey % 5) - 1)::INT) AS e, 18 * 60 + o_custkey % 60 AS a, 18 * 60 + (o_orderkey % 5) * 60 + o_custkey % 60 AS b, (o_orderkey % 4)::DOUBLE AS p, ((o_orderkey % 4) * (o_orderkey % 5))::DOUBLE AS t FROM orders), x AS (SELECT *, (b - a) / 60.0::DOUBLE AS span FROM o)
SELECT k, array_to_string(list_filter([CASE WHEN s > e THEN 'DATE_RANGE_CONFLICT:startDate,endDate' END, CASE WHEN p <= 0 THEN 'OVERTIME_HOURS_PER_DAY_NOT_POSITIVE' END, CASE WHEN t <= 0 THEN 'TOTAL_OVERTIME_HOURS_NOT_POSITIVE' END, CASE WHEN span <= 0 THEN 'OVERTIME_TIME_RANGE_CONFLICT' END, CASE WHEN span > 0 AND abs(span - p) > 0.01 THEN 'OVERTIME_HOURS_PER_DAY_CONFLICT' END, CASE WHEN s <= e AND abs(((e - s) + 1) * p - t) > 0.01 THEN 'TOTAL_OVERTIME_HOURS_CONFLICT' END], lambda x: x IS NOT NULL), ';') AS errors FROM x"""
)
def overtime_rules(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    clock = lambda h: F.concat_ws(":", h.cast("string"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), day.alias("start_date"), F.date_add(day, (k % 5 - 1).cast("int")).alias("end_date"), clock(F.lit(18)).alias("start_time"), clock(F.lit(18) + k % 5).alias("end_time"),
        (k % 4).cast("double").alias("hours_per_day"), ((k % 4) * (k % 5)).cast("double").alias("total_hours"),
    )
    return quality.overtime_errors(rows).select("k", F.array_join("errors", ";").alias("errors"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2) AS v FROM orders), f AS (SELECT k, v, replace(v::VARCHAR, '.', ',') AS comma, regexp_replace(floor(v)::BIGINT::VARCHAR, '([0-9])([0-9]{3})$', '\\1.\\2') AS thousands FROM p)
SELECT k, v::DOUBLE AS from_comma, floor(v)::DOUBLE AS from_thousands FROM f""".replace("\\\\", "\\")
)
def decimal_token(spark, sf_dir):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    comma = F.replace(v.cast("string"), F.lit("."), F.lit(","))
    thousands = F.regexp_replace(F.floor(v).cast("string"), "([0-9])([0-9]{3})$", "$1.$2")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), numbers.decimal_token(comma).cast("double").alias("from_comma"), numbers.decimal_token(thousands).cast("double").alias("from_thousands"))


TITLES = [("ARTICLE", "the", 6.0), ("ARTICLE", "tion", 1.5), ("NOTE", "is", 6.0), ("NOTE", "and", 1.0), ("BRIEF", "des", 6.0), ("BRIEF", "que", 2.0), *classify.TITLE_RULES]
FAMILY_TITLES = [("NOTE", "is", 7.0), ("NOTE", "and", 1.0), ("BRIEF", "des", 7.0), ("BRIEF", "que", 2.0), *classify.FAMILY_RULES]
KEYED = f"trim(regexp_replace(replace(strip_accents(lower(replace(text, 'ß', 'ss'))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_values = lambda rules: ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {i})" for i, (a, b, c) in enumerate(rules))


def titled_sql(name: str, rules: list, blocks: int, bonus: float, order: str, evidence: int, untitled: str) -> str:
    """CTEs that end in {name}(doc_id, type, b, c, terms): the best type, its score, the second's and the terms found."""
    return f"""{name}_m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM keyed WHERE f <> ''),
{name}_x AS (SELECT doc_id, string_agg(f, ' ' ORDER BY seq) AS flat, chr(10) || coalesce(string_agg(f, chr(10) ORDER BY seq) FILTER (n <= {blocks}), '') || chr(10) AS head FROM {name}_m GROUP BY doc_id),
{name}_r(type, term, weight, place) AS (VALUES {_values(rules)}),
{name}_h AS (SELECT doc_id, type, term, weight, place, position(chr(10) || term || ' ' IN head) > 0 OR position(chr(10) || term || chr(10) IN head) > 0 AS heads, head FROM {name}_x JOIN {name}_r ON position(term IN flat) > 0),
{name}_s AS (SELECT doc_id, type, min(place) AS place, sum(CASE WHEN weight < 5 OR heads THEN weight ELSE weight * 0.2::DOUBLE END + CASE WHEN heads THEN {bonus}::DOUBLE ELSE 0 END) AS raw, list(term ORDER BY place)[1:{evidence}] AS terms, any_value(head) AS head FROM {name}_h GROUP BY doc_id, type),
{name}_t AS (SELECT *, {untitled} AS score FROM {name}_s),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {order}) AS rn FROM {name}_t),
{name} AS (SELECT d.doc_id, max(CASE WHEN rn = 1 THEN type END) AS type, coalesce(max(CASE WHEN rn = 1 THEN score END), 0) AS b, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS c, any_value(CASE WHEN rn = 1 THEN terms END) AS terms FROM documents d LEFT JOIN {name}_k USING (doc_id) GROUP BY d.doc_id)"""


TITLED = f"""keyed AS (SELECT doc_id, seq, {KEYED} AS f FROM ({LINES})),
{titled_sql('p', TITLES, 6, 0.0, 'place', 6, "CASE WHEN type = 'EMPLOYEE_INFORMATION_FORM' AND position(chr(10) || 'phieu thong tin nhan vien' IN head) = 0 THEN least(raw, 2.4) ELSE raw END")},
titled AS (SELECT doc_id, CASE WHEN b >= 2.5 THEN type ELSE 'GENERIC_DOCUMENT' END AS document_type, CASE WHEN b >= 2.5 THEN least(0.99::DOUBLE, 0.6 + b * 0.035 + (b - c) * 0.025) ELSE 0.55 END AS confidence, CASE WHEN b >= 2.5 THEN terms ELSE [] END AS terms FROM p)"""


@query(f"WITH {TITLED} SELECT doc_id, document_type, round_even(confidence, 4) AS confidence, array_to_string(terms, ';') AS evidence, confidence >= 0.8 AS accepted FROM titled")
def titled_classify(spark, sf_dir):
    found = classify.classify_titled(wide(spark, sf_dir, "documents"), TITLES)
    return found.select("doc_id", "document_type", F.bround("confidence", 4).alias("confidence"), F.array_join("evidence", ";").alias("evidence"), "accepted")


_case = lambda t, other: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE '{other}' END"


@query(
    f"""WITH {TITLED}, {titled_sql('g', FAMILY_TITLES, 8, 1.0, 'type', 8, 'raw')},
k AS (SELECT g.doc_id, CASE WHEN g.b >= 2.5 THEN g.type ELSE t.document_type END AS document_type, CASE WHEN g.b >= 2.5 THEN least(0.99::DOUBLE, 0.6 + g.b * 0.035 + (g.b - g.c) * 0.025) ELSE t.confidence END AS confidence, CASE WHEN g.b >= 2.5 THEN g.terms ELSE t.terms END AS terms FROM g JOIN titled t USING (doc_id))
SELECT doc_id, document_type, round_even(confidence, 4) AS confidence, array_to_string(terms, ';') AS evidence, CASE document_type {_case(classify.FAMILIES, 'OTHER_HR_DOCUMENT')} AS family, CASE document_type {_case(classify.WORKFLOWS, 'OTHER_HR_DOCUMENT')} AS workflow_type FROM k"""
)
def family_classify(spark, sf_dir):
    found = classify.classify_family(wide(spark, sf_dir, "documents"), FAMILY_TITLES, fallback=TITLES)
    return found.select("doc_id", "document_type", F.bround("confidence", 4).alias("confidence"), F.array_join("evidence", ";").alias("evidence"), "family", "workflow_type")


HR_TEXT = """SELECT o_orderkey AS doc_id, concat_ws(chr(10), ['CURRICULUM VITAE', 'CĂN CƯỚC CÔNG DÂN', 'Hợp đồng', 'Đơn xin nghỉ phép'][(o_orderkey % 4)::INT + 1], CASE WHEN o_orderkey % 3 = 0 THEN 'Kỹ năng: SQL' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Học vấn' END, CASE WHEN o_orderkey % 7 = 0 THEN 'email: a@b.vn' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Nationality: VN' END) AS text FROM orders"""


def hr_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.element_at(F.array(*map(F.lit, ["CURRICULUM VITAE", "CĂN CƯỚC CÔNG DÂN", "Hợp đồng", "Đơn xin nghỉ phép"])), (k % 4).cast("int") + 1)
    text = F.concat_ws("\n", title, F.when(k % 3 == 0, "Kỹ năng: SQL"), F.when(k % 5 == 0, "Học vấn"), F.when(k % 7 == 0, "email: a@b.vn"), F.when(k % 2 == 0, "Nationality: VN"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))


@query(
    f"""WITH k AS (SELECT doc_id, {KEYED} AS key FROM ({HR_TEXT})), n AS (SELECT doc_id, key, list_filter({classify.ROUTE_IDENTITY}, lambda m: position(m IN key) > 0) AS i, list_filter({classify.ROUTE_CV}, lambda m: position(m IN key) > 0) AS c, len(list_filter({classify.CV_SECTIONS}, lambda m: position(m IN key) > 0)) AS s FROM k)
SELECT doc_id, CASE WHEN len(i) > 0 THEN 'IDENTITY_DOCUMENT' WHEN len(c) >= 2 THEN 'CV' ELSE 'GENERIC_DOCUMENT' END AS route, round_even(CASE WHEN len(i) > 0 THEN least(0.98::DOUBLE, 0.72 + 0.08::DOUBLE * len(i)) WHEN len(c) >= 2 THEN least(0.96::DOUBLE, 0.68 + 0.07::DOUBLE * len(c)) ELSE 0.55 END, 4) AS confidence,
 array_to_string(CASE WHEN len(i) > 0 THEN i[1:3] WHEN len(c) >= 2 THEN c[1:3] ELSE [] END, ';') AS evidence, CASE WHEN len(i) > 0 AND s >= 2 THEN NULL WHEN len(i) > 0 THEN 'IDENTITY_DOCUMENT' WHEN len(c) >= 2 THEN 'CV' ELSE 'GENERIC_DOCUMENT' END AS safe_route FROM n"""
)
def early_route(spark, sf_dir):
    rows = hr_texts(spark, sf_dir).withColumn("r", classify.early_route(F.col("text")))
    return rows.select("doc_id", "r.route", F.bround("r.confidence", 4).alias("confidence"), F.array_join("r.evidence", ";").alias("evidence"), classify.safe_route(F.col("r.route"), F.col("text")).alias("safe_route"))


@query(
    """WITH p AS (SELECT l_orderkey AS doc, CASE WHEN l_quantity < 20 THEN CASE WHEN l_linenumber % 3 > 0 THEN 'scan' ELSE 'empty' END WHEN l_linenumber * 7 < 20 OR l_discount * 10 >= 0.72 THEN 'native' ELSE 'hybrid' END AS mode FROM lineitem)
SELECT doc, CASE WHEN count(*) FILTER (mode <> 'empty') = 0 THEN 'EMPTY' WHEN count(DISTINCT mode) FILTER (mode <> 'empty') = 1 AND max(mode) FILTER (mode <> 'empty') <> 'hybrid' THEN upper(max(mode) FILTER (mode <> 'empty')) ELSE 'HYBRID' END AS document_mode FROM p GROUP BY doc"""
)
def ingestion_modes(spark, sf_dir):
    scan = F.when(F.col("l_quantity") < 20, F.col("l_linenumber") % 3).otherwise(F.col("l_linenumber") * 7)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), classify.page_mode(F.col("l_quantity"), scan, F.col("l_discount") * 10).alias("mode"))
    return classify.document_modes(rows, "doc")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'NATIVE_ONLY' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'OCR_ALLOWED' ELSE 'UNSUPPORTED_NO_OCR' END AS scope FROM orders")
def reading_scope(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "DOCX").when(F.col("o_orderstatus") == "O", "IMAGE").otherwise("PDF_SCAN")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), classify.reading_scope(kind, F.lower("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("scope"))


@query(
    """WITH l AS (SELECT l_orderkey AS doc, 1 - l_discount * 6 AS confidence, l_tax > 0.06 AS corrected, l_orderkey % 3 = 0 AS identity FROM lineitem), s AS (SELECT doc, count(*) AS lines, count(*) FILTER (confidence < 0.8) / count(*)::DOUBLE AS r, count(*) FILTER (confidence < 0.5) AS critical, count(*) FILTER (corrected) AS corrections, bool_or(identity) AS i FROM l GROUP BY doc)
SELECT doc, lines, round_even(r, 6) AS low_ratio, critical, corrections, CASE WHEN i AND r > 0.1 THEN 'FAIL' WHEN r > 0.2 OR critical > 0 OR corrections >= 3 THEN 'REVIEW' ELSE 'PASS' END AS status FROM s"""
)
def reading_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (1 - F.col("l_discount") * 6).alias("confidence"), (F.col("l_tax") > 0.06).alias("corrected"))
    return quality.reading_quality(rows, ["doc"], F.col("doc") % 3 == 0)


@query("SELECT p_partkey, p_size * 1500000 AS from_millions, p_size * 1000 AS from_thousands, p_size * 1000 + 500 AS from_digits, round_even(p_size + (p_partkey % 12) / 12.0::DOUBLE, 6) AS years FROM (SELECT p_partkey, p_size::BIGINT AS p_size FROM part)")
def salaries(spark, sf_dir):
    s = F.col("p_size").cast("long")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        numbers.salary(F.concat(F.replace(text((s * F.lit(1.5)).cast("decimal(10,1)")), F.lit("."), F.lit(",")), F.lit(" triệu"))).alias("from_millions"),
        numbers.salary(F.concat(text(s), F.lit(" nghìn"))).alias("from_thousands"),
        numbers.salary(F.concat(text(s), F.lit(".500 VND"))).alias("from_digits"),
        numbers.years(F.concat(text(s), F.lit(" năm "), text(F.col("p_partkey") % 12), F.lit(" tháng"))).alias("years"),
    )
