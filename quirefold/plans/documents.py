"""Queries over texts: observations, folds, classification, order-sensitive operators."""

from pyspark.sql import functions as F

from quirefold.functions import text as t
from quirefold.operators import classify, observe
from quirefold.plans.registry import query, table, wide

#: Markers of the test tables' languages: (language, marker, weight).
LANGUAGE_RULES = [
    ("en", "the", 1.0), ("en", "and", 1.0), ("en", "tion the", 0.5), ("en", "with", 0.5), ("en", "of", 0.5),
    ("fr", "des", 1.0), ("fr", "les", 1.0), ("fr", "dans", 1.0), ("fr", "eaux", 0.5), ("fr", "est", 0.5),
    ("de", "der", 1.0), ("de", "und", 1.0), ("de", "nicht", 1.5), ("de", "keit", 0.5), ("de", "die", 0.5),
    ("es", "los", 1.0), ("es", "cion", 1.0), ("es", "las", 1.0), ("es", "mente", 0.5), ("es", "el", 0.5),
]
RULES = LANGUAGE_RULES + classify.DOCUMENT_RULES
TEMPLATES = [("A", ["the", "nd", "tion"], 2), ("B", ["ion", "eau", "que"], 2), ("C", ["ich", "und", "sch"], 2), ("D", ["cion", "mente", "os"], 2)]

FOLD = "trim(regexp_replace(strip_accents(lower(replace(replace({0}, 'ß', 'ss'), 'ẞ', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"
LINES = "SELECT doc_id, lang, (i - 1)::INT AS seq, l[i] AS text FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"
_rows = lambda rules: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(float(x)) + "::DOUBLE" for x in r) + ")" for r in rules)
CLASSIFIED = f"""
r(type, marker, weight) AS (VALUES {_rows(RULES)}),
l AS (SELECT doc_id, {FOLD.format('text')} AS f FROM ({LINES})),
h AS (SELECT DISTINCT doc_id, type, marker, weight FROM l JOIN r ON CASE WHEN length(marker) <= 3 AND position(' ' IN marker) = 0 THEN position(' ' || marker || ' ' IN ' ' || f || ' ') > 0 ELSE position(marker IN f) > 0 END),
s AS (SELECT doc_id, type, sum(weight) AS score FROM h GROUP BY ALL),
c AS (SELECT *, least(0.99::DOUBLE, score / (score + 1.5::DOUBLE)) AS conf FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, type) AS rn FROM c),
p AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN type END) AS type, coalesce(max(CASE WHEN rn = 1 THEN conf END), 0) AS c1, coalesce(max(CASE WHEN rn = 2 THEN conf END), 0) AS c2 FROM n GROUP BY doc_id),
cls AS (SELECT d.doc_id, d.lang, CASE WHEN coalesce(c1, 0) >= 0.5 THEN type ELSE 'UNKNOWN' END AS document_type,
  CASE WHEN coalesce(c1, 0) >= 0.5 THEN c1 ELSE 1 - coalesce(c1, 0) END AS confidence, coalesce(c2 >= 0.5 AND c1 - c2 <= 0.08, false) AS ambiguous FROM documents d LEFT JOIN p USING (doc_id))"""


def classified(spark, sf_dir):
    return classify.classify(wide(spark, sf_dir, "documents"), RULES)


@query(LINES.replace("doc_id, lang, (i", "doc_id, (i"))
def observe_lines(spark, sf_dir):
    return observe.lines(wide(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS fold_md5, length({FOLD.format('text')})::INT AS fold_chars FROM documents")
def fold_accent(spark, sf_dir):
    fold = t.fold_key(F.col("text"))
    return wide(spark, sf_dir, "documents").select("doc_id", F.md5(fold).alias("fold_md5"), F.length(fold).alias("fold_chars"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain_md5, (length(text) - length(regexp_replace(text, '[À-ÖØ-öø-ɏḀ-ỿđĐ]', '', 'g')))::INT AS non_ascii_letters FROM documents")
def strip_marks(spark, sf_dir):
    c = F.col("text")
    letters = F.length(c) - F.length(F.regexp_replace(c, "[À-ÖØ-öø-ɏḀ-ỿđĐ]", ""))
    return wide(spark, sf_dir, "documents").select("doc_id", F.md5(t.without_marks(c)).alias("plain_md5"), letters.alias("non_ascii_letters"))


@query(f"WITH {CLASSIFIED} SELECT doc_id, document_type, round_even(confidence, 6) AS confidence, ambiguous FROM cls")
def marker_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "document_type", F.bround("confidence", 6).alias("confidence"), "ambiguous")


@query(
    f"""WITH l AS (SELECT doc_id, trim(regexp_replace(strip_accents(lower(replace(text, 'ß', 'ss'))), '\\s+', ' ', 'g')) AS f FROM documents),
r(id, anchor, n, least) AS (VALUES {', '.join(f"('{i}', '{a}', {len(xs)}, {k})" for i, xs, k in TEMPLATES for a in xs)}),
m AS (SELECT DISTINCT doc_id, id, anchor, n, least FROM l JOIN r ON position(anchor IN f) > 0 OR position(anchor IN replace(f, ' ', '')) > 0),
s AS (SELECT doc_id, id, count(*) AS k, round_even(count(*) / n::DOUBLE, 4) AS conf FROM m GROUP BY doc_id, id, n, least HAVING count(*) >= least),
w AS (SELECT *, row_number() OVER o AS rn, lead(conf) OVER o AS nxt FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY conf DESC, k DESC, id))
SELECT d.doc_id, CASE WHEN nxt IS DISTINCT FROM conf THEN id END AS template, CASE WHEN nxt IS DISTINCT FROM conf THEN k::INT END AS matched, CASE WHEN nxt IS DISTINCT FROM conf THEN conf END AS confidence
FROM documents d LEFT JOIN (SELECT * FROM w WHERE rn = 1) USING (doc_id)"""
)
def template_detect_tie(spark, sf_dir):
    return classify.detect_templates(wide(spark, sf_dir, "documents"), TEMPLATES).select("doc_id", "template", F.col("matched").cast("int").alias("matched"), "confidence")


_found = lambda p: f"list_transform(regexp_extract_all(text, '{p}'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
_kinds = {k: _found(t.IDENTIFIERS[k]) for k in ("email", "date", "employee_code")} | {"identity": "list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 12)"}


@query("SELECT doc_id, " + ", ".join(f"array_to_string(list_sort(list_distinct({x})), ',') AS {k}" for k, x in _kinds.items()) + " FROM documents")
def pii_candidates(spark, sf_dir):
    docs = wide(spark, sf_dir, "documents")
    return docs.select("doc_id", *(F.array_join(F.array_sort(t.identifiers(F.col("text"), k)), ",").alias(k) for k in _kinds))


@query(
    rf"""WITH l AS ({LINES}), b AS (SELECT *, length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, chr(9), '')) AS tabs FROM l),
c AS (SELECT doc_id, seq, list_filter(list_transform(string_split(text, CASE WHEN bars >= 2 THEN '|' ELSE chr(9) END), lambda x: trim(x)), lambda x: x <> '') AS cells FROM b WHERE bars >= 2 OR tabs >= 2),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, min(seq) OVER (PARTITION BY doc_id) AS least FROM c WHERE len(cells) >= 3)
SELECT doc_id, seq, len(cells)::INT AS n_cells, array_to_string(cells, '|') AS cells, seq = least AS is_header FROM k WHERE n >= 2"""
)
def delimited_tables(spark, sf_dir):
    rows = observe.delimited_rows(observe.lines(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "seq", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"), "is_header")


@query("SELECT conv_id, turn, lead(role) OVER w AS next_1, lead(role, 2) OVER w AS next_2, lead(role, 3) OVER w AS next_3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def next_line_value(spark, sf_dir):
    return observe.following(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 3).select("conv_id", "turn", "next_1", "next_2", "next_3")


@query("SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM conversations")
def section_slice(spark, sf_dir):
    return observe.sections(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


@query(
    """WITH f AS (SELECT user_id, event_id, (event_type = 'click' OR event_type = 'error')::INT AS f FROM events),
n AS (SELECT *, CASE WHEN f = 1 AND coalesce(lag(f) OVER w, 0) = 0 THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM n)
SELECT user_id, island, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM g WHERE f = 1 GROUP BY user_id, island"""
)
def gaps_islands(spark, sf_dir):
    return observe.islands(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type").isin("click", "error"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY seq)) AS text_md5 FROM l GROUP BY doc_id")
def document_text(spark, sf_dir):
    return observe.document_text(observe.lines(wide(spark, sf_dir, "documents"))).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer),
k AS (SELECT c_custkey, 0 AS seq, 'c_name: ' || coalesce(c_name, '') AS text FROM c UNION ALL SELECT c_custkey, 1, 'c_mktsegment: ' || coalesce(c_mktsegment, '') FROM c)
SELECT c_custkey, seq::INT AS seq, trim(split_part(text, ':', 1)) AS label, trim(substr(text, position(':' IN text) + 1)) AS value FROM k"""
)
def label_values(spark, sf_dir):
    rows = observe.key_values(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"])
    label, value = t.label_value(F.col("text"))
    return rows.select("c_custkey", "seq", label.alias("label"), value.alias("value"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5")
def ring_by_user(spark, sf_dir):
    return observe.last_rows(table(spark, sf_dir, "events"), "event_id", 5, "user_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def ring_buffer(spark, sf_dir):
    return observe.last_rows(table(spark, sf_dir, "events"), "event_id", 500).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, coalesce(nfc_normalize(text) <> text, false) AS violation FROM documents")
def nfc_violations(spark, sf_dir):
    c = F.coalesce(F.col("text"), F.lit(""))
    return wide(spark, sf_dir, "documents").select("doc_id", (t.nfc(c) != c).alias("violation"))
