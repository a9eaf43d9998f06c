"""Field extraction from observations, and what is done to the fields: overlays, renames, summaries, key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import fold_strict, label_value, once

CONFIDENCE = 0.96

#: Labelled fields by document type (fixed values): (type, field, sensitive, aliases).
FIELDS = [
    ("CV", "full_name", True, ["họ tên", "ho ten", "full name"]),
    ("CV", "skills", False, ["kỹ năng", "ky nang", "skills"]),
    ("CV", "education", False, ["học vấn", "hoc van", "education"]),
    ("EMPLOYMENT_CONTRACT", "contract_number", False, ["số hợp đồng", "so hop dong", "contract number"]),
    ("EMPLOYMENT_CONTRACT", "employee_name", True, ["họ tên", "ho ten", "employee name", "người lao động"]),
    ("EMPLOYMENT_CONTRACT", "start_date", False, ["ngày bắt đầu", "ngay bat dau", "start date"]),
    ("EMPLOYMENT_CONTRACT", "end_date", False, ["ngày kết thúc", "ngay ket thuc", "end date"]),
    ("EMPLOYMENT_CONTRACT", "salary", True, ["lương", "luong", "salary"]),
    ("CERTIFICATE", "recipient_name", True, ["candidate name", "candidate", "họ tên", "ho ten"]),
    ("CERTIFICATE", "credential_id", False, ["candidate number", "certificate number", "certificate no"]),
    ("CERTIFICATE", "credential_type", False, ["test type", "certificate type", "loại chứng chỉ", "loai chung chi"]),
    ("CERTIFICATE", "overall_score", False, ["overall band score", "overall score", "điểm tổng", "diem tong"]),
    ("CERTIFICATE", "issue_date", False, ["test date", "issue date", "ngày thi", "ngay thi"]),
    ("LEAVE_REQUEST", "employee_name", True, ["họ tên", "ho ten", "employee name"]),
    ("LEAVE_REQUEST", "start_date", False, ["từ ngày", "tu ngay", "start date"]),
    ("LEAVE_REQUEST", "end_date", False, ["đến ngày", "den ngay", "end date"]),
    ("LEAVE_REQUEST", "reason", False, ["lý do", "ly do", "reason"]),
]
REQUIRED = {"CV": ["full_name", "skills"], "EMPLOYMENT_CONTRACT": ["contract_number", "employee_name", "start_date"], "LEAVE_REQUEST": ["employee_name", "start_date", "end_date", "reason"]}


def folded_alias(alias: str) -> str:
    """The strict fold of an alias, done once when the plan is made."""
    import re
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFD", alias.casefold()) if unicodedata.category(c) != "Mn")
    return " ".join(re.sub("[^a-z0-9]+", " ", t).split())


def labelled(observations: DataFrame, key: str = "doc_id", fields: list[tuple] = FIELDS) -> DataFrame:
    """(key, seq, name, value, confidence, sensitive) of observations (key, seq, text, document_type).

    A line gives a field of its document's type if its label is an alias or ends with one as a word; a label may give several
    fields. The rules are expressions, so nothing is joined or shuffled.
    """
    label, value = label_value(F.col("text"))
    rows = observations.withColumns({"_label": fold_strict(label), "_value": value}).where("_value IS NOT NULL")
    hits = []
    for kind, name, sensitive, aliases in fields:
        known = list(dict.fromkeys(map(folded_alias, aliases)))
        fits = reduce(lambda a, x: a | (F.col("_label") == x) | F.col("_label").endswith(f" {x}"), known, F.lit(False))
        hits.append(F.when((F.col("document_type") == kind) & fits, F.struct(F.lit(name).alias("name"), F.lit(sensitive).alias("sensitive"))))
    rows = rows.select(key, "seq", F.col("_value").alias("value"), F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return rows.select(key, "seq", "f.name", "value", F.lit(CONFIDENCE).alias("confidence"), "f.sensitive")


def missing_fields(fields: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, missing): required fields of the document's type that were not extracted, by name."""
    names = fields.groupBy(key).agg(F.collect_set("name").alias("_names"))
    required = F.element_at(F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("document_type"))
    empty = F.array().cast("array<string>")
    return docs.join(names, key, "left").select(key, F.array_sort(F.array_except(F.coalesce(required, empty), F.coalesce("_names", empty))).alias("missing"))


def party(rows: DataFrame, key: str, order: str, start: Column, end: Column) -> DataFrame:
    """Rows from a start marker up to the first end marker after it; the whole document where no start is."""
    page = Window.partitionBy(key)
    rows = rows.withColumn("_from", F.min(F.when(start, F.col(order))).over(page))
    rows = rows.withColumn("_to", F.min(F.when(end & (F.col(order) > F.col("_from")), F.col(order))).over(page))
    return rows.where("_from IS NULL OR (" + f"{order} >= _from AND (_to IS NULL OR {order} < _to))").drop("_from", "_to")


def narrative(rows: DataFrame, key: str, order: str, text: str, most: int = 320) -> DataFrame:
    """(key, narrative): the rows of a key joined in order until one ends with a full stop, starts a numbered clause, or `most` characters are reached."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
    none = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        clause = x.rlike(r"^\s*[0-9]+[.)]") & (acc["out"] != "")
        joined = F.when(acc["out"] == "", F.trim(x)).otherwise(F.concat(acc["out"], F.lit(" "), F.trim(x)))
        stop = clause | acc["done"]
        out = F.when(stop, acc["out"]).otherwise(joined)
        return F.struct(out.alias("out"), (stop | out.endswith(".") | (F.length(out) >= most)).alias("done"))

    return rows.groupBy(key).agg(F.aggregate(xs, none, step)["out"].alias("narrative"))


def first_acceptable(rows: DataFrame, key: str, order: str, text: str, marker: Column, accept, k: int = 3) -> DataFrame:
    """(key, order, value): for each marker row the first of the k rows after it whose text is acceptable."""
    by = Window.partitionBy(key).orderBy(order)
    nexts = [F.lead(text, i).over(by) for i in range(1, k + 1)]
    rows = rows.withColumns({f"_n{i}": x for i, x in enumerate(nexts)}).where(marker)
    value = F.coalesce(*(F.when(accept(F.col(f"_n{i}")), F.col(f"_n{i}")) for i in range(k)))
    return rows.select(key, order, value.alias("value"))


def overlay(data: Column, corrections: Column, derived: list[str]) -> Column:
    """A map without its derived keys, with the corrections laid over it."""
    keep = F.map_filter(data, lambda k, _: ~k.isin(*derived) & ~F.map_contains_key(F.coalesce(corrections, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(keep, F.coalesce(corrections, F.create_map().cast("map<string,string>")))


def renamed(data: Column, aliases: dict[str, str]) -> Column:
    """A map with old field names replaced; names without an alias stay."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.transform_keys(data, lambda k, _: F.coalesce(F.element_at(table, k), k))


def renamed_errors(errors: Column, aliases: dict[str, str]) -> Column:
    """Error codes `CODE:field` with old field names replaced; codes without a field, and names without an alias, stay."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    name = lambda e: F.substring_index(e, ":", -1)
    return F.transform(errors, lambda e: F.when(e.contains(":"), F.concat(F.substring_index(e, ":", 1), F.lit(":"), F.coalesce(F.element_at(table, name(e)), name(e)))).otherwise(e))


#: What several candidates of one field are called, and what an absent one (fixed values).
SEVERAL, ABSENT = "MULTIPLE_CANDIDATES", "REQUIRED_FIELD_MISSING"


def revalidated(data: Column, corrections: Column, errors: Column, required: list[str], derived: list[str], checks: dict[str, str]) -> Column:
    """struct<data, missing, errors, action>: a map with corrections laid over it, checked again.

    Derived keys go. Of the stored errors only conflicts of fields that were not corrected stay; required fields without a value are missing, and filled
    fields that break their pattern are INVALID_FORMAT. With any of these the action is MANUAL_REVIEW, else AUTO_CONTINUE.
    """
    fixed = F.coalesce(corrections, F.create_map().cast("map<string,string>"))

    def of(d: Column) -> Column:
        value = lambda n: F.coalesce(F.trim(F.element_at(d, n)), F.lit(""))
        missing = F.array_compact(F.array(*(F.when(value(n) == "", n) for n in required)))
        conflicts = F.filter(errors, lambda e: e.startswith(f"{SEVERAL}:") & ~F.map_contains_key(fixed, F.substring_index(e, ":", -1)))
        broken = F.array_compact(F.array(*(F.when((value(n) != "") & ~value(n).rlike(p), f"INVALID_FORMAT:{n}") for n, p in checks.items())))
        found = F.concat(conflicts, F.transform(missing, lambda n: F.concat(F.lit(f"{ABSENT}:"), n)), broken)
        return once(found, lambda e: F.struct(d.alias("data"), missing.alias("missing"), e.alias("errors"), F.when(F.size(e) > 0, "MANUAL_REVIEW").otherwise("AUTO_CONTINUE").alias("action")))

    return once(overlay(data, fixed, derived), of)


def field_summary(fields: DataFrame, by: list[str]) -> DataFrame:
    """Counts of fields (value, status) by `by`, completeness, accepted coverage and whether all are accepted."""
    status = lambda s: F.count_if(F.col("status") == s)
    n = F.count("*")
    return fields.groupBy(*by).agg(
        n.alias("expected"), F.count("value").alias("present"), status("ACCEPTED").alias("accepted"), status("NEEDS_REVIEW").alias("needs_review"), status("NOT_FOUND").alias("not_found"),
        F.bround(F.count("value") / n, 6).alias("completeness"), F.bround(status("ACCEPTED") / n, 6).alias("coverage"), (status("ACCEPTED") == n).alias("ready"),
    )


def unexpected_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not allowed, by name."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed))))


def all_keys(json: Column) -> Column:
    """Every key of a JSON text, however deep it stands, by letters and digits alone. Whole strings are read one by one, so a string's content is never taken for a key."""
    strings = F.regexp_extract_all(json, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?)'), F.lit(1))
    keys = F.filter(strings, lambda x: x.endswith(":"))
    return F.transform(keys, lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", ""))


def forbidden_keys(json: Column, forbidden: list[str]) -> Column:
    """Forbidden keys anywhere in a JSON text, compared by letters and digits alone."""
    return F.array_sort(F.array_intersect(all_keys(json), F.array(*map(F.lit, forbidden))))


#: Names of variables that may reach a process, the longest text that they may hold, and content that may not leave (fixed values).
VARIABLES = """applicationId documentType documentReference declaredDocumentType confirmedDocumentType detectedDocumentType workflowDocumentType sourceFormat fileValidationStatus classificationStatus classificationConfidence
parseStatus qualityStatus reviewRequired sensitiveFieldNeedsReview missingCriticalField missingFields businessInconsistency validationErrors requiredFieldsComplete overallConfidence resultReference resultPayloadHash schemaVersion
errorCode idempotencyKey documentTypeDecision userReviewDecision correctionsReference hrReviewDecision hrReviewNoteReference reviewStage reviewerId reviewedAt caseVersion reviewAuditReference reviewedPayloadHash reviewReasonCodes
reuploadCount maxReuploadAttempts finalHrDecision finalHrNoteReference recommendedAction templateId templateVersion parserName parserVersion ocrEngine extractionStatus extractedDataReference autoContinueEnabled hrisUpdateStatus
notificationStatus processingOutcome""".split()
LONGEST = 4096
RAW_CONTENT = ["idpPayload", "rawFile", "ocrText", "recognizedText", "fields", "tables"]


def variable_problems(json: Column, allowed: list[str] = VARIABLES, longest: int = LONGEST) -> Column:
    """`NAME:PROBLEM` of a JSON object's members, in their order: raw content, not allowed, no scalar, or too long; a text that is no object is NOT_AN_OBJECT."""
    members = F.map_entries(F.from_json(json, "map<string, variant>"))

    def problem(m: Column) -> Column:
        kind = F.schema_of_variant(m["value"])
        text = F.when(kind == "STRING", m["value"].cast("string"))
        return (
            F.when(m["key"].isin(*RAW_CONTENT), "RAW_CONTENT").when(~m["key"].isin(*allowed), "NOT_ALLOWED")
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "NOT_A_SCALAR").when(F.length(text) > longest, "TOO_LONG")
        )

    found = F.filter(F.transform(members, lambda m: F.struct(m["key"].alias("k"), problem(m).alias("p"))), lambda x: x["p"].isNotNull())
    return F.coalesce(F.transform(found, lambda x: F.concat_ws(":", x["k"], x["p"])), F.array(F.lit("NOT_AN_OBJECT")))


#: Issues that are inconsistencies of the business (fixed values).
INCONSISTENT = ["FIELD_CONFLICT", "DATE_RANGE_CONFLICT"]


def routing_inputs(rows: DataFrame, auto: bool = False) -> DataFrame:
    """Adds to gated rows what the routing reads: status, review, sensitive, critical, inconsistent, complete, confidence, auto."""
    codes = F.transform("issues", lambda x: x["code"])
    return rows.withColumns({
        "status": F.col("quality_status"), "review": F.col("review_required"), "sensitive": F.exists("fields", lambda f: f["sensitive"] & (f["status"] != "ACCEPTED")), "critical": F.array_contains(codes, "REQUIRED_FIELD_MISSING"),
        "inconsistent": F.arrays_overlap(codes, F.array(*map(F.lit, INCONSISTENT))), "complete": ~F.array_contains(codes, "REQUIRED_FIELD_MISSING"), "confidence": F.col("score"), "auto": F.lit(auto),
    })


def with_truth(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Every predicted field with its true value; null where the truth has none."""
    return predicted.join(truth.select(*keys, F.col("value").alias("truth")), keys, "left")


def first_path(json: Column, paths: list[str]) -> Column:
    """struct<present, text> of the first path of a JSON text that is there; objects and arrays come as the text of their scalars, a line each."""
    def flat(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?|-?[0-9][0-9.eE+-]*|true|false)'), F.lit(1))
        return F.array_join(F.transform(F.filter(tokens, lambda t: ~t.endswith(":")), lambda t: F.regexp_replace(t, '^"|"$', "")), "\n")

    found = F.coalesce(*(F.get_json_object(json, f"$.{p}") for p in paths))
    return F.struct(found.isNotNull().alias("present"), F.when(found.rlike(r"^\s*[\[{]"), flat(found)).otherwise(F.coalesce(found, F.lit(""))).alias("text"))


def attributed(rows: DataFrame) -> DataFrame:
    """(cause, fields, consistent) of fields (confirmed, matched, exact, raw_present, predicted, competing): why they are not exact.

    consistent says whether the causes add up to all fields less the exact ones, which they must.
    """
    cause = (
        F.when(~F.col("confirmed"), "GROUND_TRUTH_REVIEW").when(F.col("matched"), "NORMALIZATION")
        .when(F.col("raw_present") & (~F.col("predicted") | F.col("competing")), "PARSER_BOUNDARY").otherwise("OCR_RECOGNITION")
    )
    totals = rows.agg(F.count_if(~F.col("exact")).alias("_wrong"))
    out = rows.where(~F.col("exact")).groupBy(cause.alias("cause")).agg(F.count("*").alias("fields"))
    check = out.agg(F.coalesce(F.sum("fields"), F.lit(0)).alias("_sum")).crossJoin(totals).select((F.col("_sum") == F.col("_wrong")).alias("consistent"))
    return out.crossJoin(F.broadcast(check))  # one row


def reading_signals(values: Column, raw: Column, next_labels: Column, labels: Column) -> Column:
    """What the readers' values of a field disagree in: region_or_line_merge, diacritic_disagreement, character_omission, label_contamination, else character_substitution.

    raw are the values before cleaning, next_labels and labels patterns of the labels that follow the field and of all labels.
    """
    from quirefold.functions.text import casefold, collapse, fold_key, once, within_in_order

    texts = F.filter(F.transform(values, lambda v: collapse(F.coalesce(v, F.lit("")))), lambda v: v != "")
    hits = lambda xs, ps: F.exists(xs, lambda x: F.exists(ps, lambda p: F.coalesce(F.regexp_like(x, F.concat(F.lit("(?iu)"), p)), F.lit(False))))

    def of(ts: Column) -> Column:
        exact, bases = F.array_distinct(F.transform(ts, casefold)), F.array_distinct(F.transform(ts, fold_key))
        tight = F.transform(bases, lambda b: F.replace(b, F.lit(" "), F.lit("")))
        omitted = F.exists(tight, lambda a: F.exists(tight, lambda b: (a != b) & (F.length(a) <= F.length(b)) & within_in_order(a, b)))
        some = F.size(ts) >= 2
        found = F.array_compact(F.array(
            F.when(hits(raw, next_labels), "region_or_line_merge"), F.when(some & (F.size(exact) > 1) & (F.size(bases) == 1), "diacritic_disagreement"),
            F.when(some & omitted, "character_omission"), F.when(some & hits(ts, labels), "label_contamination"),
        ))
        return once(found, lambda f: F.when((F.size(f) == 0) & some & (F.size(bases) > 1), F.array(F.lit("character_substitution"))).otherwise(f))

    return once(texts, of)


def header_row(rows: DataFrame, key: str, order: str, points: Column, first: int = 20) -> DataFrame:
    """(key, header): of a table's first rows the one with most points; the earliest of equals."""
    best = F.max(F.when(F.col(order) < first, F.struct(points.alias("p"), (-F.col(order)).alias("o"))))
    return rows.groupBy(key).agg((-best["o"]).alias("header"))


def letter_coverage(have: DataFrame, required: list[str]) -> DataFrame:
    """(letter, available) of the required letters; have (letter) is what a reader or a corpus knows. The required ones are a list of fixed size."""
    want = have.sparkSession.createDataFrame([(c,) for c in required], "letter string")
    return F.broadcast(want).join(have.select("letter").distinct().withColumn("available", F.lit(True)), "letter", "left").select("letter", F.coalesce("available", F.lit(False)).alias("available"))
