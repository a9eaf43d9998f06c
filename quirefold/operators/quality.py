"""Validation, quality score and status, routing by code and by decision table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.dates import inclusive_days, span_hours
from quirefold.functions.text import once

#: Cost of an issue by severity (fixed values).
COSTS = {"INFO": 0.01, "WARNING": 0.06, "ERROR": 0.16}

#: First-hit decision table (fixed values): status, review, sensitive, critical missing, inconsistent, complete, least and
#: most confidence (most exclusive unless 1), auto, action. None matches anything; there is no default row.
DECISIONS = [
    ("REJECTED", None, None, None, None, None, None, None, None, "REQUEST_REUPLOAD"),
    (None, None, None, True, None, None, None, None, None, "REQUEST_REUPLOAD"),
    (None, None, True, False, None, None, None, None, None, "HR_REVIEW"),
    (None, None, False, False, True, None, None, None, None, "HR_REVIEW"),
    (None, None, False, False, False, False, None, None, None, "HR_REVIEW"),
    (None, None, False, False, False, True, None, 0.6, None, "REQUEST_REUPLOAD"),
    ("PASS", False, False, False, False, True, 0.9, 1.0, True, "AUTO_CONTINUE"),
    ("REVIEW_REQUIRED", True, False, False, False, True, 0.6, 1.0, None, "USER_REVIEW"),
    ("PASS", False, False, False, False, True, 0.9, 1.0, False, "USER_REVIEW"),
    (None, None, False, False, False, True, 0.6, 0.9, None, "USER_REVIEW"),
]


def score(confidence: Column, found: Column) -> Column:
    """0.4 + 0.6 * confidence less the issues' costs, in [0, 1], four digits."""
    cost = reduce(lambda a, kv: a + F.lit(kv[1]) * F.size(F.filter(found, lambda x: x["severity"] == kv[0])), COSTS.items(), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 + 0.6 * confidence - cost)), 4)


def status(parse_failed: Column, points: Column, found: Column, reasons: Column) -> Column:
    """REJECTED for a failed parse or an error at under 0.25 points, REVIEW_REQUIRED for any reason or issue, else PASS."""
    error = F.exists(found, lambda x: x["severity"] == "ERROR")
    return F.when(parse_failed | ((points < 0.25) & error), "REJECTED").when(reasons | (F.size(found) > 0), "REVIEW_REQUIRED").otherwise("PASS")


def field_status(invalid: Column, sensitive: Column, confidence: Column, least: float = 0.85) -> Column:
    return F.when(invalid, "INVALID").when(sensitive | (confidence < least), "NEEDS_REVIEW").otherwise("ACCEPTED")


#: Reasons for a review (fixed values), by what raises them.
REASONS = {
    "parse": "Parse result is not usable",
    "partial": "Partial parse requires review",
    "warnings": "Parser warnings require review",
    "unknown": "Unknown document type",
    "low_type": "Low classification confidence",
    "ambiguous": "Ambiguous document type",
    "extractor": "No approved extractor",
    "missing": "Required fields are missing",
    "conflict": "Conflicting field values require review",
    "date": "Invalid dates require review",
    "range": "Conflicting dates require review",
    "sensitive": "Sensitive fields require human confirmation",
    "low_field": "Low-confidence fields require review",
}
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _issue(code: Column, severity: str, field: Column | None = None) -> Column:
    return F.struct(code.alias("code"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if field is None else field).alias("field"))


def _checked(x: Column, required: dict[str, list[str]], least: float, least_field: float) -> Column:
    """struct<issues, reasons, invalid> of struct<document_type, confidence, ambiguous, parse_status, warnings, has_extractor, fields>."""
    fields = x["fields"]
    named = lambda n: F.filter(fields, lambda f: f["name"] == n)
    text = lambda f: F.coalesce(f["value"].cast("string"), F.lit("None"))
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
    none = F.array().cast("array<string>")
    wanted = F.coalesce(F.element_at(F.create_map(*(y for k, v in required.items() for y in (F.lit(k), F.array(*map(F.lit, v))))), x["document_type"]), none)
    missing = F.array_sort(F.array_except(wanted, names))
    conflicts = F.filter(names, lambda n: F.size(F.array_distinct(F.transform(named(n), text))) > 1)
    first = lambda n: F.transform(F.slice(named(n), 1, 1), text)  # noqa: E731  (at most one value)
    date = lambda n: F.get(F.transform(first(n), lambda v: F.when(v.rlike(ISO), F.try_to_date(v, "yyyy-MM-dd"))), F.lit(0))
    dates = F.struct(*(F.struct((F.size(first(n)) > 0).alias("has"), date(n).alias("day")).alias(n) for n in ("start_date", "end_date")))

    def of_parts(y: Column) -> Column:
        d, failed = y["dates"], x["parse_status"].isin("FAILED", "REJECTED")
        partial, unknown = x["parse_status"] == "PARTIAL", x["document_type"] == "UNKNOWN"
        low = ~unknown & (x["confidence"] < least)
        bad = [n for n in ("start_date", "end_date")]
        wrong = {n: d[n]["has"] & d[n]["day"].isNull() for n in bad}
        swapped = F.coalesce(d["end_date"]["day"] < d["start_date"]["day"], F.lit(False))
        doubtful = F.filter(fields, lambda f: f["confidence"] < least_field)
        one = lambda c, code, severity, field=None: F.when(F.coalesce(c, F.lit(False)), _issue(F.lit(code), severity, field))
        each = lambda xs, code, severity: F.transform(xs, lambda n: _issue(F.lit(code), severity, n))
        issues = F.concat(
            F.array_compact(F.array(one(failed, "PARSE_NOT_USABLE", "ERROR"), one(partial, "PARTIAL_PARSE", "WARNING"))),
            F.transform(x["warnings"], lambda w: _issue(F.concat(F.lit("PARSER_"), w), "WARNING")),
            F.array_compact(F.array(
                one(unknown, "UNKNOWN_DOCUMENT_TYPE", "WARNING"), one(low, "LOW_CLASSIFICATION_CONFIDENCE", "WARNING"),
                one(x["ambiguous"], "AMBIGUOUS_DOCUMENT_TYPE", "WARNING"), one(~x["has_extractor"], "NO_FIELD_EXTRACTOR", "WARNING"),
            )),
            each(y["missing"], "REQUIRED_FIELD_MISSING", "ERROR"), each(y["conflicts"], "FIELD_CONFLICT", "ERROR"),
            F.array_compact(F.array(*(one(wrong[n], "INVALID_DATE", "ERROR", F.lit(n)) for n in bad), one(swapped, "DATE_RANGE_CONFLICT", "ERROR"))),
            F.transform(doubtful, lambda f: _issue(F.lit("LOW_FIELD_CONFIDENCE"), "WARNING", f["name"])),
        )
        raised = {
            "parse": failed, "partial": partial, "warnings": F.size(x["warnings"]) > 0, "unknown": unknown, "low_type": low, "ambiguous": x["ambiguous"], "extractor": ~x["has_extractor"],
            "missing": F.size(y["missing"]) > 0, "conflict": F.size(y["conflicts"]) > 0, "date": wrong["start_date"] | wrong["end_date"], "range": swapped,
        }
        said = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), REASONS[k]) for k, c in raised.items())))
        # Each field adds its own reasons in turn; what is said already is not said again.
        of_field = lambda f: F.array_compact(F.array(F.when(f["sensitive"], REASONS["sensitive"]), F.when(f["confidence"] < least_field, REASONS["low_field"])))
        reasons = F.array_distinct(F.concat(said, F.flatten(F.transform(fields, of_field))))
        spoilt = F.array_compact(F.array(*(F.when(wrong[n] | swapped, n) for n in bad)))
        return F.struct(issues.alias("issues"), reasons.alias("reasons"), F.array_union(y["conflicts"], spoilt).alias("invalid"))

    return once(F.struct(missing.alias("missing"), conflicts.alias("conflicts"), dates.alias("dates")), of_parts)


def gate(docs: DataFrame, required: dict[str, list[str]], least: float = 0.65, least_field: float = 0.85) -> DataFrame:
    """Adds issues, reasons, score, quality_status and review_required, and a status to each field.

    Rows hold document_type, confidence, ambiguous, parse_status, warnings (array of codes), has_extractor and fields
    (array<struct<name, value, confidence, sensitive>>, in order; nulls count as none). A field is INVALID if its name has
    several values, or names a date that is none or lies before its start; else NEEDS_REVIEW if sensitive or below
    `least_field`. Issues and reasons come in the order in which the rules stand; any of them calls for a review.
    """
    empty = F.filter(F.array(F.lit("")), lambda _: F.lit(False))
    fields = F.coalesce(F.col("fields"), F.filter(F.col("fields"), lambda _: F.lit(False)), F.from_json(F.lit("[]"), docs.schema["fields"].dataType))
    x = F.struct(*(F.col(c) for c in ("document_type", "confidence", "ambiguous", "parse_status", "has_extractor")), F.coalesce("warnings", empty).alias("warnings"), fields.alias("fields"))

    def outcome(x: Column) -> Column:
        def graded(y: Column) -> Column:
            points, failed = score(x["confidence"], y["issues"]), x["parse_status"].isin("FAILED", "REJECTED")
            done = F.transform(x["fields"], lambda f: f.withField("status", field_status(F.array_contains(y["invalid"], f["name"]), f["sensitive"], f["confidence"], least_field)))
            level = once(points, lambda p: F.struct(p.alias("score"), status(failed, p, y["issues"], F.size(y["reasons"]) > 0).alias("status")))
            return F.struct(done.alias("fields"), y["issues"].alias("issues"), y["reasons"].alias("reasons"), level.alias("level"))

        return once(_checked(x, required, least, least_field), graded)

    rows = docs.withColumn("_g", once(x, outcome))
    rows = rows.select(*(c for c in docs.columns if c != "fields"), "_g.fields", "_g.issues", "_g.reasons", F.col("_g.level.score").alias("score"), F.col("_g.level.status").alias("quality_status"))
    return rows.withColumn("review_required", F.col("quality_status") != "PASS")


def route(rows: DataFrame) -> DataFrame:
    """Adds action to rows of the decision table's inputs, by the rules in code, whose default is USER_REVIEW."""
    c = F.col
    return rows.withColumn(
        "action",
        F.when(c("status") == "REJECTED", "REQUEST_REUPLOAD").when(c("critical"), "REQUEST_REUPLOAD").when(c("sensitive") | c("inconsistent"), "HR_REVIEW")
        .when(~c("complete"), "HR_REVIEW").when(c("confidence") < 0.6, "REQUEST_REUPLOAD")
        .when((c("status") == "PASS") & ~c("review") & (c("confidence") >= 0.9) & c("auto"), "AUTO_CONTINUE").otherwise("USER_REVIEW"),
    )


def decide(rows: DataFrame, table: list[tuple] = DECISIONS) -> DataFrame:
    """Adds rule and action: the first row of the decision table that matches; null if none does. The table becomes one
    ordered condition, so rows neither multiply nor move."""
    names = ("status", "review", "sensitive", "critical", "inconsistent", "complete")

    def fits(r: tuple) -> Column:
        *exact, least, most, auto, _ = r
        out = [F.col(n) == v for n, v in zip((*names, "auto"), (*exact, auto), strict=True) if v is not None]
        out += [F.col("confidence") >= least] if least is not None else []
        out += [F.col("confidence") <= most if most == 1 else F.col("confidence") < most] if most is not None else []
        return reduce(lambda a, b: a & b, out, F.lit(True))

    hit = F.coalesce(*(F.when(fits(r), F.struct(F.lit(i).alias("rule"), F.lit(r[-1]).alias("action"))) for i, r in enumerate(table, 1)))
    return rows.withColumn("_hit", hit).select(*rows.columns, "_hit.*")


def leave_errors(rows: DataFrame) -> DataFrame:
    """Adds errors to rows of start_date, end_date, return_date and leave_days."""
    c = F.col
    days = inclusive_days(c("start_date"), c("end_date"))
    rules = [
        (c("start_date") > c("end_date"), "DATE_RANGE_CONFLICT:startDate,endDate"),
        (c("leave_days") > days, "LEAVE_DAYS_EXCEED_DATE_RANGE"),
        (c("return_date") <= c("end_date"), "EXPECTED_RETURN_NOT_AFTER_END"),
        (c("leave_days") <= 0, "LEAVE_DAYS_NOT_POSITIVE"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), code) for x, code in rules))))


def overtime_errors(rows: DataFrame) -> DataFrame:
    """Adds errors to rows of start_date, end_date, start_time, end_time, hours_per_day and total_hours."""
    c = F.col
    span = span_hours(c("start_time"), c("end_time"))
    days = inclusive_days(c("start_date"), c("end_date"))
    rules = [
        (c("start_date") > c("end_date"), "DATE_RANGE_CONFLICT:startDate,endDate"),
        (c("hours_per_day") <= 0, "OVERTIME_HOURS_PER_DAY_NOT_POSITIVE"),
        (c("total_hours") <= 0, "TOTAL_OVERTIME_HOURS_NOT_POSITIVE"),
        (span <= 0, "OVERTIME_TIME_RANGE_CONFLICT"),
        ((span > 0) & (F.abs(span - c("hours_per_day")) > 0.01), "OVERTIME_HOURS_PER_DAY_CONFLICT"),
        ((c("start_date") <= c("end_date")) & (F.abs(days * c("hours_per_day") - c("total_hours")) > 0.01), "TOTAL_OVERTIME_HOURS_CONFLICT"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), code) for x, code in rules))))


def reading_quality(lines: DataFrame, by: list[str], identity: Column, least: float = 0.8) -> DataFrame:
    """(by, lines, low_ratio, critical, corrections, status): PASS, REVIEW or FAIL of documents by the confidences of their lines.

    An identity document fails if over a tenth of its lines are below `least`; any document needs review at over a fifth, with a
    line below 0.5, or with three corrections. Without lines the ratio is 1.
    """
    scored = F.count("confidence")
    ratio = F.coalesce(F.count_if(F.col("confidence") < least) / F.nullif(scored, F.lit(0)), F.lit(1.0))
    critical, fixes = F.count_if(F.col("confidence") < 0.5), F.count_if("corrected")
    status = F.when(F.bool_or(identity) & (ratio > 0.1), "FAIL").when((ratio > 0.2) | (critical > 0) | (fixes >= 3), "REVIEW").otherwise("PASS")
    return lines.groupBy(*by).agg(scored.alias("lines"), F.bround(ratio, 6).alias("low_ratio"), critical.alias("critical"), fixes.alias("corrections"), status.alias("status"))
