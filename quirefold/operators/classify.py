"""Classification by weighted markers. Rules are data; scoring is a projection, so no document is shuffled.

A text is folded once and each marker looked for once: the results are bound to lambda variables, which no branch repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quirefold.functions.text import casefold, fold_match, fold_ocr, has_marker, once, without_marks, without_vietnamese_marks

UNKNOWN = "UNKNOWN"
GENERIC = "GENERIC_DOCUMENT"
IDENTITY = "IDENTITY_DOCUMENT"
OTHER_FAMILY = "OTHER_HR_DOCUMENT"

#: Document types and their markers (fixed values): (type, marker, weight).
DOCUMENT_RULES = [
    ("CV", "curriculum vitae", 3.0),
    ("CV", "cv", 2.0),
    ("CV", "ky nang", 1.0),
    ("CV", "kinh nghiem", 1.0),
    ("CV", "hoc van", 1.0),
    ("EMPLOYMENT_CONTRACT", "hop dong lao dong", 3.0),
    ("EMPLOYMENT_CONTRACT", "employment contract", 3.0),
    ("EMPLOYMENT_CONTRACT", "hop dong thu viec", 3.0),
    ("EMPLOYMENT_CONTRACT", "thu viec", 3.0),
    ("EMPLOYMENT_CONTRACT", "probation", 2.5),
    ("EMPLOYMENT_CONTRACT", "hop dong", 1.5),
    ("EMPLOYMENT_CONTRACT", "dieu khoan", 1.0),
    ("EMPLOYMENT_CONTRACT", "so hop dong", 1.0),
    ("CERTIFICATE", "ielts", 4.0),
    ("CERTIFICATE", "test report form", 4.0),
    ("CERTIFICATE", "overall band score", 3.0),
    ("CERTIFICATE", "candidate number", 2.0),
    ("LEAVE_REQUEST", "don nghi phep", 3.0),
    ("LEAVE_REQUEST", "leave request", 3.0),
    ("LEAVE_REQUEST", "nghi phep", 2.0),
    ("LEAVE_REQUEST", "ly do nghi", 1.0),
    ("ADMINISTRATIVE_FORM", "bieu mau hanh chinh", 3.0),
    ("ADMINISTRATIVE_FORM", "administrative form", 3.0),
    ("ADMINISTRATIVE_FORM", "bieu mau", 1.0),
]


def folded_lines(text: Column, barred: bool = False) -> Column:
    """ASCII words of a text with line ends kept, so that no marker reaches over one; barred: the barred d is a d, else it parts words."""
    plain = without_vietnamese_marks if barred else without_marks
    t = F.regexp_replace(plain(casefold(text)), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(t, " ?\n ?", "\n")


def scores(folded: Column, rules: list[tuple[str, str, float]]) -> Column:
    """array<struct<negative, type, confidence, score, evidence>> of the types with any marker, best first."""
    kinds = sorted({k for k, _, _ in rules})

    def totals(h: Column) -> Column:
        out = []
        for kind in kinds:
            own = [(i, m, w) for i, (k, m, w) in enumerate(rules) if k == kind]
            score = sum((F.when(h[i], w).otherwise(0.0) for i, _, w in own), F.lit(0.0))
            out.append(F.struct(F.lit(kind).alias("type"), score.alias("score"), F.array_compact(F.array(*(F.when(h[i], m) for i, m, _ in own))).alias("evidence")))
        return F.array(*out)

    def ranked(x: Column) -> Column:
        confidence = F.least(F.lit(0.99), x["score"] / (x["score"] + 1.5))
        return F.struct((-confidence).alias("negative"), x["type"].alias("type"), confidence.alias("confidence"), x["score"].alias("score"), x["evidence"].alias("evidence"))

    flat = lambda f: F.translate(f, "\n", " ")
    hits = once(folded, lambda f: once(flat(f), lambda g: F.array(*(has_marker(f if " " in m else g, m) for _, m, _ in rules))))
    return F.array_sort(F.transform(F.filter(once(hits, totals), lambda x: x["score"] > 0), ranked))


def classify(docs: DataFrame, rules: list[tuple[str, str, float]] = DOCUMENT_RULES, text: str = "text", least: float = 0.5) -> DataFrame:
    """Adds document_type, confidence, candidates and ambiguous.

    A type's score is the sum of the weights of its distinct markers that occur; confidence is score / (score + 1.5), at most
    0.99. Below `least` the type is UNKNOWN and the confidence that of having none. Equal confidences go by type name. It is
    ambiguous if the second is at least 0.5 and within 0.08 of the first. Composed and decomposed texts are classified alike.
    """

    def outcome(c: Column) -> Column:
        at = lambda i: F.coalesce(F.get(c, F.lit(i))["confidence"], F.lit(0.0))
        known = at(0) >= least
        return F.struct(
            c.alias("candidates"),
            F.when(known, F.get(c, F.lit(0))["type"]).otherwise(F.lit(UNKNOWN)).alias("document_type"),
            F.when(known, at(0)).otherwise(F.greatest(F.lit(0.0), 1 - at(0))).alias("confidence"),
            ((at(1) >= 0.5) & (at(0) - at(1) <= 0.08)).alias("ambiguous"),
        )

    found = once(scores(folded_lines(F.coalesce(F.col(text), F.lit(""))), rules), outcome)
    return docs.withColumn("_found", found).select(*docs.columns, "_found.*")


#: Templates (fixed values): (id, anchors, least number of anchors, markers that rule it out).
TEMPLATE_RULES = [
    ("leave-request-v1", ["ĐƠN XIN NGHỈ PHÉP", "Lý do xin nghỉ phép", "Tôi đã bàn giao công việc cho"], 2, []),
    ("overtime-request-v1", ["ĐƠN XIN TĂNG CA", "Thời gian đề nghị", "Nội dung công việc"], 3, []),
    ("probation-contract-v2", ["probation", "HỢP ĐỒNG THỬ VIỆC", "THỜI GIAN THỬ VIỆC", "MỨC LƯƠNG"], 2, []),
    ("cv-v2", ["curriculum vitae", "kinh nghiem", "ky nang"], 2, []),
    ("ielts-certificate-v2", ["ielts", "test report form", "overall band score"], 2, []),
    (
        "vietnam-citizen-id-front-v1",
        ["can cuoc cong dan", "cn cuc cng dn", "citizen identity", "citzen identy", "date of birth", "date of bith", "place of origin", "ho va ten", "nationality", "quoc tich"],
        2,
        ["back", "mat sau", "dac diem nhan dang"],
    ),
]
SCANS = ["IMAGE", "PDF_SCAN"]


def _folds(anchor: str) -> tuple[str, str]:
    """The two folds of an anchor, done once when the plan is made: accents kept, and without."""
    import unicodedata

    kept = " ".join(unicodedata.normalize("NFC", anchor).casefold().split())
    plain = "".join(c for c in unicodedata.normalize("NFD", anchor).casefold() if unicodedata.category(c) != "Mn").replace("đ", "d")
    return kept, " ".join(plain.split())


def _like_any(anchors: list[str], least: float):
    """For each scanned text whether it holds something like each anchor; null for other texts."""

    @pandas_udf(T.ArrayType(T.BooleanType()))
    def like(text):  # noqa: ANN001, ANN202
        from quirefold.functions.text import likest_window

        return text.map(lambda t: None if t is None else [likest_window(t, a) >= least for a in anchors])

    return like


def detect_templates(docs: DataFrame, templates: list[tuple] = TEMPLATE_RULES, text: str = "text", source_format: Column | None = None, fuzzy: float = 0.78) -> DataFrame:
    """Adds template, matched and confidence: the template with the largest share of its anchors found.

    templates: (id, anchors, least number of anchors[, markers that rule it out]). An anchor is found with its accents, without
    them, or without spaces too; in scanned documents (source_format) also if a run of words is like it. An exact tie on
    confidence detects nothing.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = fold_ocr(raw)
    every = list(dict.fromkeys(a for _, anchors, *_ in templates for a in anchors))
    folds = {a: _folds(a) for a in every}
    scanned = F.lit(False) if source_format is None else F.coalesce(source_format.isin(*SCANS), F.lit(False))
    bare = F.filter(F.array(F.lit(True)), lambda _: F.lit(False))
    likes = bare if source_format is None else F.coalesce(_like_any([folds[a][1] for a in every], fuzzy)(F.when(scanned, plain)), bare)
    kept = F.lit("") if all(folds[a][0].isascii() for a in every) else fold_match(raw)
    seen = F.struct(kept.alias("kept"), plain.alias("plain"), F.replace(plain, F.lit(" "), F.lit("")).alias("compact"), scanned.alias("scanned"), likes.alias("likes"))

    def hits(x: Column) -> Column:
        out = []
        for i, a in enumerate(every):
            with_marks, without = folds[a]
            hit = x["plain"].contains(without) | x["compact"].contains(without.replace(" ", "")) | F.coalesce(F.get(x["likes"], F.lit(i)), F.lit(False))
            out.append(hit if with_marks.isascii() else hit | x["kept"].contains(with_marks))
        return F.array(*out)

    def found(h: Column, x: Column) -> Column:
        out = []
        for name, anchors, least, *rest in templates:
            n = sum((F.when(h[every.index(a)], 1).otherwise(0) for a in anchors), F.lit(0))
            confidence = F.bround(n / F.lit(float(len(anchors))), 4)
            fits = n >= least
            for marker in rest[0] if rest else []:
                fits &= ~F.when(x["scanned"], x["plain"]).otherwise(x["kept"] if not all(folds[a][0].isascii() for a in every) else x["plain"]).contains(marker)
            out.append(F.when(fits, F.struct((-confidence).alias("negative"), (-n).alias("fewer"), F.lit(name).alias("id"))))
        return F.array_sort(F.array_compact(F.array(*out)))

    def outcome(f: Column) -> Column:
        at = lambda i: F.get(f, F.lit(i))
        tie = F.coalesce(at(0)["negative"] == at(1)["negative"], F.lit(False))
        return F.struct(F.when(~tie, at(0)["id"]).alias("template"), F.when(~tie, -at(0)["fewer"]).alias("matched"), F.when(~tie, -at(0)["negative"]).alias("confidence"))

    best = once(seen, lambda x: once(once(hits(x), lambda h: found(h, x)), outcome))
    return docs.withColumn("_best", best).select(*docs.columns, "_best.*")


def declared_status(declared: Column, detected: Column, mapping: dict[str, str], other: str, accepted: list[str]) -> Column:
    """INVALID, UNKNOWN, CONFIRMED or MISMATCH of a declared type against a detected one."""
    mapped = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), detected), F.lit(other))
    return (
        F.when(~F.coalesce(declared.isin(accepted), F.lit(False)), "INVALID")
        .when(detected == UNKNOWN, "UNKNOWN")
        .when(declared == mapped, "CONFIRMED")
        .otherwise("MISMATCH")
    )


#: Titled document types (fixed values): (type, term, weight); a weight of 5 or more is a title's.
TITLE_RULES = [
    ("CV", "curriculum vitae", 5.0),
    ("CV", "kinh nghiem lam viec", 3.0),
    ("CV", "muc tieu nghe nghiep", 3.0),
    ("CV", "hoc van", 1.5),
    ("CV", "ky nang", 1.0),
    ("DEGREE_CERTIFICATE", "bang tot nghiep", 5.0),
    ("DEGREE_CERTIFICATE", "bang cu nhan", 5.0),
    ("DEGREE_CERTIFICATE", "bang ky su", 5.0),
    ("DEGREE_CERTIFICATE", "bang thac si", 5.0),
    ("DEGREE_CERTIFICATE", "chung chi", 5.0),
    ("DEGREE_CERTIFICATE", "certificate", 3.0),
    ("DEGREE_CERTIFICATE", "so hieu van bang", 2.0),
    ("DEGREE_CERTIFICATE", "nganh dao tao", 1.5),
    ("DEGREE_CERTIFICATE", "xep loai", 1.5),
    ("DEGREE_CERTIFICATE", "hieu truong", 1.5),
    ("EMPLOYMENT_CONTRACT", "hop dong lao dong", 6.0),
    ("EMPLOYMENT_CONTRACT", "ben su dung lao dong", 2.5),
    ("EMPLOYMENT_CONTRACT", "nguoi lao dong", 2.0),
    ("EMPLOYMENT_CONTRACT", "muc luong", 2.0),
    ("EMPLOYMENT_CONTRACT", "dieu khoan", 1.5),
    ("HR_DECISION", "quyet dinh nhan su", 6.0),
    ("HR_DECISION", "giam doc cong ty quyet dinh", 3.0),
    ("HR_DECISION", "bo nhiem", 1.5),
    ("HR_DECISION", "dieu chuyen", 1.5),
    ("HR_DECISION", "hieu luc tu ngay", 1.5),
    ("LEAVE_REQUEST", "don xin nghi phep", 6.0),
    ("LEAVE_REQUEST", "thoi gian nghi", 2.5),
    ("LEAVE_REQUEST", "so ngay nghi", 2.0),
    ("LEAVE_REQUEST", "nguoi lam don", 1.5),
    ("LEAVE_REQUEST", "ly do", 1.0),
    ("EMPLOYEE_INFORMATION_FORM", "phieu thong tin nhan vien", 6.0),
    ("EMPLOYEE_INFORMATION_FORM", "dia chi lien he", 2.0),
    ("EMPLOYEE_INFORMATION_FORM", "ma nhan vien", 1.0),
    ("EMPLOYEE_INFORMATION_FORM", "phong ban", 1.0),
    ("EMPLOYEE_INFORMATION_FORM", "ngay sinh", 1.0),
]
#: Terms that name an identity document wherever they stand (fixed values), and its confidence.
IDENTITY_TITLES = ["the dinh danh cong dan", "can cuoc cong dan", "citizen identity card"]
IDENTITY_CONFIDENCE = 0.98
#: The most that a type can score without its title (fixed values).
UNTITLED = {"EMPLOYEE_INFORMATION_FORM": ("phieu thong tin nhan vien", 2.4)}

#: Subtypes of the document families (fixed values): (type, term, weight); a weight of 5 or more is a title's.
FAMILY_RULES = [
    ("CV", "curriculum vitae", 6.0),
    ("CV", "muc tieu nghe nghiep", 3.0),
    ("CV", "kinh nghiem lam viec", 3.0),
    ("CV", "hoc van", 1.5),
    ("CV", "ky nang", 1.5),
    ("LEAVE_REQUEST", "don de nghi nghi phep", 7.0),
    ("LEAVE_REQUEST", "don xin nghi phep", 7.0),
    ("LEAVE_REQUEST", "thoi gian nghi", 2.0),
    ("OVERTIME_REQUEST", "phieu dang ky lam them gio", 7.0),
    ("OVERTIME_REQUEST", "don dang ky lam them gio", 7.0),
    ("OVERTIME_REQUEST", "gio tang ca", 2.0),
    ("BUSINESS_TRIP_REQUEST", "giay de nghi cong tac", 7.0),
    ("BUSINESS_TRIP_REQUEST", "don de nghi cong tac", 7.0),
    ("BUSINESS_TRIP_REQUEST", "dia diem cong tac", 2.0),
    ("EQUIPMENT_REQUEST", "phieu de nghi cap thiet bi", 7.0),
    ("EQUIPMENT_REQUEST", "de nghi cap thiet bi lam viec", 6.0),
    ("EQUIPMENT_REQUEST", "ten thiet bi", 2.0),
    ("EMPLOYEE_INFO_UPDATE", "phieu de nghi cap nhat thong tin nhan su", 7.0),
    ("EMPLOYEE_INFO_UPDATE", "thong tin de nghi thay doi", 2.0),
    ("EMPLOYMENT_CONTRACT", "hop dong lao dong", 7.0),
    ("EMPLOYMENT_CONTRACT", "hop dong", 2.5),
    ("EMPLOYMENT_CONTRACT", "nguoi lao dong", 2.0),
    ("EMPLOYMENT_CONTRACT", "muc luong", 2.0),
    ("PROBATION_AGREEMENT", "hop dong thu viec", 7.0),
    ("PROBATION_AGREEMENT", "thoi gian thu viec", 2.0),
    ("HR_DECISION", "quyet dinh bo nhiem", 7.0),
    ("HR_DECISION", "quyet dinh dieu chuyen nhan su", 7.0),
    ("HR_DECISION", "quyet dinh dieu chinh tien luong", 7.0),
    ("HR_DECISION", "quyet dinh nhan su", 6.0),
    ("DEGREE_CERTIFICATE", "bang tot nghiep", 7.0),
    ("DEGREE_CERTIFICATE", "bang cu nhan", 7.0),
    ("DEGREE_CERTIFICATE", "chung chi", 7.0),
    ("DEGREE_CERTIFICATE", "certificate", 5.0),
    ("DEGREE_CERTIFICATE", "certification", 5.0),
    ("DEGREE_CERTIFICATE", "credential id", 3.0),
    ("DEGREE_CERTIFICATE", "so hieu van bang", 2.0),
    ("DEGREE_CERTIFICATE", "ielts", 7.0),
    ("DEGREE_CERTIFICATE", "test report form", 6.0),
    ("EMPLOYEE_INFORMATION_FORM", "phieu thong tin nhan vien", 7.0),
    ("EMPLOYEE_INFORMATION_FORM", "thong tin nhan vien", 2.0),
    ("ONBOARDING_CHECKLIST", "checklist tiep nhan nhan vien moi", 7.0),
    ("ONBOARDING_CHECKLIST", "checklist tiep nhan", 7.0),
    ("ONBOARDING_CHECKLIST", "danh sach tiep nhan nhan vien moi", 6.0),
    ("EMPLOYEE_MASTER_LIST", "danh sach nhan su", 7.0),
    ("EMPLOYEE_MASTER_LIST", "danh sach nhan vien", 6.0),
    ("TRAINING_ATTENDANCE", "danh sach tham du va ket qua dao tao", 7.0),
    ("TRAINING_ATTENDANCE", "danh sach tham du dao tao", 7.0),
    ("TRAINING_ATTENDANCE", "ket qua dao tao", 2.0),
]
#: Families and workflow types of document types (fixed values).
FAMILIES = {
    "CV": "CV", "LEAVE_REQUEST": "ADMINISTRATIVE_REQUEST", "OVERTIME_REQUEST": "ADMINISTRATIVE_REQUEST", "BUSINESS_TRIP_REQUEST": "ADMINISTRATIVE_REQUEST", "EQUIPMENT_REQUEST": "ADMINISTRATIVE_REQUEST",
    "EMPLOYEE_INFO_UPDATE": "ADMINISTRATIVE_REQUEST", "EMPLOYMENT_CONTRACT": "CONTRACT_DECISION", "PROBATION_AGREEMENT": "CONTRACT_DECISION", "HR_DECISION": "CONTRACT_DECISION", "DEGREE_CERTIFICATE": "DEGREE_CERTIFICATE",
    "CERTIFICATE": "DEGREE_CERTIFICATE", "EMPLOYEE_INFORMATION_FORM": "EMPLOYEE_FORM_TABLE", "ONBOARDING_CHECKLIST": "EMPLOYEE_FORM_TABLE", "EMPLOYEE_MASTER_LIST": "EMPLOYEE_FORM_TABLE", "TRAINING_ATTENDANCE": "EMPLOYEE_FORM_TABLE",
    IDENTITY: IDENTITY,
}
WORKFLOWS = {
    IDENTITY: IDENTITY, "CV": "CV", "LEAVE_REQUEST": "LEAVE_REQUEST", "OVERTIME_REQUEST": "OVERTIME_REQUEST", "EMPLOYMENT_CONTRACT": "EMPLOYMENT_CONTRACT", "PROBATION_AGREEMENT": "EMPLOYMENT_CONTRACT",
    "HR_DECISION": "HR_DECISION", "DEGREE_CERTIFICATE": "DEGREE", "CERTIFICATE": "CERTIFICATE",
}


def looked_up(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))


def _titled(text: Column, rules: list[tuple[str, str, float]], blocks: int, title: float, bonus: float, by_name: bool, untitled: dict[str, tuple[str, float]], least: float, evidence: int, identity: list[str]) -> Column:
    """struct<document_type, confidence, evidence>; the type is null where the best score is below `least`."""
    kinds = sorted({k for k, _, _ in rules}) if by_name else list(dict.fromkeys(k for k, _, _ in rules))

    def parts(xs: Column) -> Column:
        head = F.concat(F.lit("\n"), F.array_join(F.slice(xs, 1, blocks), "\n"), F.lit("\n"))
        return F.struct(F.array_join(xs, " ").alias("flat"), head.alias("head"))

    begins = lambda x, term: x["head"].contains(f"\n{term} ") | x["head"].contains(f"\n{term}\n")

    def points(x: Column) -> Column:
        out = []
        for _, term, w in rules:
            heads = begins(x, term)
            full = F.lit(w) if w < title else F.when(heads, w).otherwise(w * 0.2)
            out.append(F.when(x["flat"].contains(term), full + F.when(heads, bonus).otherwise(0.0) if bonus else full).otherwise(F.lit(0.0)))
        return F.array(*out)

    def totals(p: Column, x: Column) -> Column:
        out = []
        for place, kind in enumerate(kinds):
            own = [(i, m) for i, (k, m, _) in enumerate(rules) if k == kind]
            score = sum((p[i] for i, _ in own), F.lit(0.0))
            if kind in untitled:
                score = F.when(begins(x, untitled[kind][0]), score).otherwise(F.least(score, F.lit(untitled[kind][1])))
            terms = F.array_compact(F.array(*(F.when(p[i] > 0, m) for i, m in own)))
            out.append(F.struct((-score).alias("negative"), F.lit(place).alias("place"), F.lit(kind).alias("type"), terms.alias("terms")))
        return F.array_sort(F.array(*out))

    def outcome(r: Column, x: Column) -> Column:
        best, second = -F.get(r, F.lit(0))["negative"], F.coalesce(-F.get(r, F.lit(1))["negative"], F.lit(0.0))
        known = best >= least
        confidence = F.least(F.lit(0.99), 0.6 + best * 0.035 + (best - second) * 0.025)
        shows = F.lit(False)
        for term in identity:
            shows |= x["flat"].contains(term)
        return F.struct(
            F.when(shows, IDENTITY).when(known, F.get(r, F.lit(0))["type"]).alias("document_type"),
            F.when(shows, IDENTITY_CONFIDENCE).when(known, F.bround(confidence, 6)).alias("confidence"),
            F.when(shows, F.array(F.lit("identity_document_title"))).when(known, F.slice(F.get(r, F.lit(0))["terms"], 1, evidence)).alias("evidence"),
        )

    lines = F.filter(F.split(folded_lines(F.coalesce(text, F.lit("")), barred=True), "\n"), lambda x: F.trim(x) != "")
    lines = F.transform(lines, lambda x: F.trim(x))
    return once(lines, lambda xs: once(parts(xs), lambda x: once(once(points(x), lambda p: totals(p, x)), lambda r: outcome(r, x))))


def classify_titled(docs: DataFrame, rules: list[tuple[str, str, float]] = TITLE_RULES, text: str = "text", blocks: int = 6, title: float = 5.0, least: float = 2.5, identity: list[str] = IDENTITY_TITLES) -> DataFrame:
    """Adds document_type, confidence, evidence and accepted. A title's weight counts a fifth unless one of the first lines begins with the term.

    Below `least` the type is generic at 0.55; else confidence is 0.6 + 0.035 * score + 0.025 * margin, at most 0.99, accepted
    from 0.8. Equal scores go by the order of the rules. A text that names an identity document is one, at 0.98.
    """
    found = _titled(F.col(text), rules, blocks, title, 0.0, False, UNTITLED, least, 6, identity)
    rows = docs.withColumn("_t", found)
    confidence = F.coalesce(F.col("_t.confidence"), F.lit(0.55))
    return rows.select(*docs.columns, F.coalesce("_t.document_type", F.lit(GENERIC)).alias("document_type"), confidence.alias("confidence"), F.coalesce("_t.evidence", F.array().cast("array<string>")).alias("evidence"), (confidence >= 0.8).alias("accepted"))


def classify_family(docs: DataFrame, rules: list[tuple[str, str, float]] = FAMILY_RULES, text: str = "text", blocks: int = 8, least: float = 2.5, fallback: list[tuple[str, str, float]] = TITLE_RULES) -> DataFrame:
    """Adds document_type, family, workflow_type, confidence, evidence and accepted.

    As classify_titled, with one point more for each term that begins one of the first lines and equal scores by name; below
    `least` the titled classification holds. Identity documents are told first.
    """
    base = classify_titled(docs, fallback, text)
    own = _titled(F.col(text), rules, blocks, 5.0, 1.0, True, {}, least, 8, [])
    rows = base.withColumn("_f", own)
    use = F.col("_f.document_type").isNotNull() & (F.col("document_type") != IDENTITY)
    kind = F.when(use, F.col("_f.document_type")).otherwise(F.col("document_type"))
    confidence = F.when(use, F.col("_f.confidence")).otherwise(F.col("confidence"))
    rows = rows.select(*docs.columns, kind.alias("document_type"), confidence.alias("confidence"), F.when(use, F.col("_f.evidence")).otherwise(F.col("evidence")).alias("evidence"), (confidence >= 0.8).alias("accepted"))
    return rows.withColumns({"family": looked_up(FAMILIES, F.col("document_type"), OTHER_FAMILY), "workflow_type": looked_up(WORKFLOWS, F.col("document_type"), OTHER_FAMILY)})


#: Terms of the early route (fixed values).
ROUTE_IDENTITY = ["can cuoc cong dan", "citizen identity card", "place of origin", "noi thuong tru", "nationality"]
ROUTE_CV = ["kinh nghiem lam viec", "kinh nghim lam vic", "muc tieu nghe nghiep", "muc tieu ngh nghip", "ky nang", "k nang", "curriculum vitae", "email"]
#: Sections that contradict an identity document (fixed values).
CV_SECTIONS = ["kinh nghiem", "hoc van", "ky nang", "portfolio", "muc tieu nghe nghiep"]


def key_text(text: Column) -> Column:
    """A whole text as the accent-free key of one line."""
    return F.trim(F.regexp_replace(without_vietnamese_marks(casefold(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def early_route(text: Column) -> Column:
    """struct<route, confidence, evidence>: identity by any of its terms, a CV by two of its, else generic."""

    def outcome(x: Column) -> Column:
        n, cv = F.size(x["identity"]), F.size(x["cv"])
        is_cv = (cv >= 2) | (x["key"].contains("email") & x["key"].contains("kinh nghiem"))
        return F.struct(
            F.when(n > 0, IDENTITY).when(is_cv, "CV").otherwise(GENERIC).alias("route"),
            F.when(n > 0, F.least(F.lit(0.98), 0.72 + 0.08 * n)).when(is_cv, F.least(F.lit(0.96), 0.68 + 0.07 * cv)).otherwise(F.lit(0.55)).alias("confidence"),
            F.when(n > 0, F.slice(x["identity"], 1, 3)).when(is_cv, F.slice(x["cv"], 1, 3)).otherwise(F.array().cast("array<string>")).alias("evidence"),
        )

    among = lambda k, terms: F.filter(F.array(*map(F.lit, terms)), lambda m: k.contains(m))
    return once(key_text(text), lambda k: once(F.struct(k.alias("key"), among(k, ROUTE_IDENTITY).alias("identity"), among(k, ROUTE_CV).alias("cv")), outcome))


def safe_route(route: Column, text: Column) -> Column:
    """An identity route is dropped where two sections of a CV contradict it; other routes stay."""
    contradicted = once(key_text(text), lambda k: F.size(F.filter(F.array(*map(F.lit, CV_SECTIONS)), lambda m: k.contains(m))) >= 2)
    return F.when((route != IDENTITY) | ~contradicted, route)


def page_mode(native_chars: Column, scan_chars: Column, similarity: Column) -> Column:
    """empty, scan, native or hybrid of a page, by the characters of its native and recognized text and their likeness."""
    return F.when(native_chars < 20, F.when(scan_chars > 0, "scan").otherwise("empty")).when((scan_chars < 20) | (similarity >= 0.72), "native").otherwise("hybrid")


def document_modes(pages: DataFrame, key: str, mode: str = "mode") -> DataFrame:
    """(key, document_mode): EMPTY, NATIVE or SCAN if all filled pages are so, else HYBRID."""
    some = F.collect_set(F.when(F.col(mode) != "empty", F.col(mode)))
    kind = F.when(F.size(some) == 0, "EMPTY").when((F.size(some) == 1) & (F.get(some, F.lit(0)) != "hybrid"), F.upper(F.get(some, F.lit(0)))).otherwise("HYBRID")
    return pages.groupBy(key).agg(kind.alias("document_mode"))


def reading_scope(source_format: Column, declared: Column, allowed: list[str]) -> Column:
    """NATIVE_ONLY for formats that carry text, else whether the declared type may be recognized."""
    scans = source_format.isin(*SCANS)
    return F.when(~scans, "NATIVE_ONLY").when(F.coalesce(F.upper(F.trim(declared)).isin(*allowed), F.lit(False)), "OCR_ALLOWED").otherwise("UNSUPPORTED_NO_OCR")
