"""Template documents: requests, identity cards, CVs, contracts and score reports.

Requests are sentences of a whole text, so their fields are groups of a few patterns, each searched once and then taken
apart within the short match. The others are rules over blocks, as in forms.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.dates import first_date, named_dates
from quirefold.functions.text import casefold, collapse, fold_ocr, likest_window, once, strip_terminal
from quirefold.operators.forms import FLAGS, NO_NAME, PREFIX, Rule, among, begins_with, edge, filled as filled_text, first_of, folded, hit, is_heading, key_of, leads, letters_of, pattern, section, with_instead, within, words_of
from quirefold.operators.observe import lines_of

I, S = "(?iu)", "(?ius)"


def only(text: Column, p: str) -> Column:
    """struct<value, conflict>: the one distinct value of the pattern's group, but for case and spacing; null and a conflict if there are several."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(I + p), F.lit(1)), lambda x: collapse(x)), lambda x: x != "")
    many = lambda xs: F.when(F.size(xs) > 1, F.size(F.array_distinct(F.transform(xs, casefold))) > 1).otherwise(False)
    one = lambda xs, several: F.struct(F.when((F.size(xs) > 0) & ~several, ended(F.get(xs, F.lit(0)))).alias("value"), several.alias("conflict"))
    return once(found, lambda xs: once(many(xs), lambda several: one(xs, several)))


def groups(text: Column, p: str, n: int) -> Column:
    """array<string> of the n groups of a pattern's first match; null without one. The groups are taken within the match."""
    return once(F.regexp_extract(text, S + p, 0), lambda m: F.when(m != "", F.array(*(filled_text(F.trim(F.regexp_extract(m, S + p, i))) for i in range(1, n + 1)))))


def iso(text: Column) -> Column:
    return first_date(text).cast("string")


def number(text: Column) -> Column:
    """A number as text, whole if it is."""
    d = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(38,6)")
    return once(d, lambda d: F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("double").cast("string")))


def clock(hour: Column, minute: Column) -> Column:
    of = lambda x: F.when(x["h"].between(0, 23) & x["m"].between(0, 59), F.format_string("%02d:%02d", x["h"], x["m"]))
    return once(F.struct(hour.try_cast("int").alias("h"), F.coalesce(minute, F.lit("0")).try_cast("int").alias("m")), of)


def ended(text: Column) -> Column:
    return filled_text(strip_terminal(text))


#: Patterns of a leave request and of an overtime request (fixed values).
DAY = r"(\d{1,2}/\d{1,2}/\d{4})"
AMOUNT = r"(\d+(?:[.,]\d+)?)"
LEAVE_PERIOD = rf"trong\s+thời\s+gian\s+{AMOUNT}\s+ngày.*?kể\s+từ\s+ngày\s+{DAY}.*?đến\s+hết\s+ngày\s+{DAY}"
LEAVE_PERIOD_SCAN = rf"gian\s+{AMOUNT}\s+ngày.*?{DAY}.*?{DAY}"
LEAVE_REASON = rf"Lý\s+do\s+xin\s+nghỉ\s+phép\s*:\s*(.+?)\.\s*Tôi\s+dự\s+kiến\s+trở\s+lại\s+làm\s+việc\s+vào\s+ngày\s+{DAY}"
LEAVE_REASON_SCAN = rf"Lý\s+do\s+xin\s+nghi\s+phép\s*:\s*(.+?)\.\s*Tôi\s+d\s+ki.n.*?ngày\s+{DAY}"
HANDOVER = r"Tôi\s+đã\s+bàn\s+giao\s+công\s+việc\s+cho\s*:\s*([^\n]+?)\s*-\s*Bộ\s+phận\s*:\s*([^\n]+?)(?:\.|\n)"
LEAVE_ONLY = {
    "organization": r"Kính\s+gửi\s*:\s*(?:-\s*)?Ban\s+Giám\s+đốc\s+([^\n]+)",
    "employeeName": r"Tôi\s+tên\s+là\s*:\s*([^\n]+)",
    "jobTitle": r"Chức\s+vụ\s*:\s*([^\n]+)",
    "department": r"(?m)^Bộ\s+phận\s*:\s*([^\n.]+)$",
    "address": r"Địa\s+chỉ\s*:\s*([^\n]+)",
    "phone": r"Điện\s+thoại\s*:\s*([^\n]+)",
    "handoverTasks": r"Các\s+công\s+việc\s+được\s+bàn\s+giao\s*:\s*([^\n]+)",
}
LEAVE_LINE = r"Lý\s+do\s+xin\s+nghỉ\s+phép\s*:\s*([^\n]+)"
LEAVE_SCAN_LINES = {"employeeName": r"(?m)^Tôi\s+tên\s+là\s*:?\s*(.+)$", "jobTitle": r"(?m)^Ch.c\s+v.\s*:?\s*(.+)$", "department": r"(?m)^B.\s+ph.n\s*:?\s*(.+)$"}
OT_CONTRACT = rf"Hợp\s+đồng\s+lao\s+động\s+số\s+([^\n]+?)\s+ký\s+ngày\s+{DAY}"
OT_REASON = r"thời\s+gian\s+làm\s+việc\s+(.+?)\.\s*Do\s+(.+?),\s*tôi\s+đề\s+nghị"
_FROM = r"từ\s+(\d{1,2})\s+giờ(?:\s+(\d{1,2})\s+phút)?\s+đến\s+(\d{1,2})\s+giờ(?:\s+(\d{1,2})\s+phút)?.*?tổng\s+thời\s+gian\s+dự\s+kiến\s+là\s+" + AMOUNT + r"\s+giờ"
OT_PERIOD = rf"Thời\s+gian\s+đề\s+nghị\s*:\s*Từ\s+ngày\s+{DAY}\s+đến\s+hết\s+ngày\s+{DAY}.*?(?:tăng|làm)\s+thêm\s+{AMOUNT}\s+giờ\s+mỗi\s+ngày,\s+{_FROM}"
OT_DAY = rf"Thời\s+gian\s+đề\s+nghị\s*:\s*Ngày\s+{DAY}\s*,?\s*(?:tăng|làm)\s+thêm\s+{AMOUNT}\s+giờ\s*,?\s*{_FROM}"
OT_PERSON = r"Tôi\s+là\s*:\s*([^\n]+?)\s*-\s*Chức\s+vụ\s*:\s*([^\n]+)"
OT_REASON_SCAN = r"thi\s+gian\s+làm\s+vi.c\s+(.+?)\.\s*Do\s+(.+?),\s*t[ôo]i\s+(?:đ|d).{0,4}ngh"
OT_PERIOD_SCAN = (
    rf"Thi\s+gian\s+.{{0,12}}ngh\s*:\s*T.\s+ngày\s+{DAY}.*?ngày\s+{DAY}.*?(?:tăng|làm)\s+thêm\s+{AMOUNT}\s+gi.{{0,3}}mi\s+ngày.*?t.\s+(\d{{1,2}})\s+gi(?:\s+(\d{{1,2}})\s+phút)?.*?"
    rf"(?:đ|d).{{0,3}}\s+(\d{{1,2}})\s+gi(?:\s+(\d{{1,2}})\s+phút)?.*?t.ng\s+thi\s+gian\s+d.\s+ki.n\s+là\s+{AMOUNT}\s+gi"
)
OT_WORK_SCAN = r"N.i\s+dung\s+công\s+vi.c\s*:?\s*([\s\S]+?)(?:\.\s*Tôi\s+cam|\nTôi\s+cam|$)"
OT_SIGNED = r"NGƯỜI\s+LÀM\s+ĐƠN\s*\n(?:\([^\n]*\)\s*\n)?([^\n]+)"
#: Figures of an overtime block in text without marks: hours more a day, what follows them, clock times, all hours.
OT_MORE, OT_AFTER, OT_CLOCKS, OT_TOTAL = r"t.?ng\s+them\s+(\d+(?:[.,]\d+)?)\s+gi\w*", r"t.?ng\s+them\s+\d+(?:[.,]\d+)?\s+gi\w*(.*)", r"\b(\d{1,2}\s+gi\w*\s+\d{1,2}\s+phut)\b", r"t.?ng\s+thi\s+gian.*?\b(\d+(?:[.,]\d+)?)\s+gi\w*"
APPROVER = ("trưởng bộ phận", "ký")
OT_PERSON_SCAN = r"Tôi\s+là\s*:\s*([^\n]+?)\s*-\s*Ch.c\s+v.\s*:\s*([^\n]+)"
OT_ONLY = {
    "organization": r"Kính\s+gửi\s*:\s*Ban\s+Giám\s+đốc\s+([^\n.]+)",
    "workContent": r"Nội\s+dung\s+công\s+việc\s*:\s*([\s\S]+?)(?:\.\s*Tôi\s+cam\s+kết|\nTôi\s+cam\s+kết|$)",
}


Looked = Callable[[Column], dict[str, Column]]


def _request(text: Column, once_only: dict[str, str], looked: Looked, rest: Callable[[Column, dict[str, Column], Column], dict[str, Column]]) -> Column:
    """struct<fields map<string,string>, conflicts array<string>> of a request. What looked gives of the text is computed once, however many fields rest takes from it."""

    def of(t: Column) -> Column:
        def built(u: Column) -> Column:
            fields = rest(t, {n: u[n]["value"] for n in once_only}, u["_looked"])
            data = F.create_map(*(x for n, v in sorted(fields.items()) for x in (F.lit(n), v)))
            return F.struct(F.map_filter(data, lambda _, v: v.isNotNull()).alias("fields"), F.array_compact(F.array(*(F.when(u[n]["conflict"], n) for n in sorted(once_only)))).alias("conflicts"))

        found = F.struct(*(x.alias(n) for n, x in looked(t).items()))
        return once(F.struct(*(only(t, p).alias(n) for n, p in once_only.items()), found.alias("_looked")), built)

    return once(F.coalesce(text, F.lit("")), of)


def approver(tables: Column) -> Column:
    """The name below the head of department's heading, in the third row of the first table array<array<array<string>>> that has both; signing notes are no name."""

    def of(t: Column) -> Column:
        head = casefold(F.get(F.get(t, F.lit(0)), F.lit(0))).contains(APPROVER[0])
        return F.when((F.size(t) >= 3) & head, once(ended(F.get(F.get(t, F.lit(2)), F.lit(0))), lambda name: F.when(~casefold(name).contains(APPROVER[1]), name)))

    return F.get(F.filter(F.transform(tables, of), lambda x: x.isNotNull()), F.lit(0))


def leave_request(text: Column, scanned: Column | None = None, tables: Column | None = None) -> Column:
    """Fields of a leave request. Scanned texts, which may lack marks, also take looser patterns and the dates in their order; the approver stands in a table."""
    scan = F.lit(False) if scanned is None else F.coalesce(scanned, F.lit(False))

    def looked(t: Column) -> dict[str, Column]:
        slack = lambda p, q, n: groups(t, p, n) if scanned is None else F.coalesce(groups(t, p, n), F.when(scan, groups(t, q, n)))
        period = lambda g: F.struct(number(g[0]).alias("days"), iso(g[1]).alias("start"), iso(g[2]).alias("end"))
        out = {"period": once(slack(LEAVE_PERIOD, LEAVE_PERIOD_SCAN, 3), period), "reason": slack(LEAVE_REASON, LEAVE_REASON_SCAN, 2), "over": groups(t, HANDOVER, 2), "asked": named_dates(t)}
        return out if scanned is None else out | {"dates": F.regexp_extract_all(t, F.lit(DAY), F.lit(1))}

    def rest(t: Column, u: dict[str, Column], x: Column) -> dict[str, Column]:
        period, reason, over, asked = (x[n] for n in ("period", "reason", "over", "asked"))
        from_scan = lambda i, least: F.when(scan & (F.size(x["dates"]) >= least), iso(F.get(x["dates"], F.lit(i))))
        out = {
            **u,
            "requestDate": F.get(asked, F.size(asked) - 1).cast("string"),
            "leaveDays": period["days"],
            "startDate": period["start"],
            "endDate": period["end"],
            "reason": F.coalesce(ended(reason[0]), only(t, LEAVE_LINE)["value"]),
            "expectedReturnDate": iso(reason[1]),
            "handoverTo": ended(over[0]),
            "handoverDepartment": ended(over[1]),
        }
        if tables is not None:
            out["approverName"] = approver(tables)
        if scanned is not None:
            for n, p in LEAVE_SCAN_LINES.items():
                out[n] = F.coalesce(out[n], F.when(scan, ended(F.regexp_extract(t, I + p, 1))))
            out["endDate"] = F.when(out["startDate"].isNull(), F.coalesce(out["endDate"], from_scan(1, 2))).otherwise(out["endDate"])
            out["startDate"] = F.coalesce(out["startDate"], from_scan(0, 2))
            out["expectedReturnDate"] = F.coalesce(out["expectedReturnDate"], from_scan(2, 3))
        return out

    return _request(text, LEAVE_ONLY, looked, rest)


def overtime_request(text: Column, scanned: Column | None = None) -> Column:
    """Fields of an overtime request, for a period or a single day. Scanned texts also take looser patterns, figures of their text without marks, and the signature's name."""
    scan = F.lit(False) if scanned is None else F.coalesce(scanned, F.lit(False))

    def looked(t: Column) -> dict[str, Column]:
        one = once(groups(t, OT_DAY, 7), lambda g: F.when(g.isNotNull(), F.array(g[0], *(g[i] for i in range(7)))))
        loose = lambda found, p, n: found if scanned is None else F.coalesce(found, F.when(scan, groups(t, p, n)))

        def period(g: Column) -> Column:
            return F.struct(iso(g[0]).alias("start"), iso(g[1]).alias("end"), number(g[2]).alias("hours"), clock(g[3], g[4]).alias("from"), clock(g[5], g[6]).alias("to"), number(g[7]).alias("total"))

        out = {
            "period": once(loose(F.coalesce(groups(t, OT_PERIOD, 8), one), OT_PERIOD_SCAN, 8), period), "person": loose(groups(t, OT_PERSON, 2), OT_PERSON_SCAN, 2),
            "reason": loose(groups(t, OT_REASON, 2), OT_REASON_SCAN, 2), "contract": groups(t, OT_CONTRACT, 2), "asked": named_dates(t),
        }
        return out if scanned is None else out | {"dates": F.regexp_extract_all(t, F.lit(DAY), F.lit(1)), "plain": F.when(scan, fold_ocr(t))}

    def clocks(plain: Column) -> Column:
        """The first two clock times behind the hours more, as they are shown; null for fewer."""
        late = F.coalesce(filled_text(F.regexp_extract(plain, S + OT_AFTER, 1)), plain)
        shown = lambda c: clock(F.regexp_extract(c, r"^(\d+)", 1), F.regexp_extract(c, r"(\d+)\s+phut$", 1))
        return once(F.regexp_extract_all(late, F.lit(I + OT_CLOCKS), F.lit(1)), lambda cs: F.when(F.size(cs) >= 2, F.transform(F.slice(cs, 1, 2), shown)))

    def rest(t: Column, u: dict[str, Column], x: Column) -> dict[str, Column]:
        period, person, reason, contract, asked = (x[n] for n in ("period", "person", "reason", "contract", "asked"))
        out = {
            **u,
            "employeeName": ended(person[0]),
            "jobTitle": ended(person[1]),
            "requestDate": F.get(asked, F.lit(0)).cast("string"),
            "laborContractNumber": ended(contract[0]),
            "laborContractDate": iso(contract[1]),
            "standardWorkSchedule": ended(reason[0]),
            "reason": ended(reason[1]),
            "startDate": period["start"],
            "endDate": period["end"],
            "overtimeHoursPerDay": period["hours"],
            "overtimeStartTime": period["from"],
            "overtimeEndTime": period["to"],
            "totalOvertimeHours": period["total"],
        }
        if scanned is not None:
            plain, dates = x["plain"], x["dates"]
            at = lambda i: F.get(clocks(plain), F.lit(i))
            figure = lambda p: number(filled_text(F.regexp_extract(plain, S + p, 1)))
            enough = out["startDate"].isNull() & (F.size(dates) >= 3)
            more = {
                "workContent": ended(F.regexp_extract(t, S + OT_WORK_SCAN, 1)), "startDate": F.when(enough, iso(F.get(dates, F.lit(1)))), "overtimeHoursPerDay": figure(OT_MORE),
                "overtimeStartTime": at(0), "overtimeEndTime": at(1), "totalOvertimeHours": figure(OT_TOTAL),
            }
            out["endDate"] = F.when(scan & enough, iso(F.get(dates, F.lit(2)))).otherwise(out["endDate"])
            out |= {n: F.coalesce(out[n], F.when(scan, x)) for n, x in more.items()}
            out["employeeName"] = F.coalesce(F.when(scan, ended(F.regexp_extract(t, I + OT_SIGNED, 1))), out["employeeName"])
        return out

    return _request(text, OT_ONLY, looked, rest)


def filled(fields: Column, second: Column) -> Column:
    """A map of fields in which those of a second pass fill the absent ones only."""
    second = F.map_filter(F.coalesce(second, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(fields, k))
    return F.map_concat(fields, second)


def region_evidence(json: Column) -> Column:
    """map<field, text> of a JSON list of {field, text}; empty for anything else. The first text of a field counts."""
    items = F.coalesce(F.from_json(json, "array<struct<field: string, text: string>>"), F.from_json(F.lit("[]"), "array<struct<field: string, text: string>>"))
    items = F.filter(items, lambda x: x["field"].isNotNull() & x["text"].isNotNull())
    firsts = F.filter(F.transform(items, lambda x, i: F.struct(x["field"].alias("field"), x["text"].alias("text"), i.alias("i"))), lambda x: F.array_position(F.transform(items, lambda y: y["field"]), x["field"]) == x["i"] + 1)
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["field"], ended(x["text"]))))


#: Labels of a scanned page and the bands of its height that hold them (fixed values).
BANDS = {
    "employeeName": ("Tôi tên là", 0.16, 0.22),
    "jobTitle": ("Chức vụ", 0.19, 0.26),
    "department": ("Bộ phận", 0.21, 0.30),
    "address": ("Địa chỉ", 0.23, 0.31),
    "phone": ("Điện thoại", 0.25, 0.34),
}
LIKE = 0.62


def in_band(y0: Column, y1: Column, height: Column, low: float, high: float) -> Column:
    """Whether a line's middle lies in a band of the page's height."""
    return ((y0 + y1) / 2 / F.nullif(height, F.lit(0.0))).between(low, high)


@F.pandas_udf(T.BooleanType())
def labelled_like(text: pd.Series, label: pd.Series) -> pd.Series:
    """Whether a folded line holds something like a folded label."""
    return pd.Series([t is not None and likest_window(t, x) >= LIKE for t, x in zip(text, label, strict=True)], dtype=bool)


def band_fields(lines: DataFrame, key: str, bands: dict[str, tuple[str, float, float]] = BANDS) -> DataFrame:
    """(key, fields map): for each label the first line in its band of the page that is like it, cut behind its colon.

    lines (key, seq, text, y0, y1). Pages are bounded groups; only lines in a band are compared in Python.
    """
    heights = lines.groupBy(key).agg(F.max("y1").alias("_h"))
    rows = lines.join(heights, key)
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(folded_mark(label)).alias("label"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (label, lo, hi) in bands.items()))
    middle = (F.col("y0") + F.col("y1")) / 2 / F.nullif(F.col("_h"), F.lit(0.0))
    rows = rows.withColumn("b", F.explode(F.filter(wanted, lambda w: middle.between(w["lo"], w["hi"])))).withColumn("_like", labelled_like(fold_ocr(F.col("text")), F.col("b.label")))
    value = ended(F.when(F.instr("text", ":") > 0, F.regexp_extract("text", "(?s):(.*)$", 1)).otherwise(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), F.size(F.split("b.label", " ")) + 1, 1 << 20), " ")))
    rows = rows.where("_like").select(key, "seq", F.col("b.name").alias("name"), value.alias("value")).where("value IS NOT NULL")
    first = rows.groupBy(key, "name").agg(F.min_by("value", "seq").alias("value"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))


def folded_mark(label: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", label).casefold() if unicodedata.category(c) != "Mn").replace("đ", "d")
    return " ".join(plain.split())


def review_only(text: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """map<string,string>: what stands behind the colon of the first line that holds one of a field's labels, else the next line if that has no colon."""

    def of(lines: Column) -> Column:
        def value(words: list[str]) -> Column:
            def one(x: Column, i: Column) -> Column:
                nxt = F.get(lines, i + 1)["raw"]
                after = ended(F.regexp_extract(x["raw"], "(?s):(.*)$", 1))
                return F.when(F.exists(F.array(*map(F.lit, words)), lambda w: x["plain"].contains(w)), F.coalesce(after, F.when(~nxt.contains(":"), ended(nxt))))

            return F.get(F.filter(F.transform(lines, one), lambda v: v.isNotNull()), F.lit(0))

        out = F.create_map(*(c for name, words in labels.items() for c in (F.lit(name), value([folded_mark(w) for w in words]))))
        return F.map_filter(out, lambda _, v: v.isNotNull())

    return once(F.transform(lines_of(F.coalesce(text, F.lit(""))), lambda x: F.struct(x.alias("raw"), fold_ocr(x).alias("plain"))), of)


def manual_only(fields: Column, required: list[str], confidence: Column, conflicts: Column, exact: Column) -> Column:
    """struct<missing, errors, confidence, action>: such a document is always reviewed, at a confidence of at most 0.8."""
    missing = F.array_sort(F.filter(F.array(*map(F.lit, required)), lambda n: F.coalesce(F.element_at(fields, n), F.lit("")) == ""))
    errors = F.concat(F.array(F.lit("REVIEW_FIRST_REQUIRED")), F.array_compact(F.array(F.when(~exact, "TEMPLATE_ANCHOR_PARTIAL"))), F.transform(conflicts, lambda c: F.concat(F.lit("MULTIPLE_CANDIDATES:"), c)))
    return F.struct(missing.alias("missing"), F.array_distinct(errors).alias("errors"), F.least(F.lit(0.8), confidence).alias("confidence"), F.lit("MANUAL_REVIEW").alias("action"))


def scanned_confidence(confidence: Column, scan: Column, lines: Column) -> Column:
    """A scanned document is no surer than its lines; without any it has no confidence."""
    return F.when(scan, F.least(confidence, F.coalesce(lines, F.lit(0.0)))).otherwise(confidence)


# --- rules over blocks ------------------------------------------------------------------------------------------

DASHES = " :|-–—"


def stopped(name: str, labels: tuple[str, ...], stops: tuple[str, ...] = (), convert=None, method: str = "label_value") -> Rule:
    """What stands behind a label that begins a block, list marks apart, up to the next label; else the next block unless a label begins it."""
    own, every = [folded(x) for x in labels], [folded(x) for x in dict.fromkeys((*labels, *stops))]

    def cut(value: Column) -> Column:
        parts = F.transform(F.split(value, r"\s+[|;/]\s+|\s{2,}"), lambda s: F.struct(s.alias("s"), begins_with(key_of(F.regexp_replace(s, PREFIX, "")), every).alias("stop")))

        def kept(ps: Column) -> Column:
            ends = F.array_min(F.filter(F.transform(ps, lambda p, i: F.when(p["stop"] & (i > 0), i)), lambda i: i.isNotNull()))
            return edge(F.array_join(F.transform(F.slice(ps, 1, F.coalesce(ends, F.size(ps))), lambda p: p["s"]), " "), DASHES)

        return once(parts, kept)

    def found(blocks: Column) -> Column:
        def of(x: dict[str, Column]) -> Column:
            raw, key, i = x["raw"], x["key"], x["i"]
            words = F.split(F.trim(raw), r"\s+")
            after = F.when(F.instr(raw, ":") > 0, F.regexp_extract(raw, "(?s):(.*)$", 1))
            behind = F.coalesce(after, *(F.when((key == w) | key.startswith(f"{w} "), F.array_join(F.slice(words, len(w.split()) + 1, 1 << 20), " ")) for w in own))
            value, nxt = edge(behind, DASHES), F.trim(F.get(blocks, i + 1)["text"])
            free = nxt.isNotNull() & (nxt != "") & ~begins_with(F.get(blocks, i + 1)["key"], every)
            return once(value, lambda v: F.when(v != "", hit(cut(v), i)).when(free, hit(cut(nxt), i + 1)))

        def one(b: Column, i: Column) -> Column:
            return F.when(leads(b["bare_lead"], own), of({"raw": b["bare"], "key": b["bare_key"], "i": i}))

        hits = F.filter(F.transform(blocks, one), lambda h: h.isNotNull())
        return F.filter(hits, lambda h: convert(h["value"]).isNotNull()) if convert else hits

    return Rule(name, found, method, convert)


def near(texts: list[Column], anchors: tuple[str, ...]) -> Column:
    """Whether one of the small-letter texts holds one of the words."""
    return reduce(operator.or_, (F.contains(t, F.lit(a)) for t in texts for a in anchors))


def joined(name: str, patterns: tuple[str, ...], convert=None, method: str = "narrative", next_too: bool = True, anchors: tuple[str, ...] = ()) -> Rule:
    """The group of a pattern in a block, or in a block and the one that follows it. anchors: small-letter words, without spaces, of which a text holds one wherever a pattern matches."""

    def tried(text: Column, at: Column, p: str) -> Column:
        good = (lambda v: (v != "") & convert(v).isNotNull()) if convert else (lambda v: v != "")
        return once(edge(F.regexp_extract(text, FLAGS + p, 1), " .,:;-–—"), lambda v: F.when(good(v), hit(v, at)))

    def found(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            alone = F.coalesce(*(tried(b["text"], i, p) for p in patterns))
            if anchors:
                alone = F.when(near([b["low"]], anchors), alone)
            if not next_too:
                return alone
            nxt = F.get(blocks, i + 1)
            both = once(F.concat_ws(" ", b["text"], nxt["text"]), lambda t: F.coalesce(*(tried(t, F.least(i + 1, F.size(blocks) - 1), p) for p in patterns)))
            if anchors:
                both = F.when(near([b["low"], F.coalesce(nxt["low"], F.lit(""))], anchors), both)
            return F.coalesce(alone, both)

        return F.transform(blocks, one)

    return Rule(name, found, method, convert)


def narrated(name: str, p: str, method: str, convert=None, most: int = 320, anchors: tuple[str, ...] = ()) -> Rule:
    """A pattern's group, carried on over the following blocks until a full stop, a numbered clause or so many signs. anchors as in joined."""

    def found(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            first = lambda start: F.struct(start.alias("out"), (F.trim(b["text"]).endswith(".") | (F.length(start) >= most)).alias("done"))

            def step(acc: Column, x: Column) -> Column:
                text = F.trim(x["text"])
                stop = acc["done"] | text.rlike(r"^(?:\d{1,2}[.)]|Điều\s+\d)")
                out = F.when(stop, acc["out"]).otherwise(F.concat_ws(" ", acc["out"], text))
                return once(F.struct(stop.alias("stop"), out.alias("out")), lambda y: F.struct(y["out"].alias("out"), (y["stop"] | text.endswith(".") | (F.length(y["out"]) >= most)).alias("done")))

            whole = lambda start: F.aggregate(F.slice(blocks, i + 2, 8), first(start), step)["out"]
            carried = once(F.trim(F.regexp_extract(b["text"], FLAGS + p, 1)), lambda start: F.when(start != "", hit(edge(whole(start), " .;:-"), i)))
            return F.when(near([b["low"]], anchors), carried) if anchors else carried

        return F.transform(blocks, one)

    return Rule(name, found, method, convert)


@dataclass(frozen=True)
class Within:
    """A rule that reads the blocks from a start marker up to an end marker only, all of them where no start is."""

    rule: Rule
    start: tuple[str, ...]
    end: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.rule.name

    @property
    def method(self) -> str:
        return self.rule.method

    def rules(self) -> list[Rule]:
        """The rule and those instead of it, each over the blocks between the markers."""
        # Markers that stand nowhere have no place.
        places = lambda keys, ws: F.transform(keys, lambda k, i: F.when(leads(k, [folded(w) for w in ws]), i))

        def inside(found: Callable[[Column], Column]) -> Callable[[Column], Column]:
            def sliced(blocks: Column, keys: Column) -> Column:
                def of(a: Column) -> Column:
                    b = F.array_min(F.filter(places(keys, self.end), lambda i: i > a)) if self.end else F.lit(None).cast("int")
                    part = F.when(a.isNull(), blocks).otherwise(F.slice(blocks, a + 1, F.coalesce(b, F.size(blocks)) - a))
                    return F.struct(part.alias("blocks"), F.coalesce(a, F.lit(0)).alias("first"))

                return once(F.array_min(places(keys, self.start)), of)

            def all_of(blocks: Column) -> Column:
                part = once(F.transform(blocks, lambda b: b["bare_lead"]), lambda keys: sliced(blocks, keys))
                return once(part, lambda p: F.transform(F.filter(found(p["blocks"]), lambda h: h.isNotNull()), lambda h: hit(h["value"], h["at"] + p["first"])))

            return all_of

        return [replace(r, found=inside(r.found), instead=()) for r in (self.rule, *self.rule.instead)]


def spoken_date(text: Column) -> Column:
    """dd/mm/yyyy of a date in figures or written out, else the text."""
    p, q = r"(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    of = lambda r: F.concat_ws("/", F.lpad(F.regexp_extract(text, I + r, 1), 2, "0"), F.lpad(F.regexp_extract(text, I + r, 2), 2, "0"), F.regexp_extract(text, I + r, 3))
    return F.when(text.rlike(I + p), of(p)).when(text.rlike(q), of(q)).otherwise(F.trim(text))


def identifier(text: Column) -> Column:
    tight = F.regexp_replace(text, r"\s+", "")
    return F.when(tight.rlike("^[0-9]{9,12}$"), tight)


def person(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), r"(?iu)^(?:Ông/bà|Ông|Bà)\s+", "")
    return filled_text(edge(F.regexp_replace(bare, r"(?iu)\s+(?:Chức vụ|Chức danh|Giới tính|Ngày sinh|CMND/CCCD số|CCCD số)\s*(?::|[-–—])?\s*.*$", ""), " .;:-"))


def monthly(text: Column) -> Column:
    amount = F.btrim(F.regexp_replace(text, r"\s+", ""), F.lit(".,"))
    return F.when(amount.rlike(r"^\d[\d.]*$"), F.concat(amount, F.lit(" đồng/tháng")))


#: Labels of contracts and CVs (fixed values).
CONTRACT_STOPS = (
    "Số hợp đồng", "Số", "Ngày ký", "Hiệu lực từ", "Bắt đầu từ", "Effective Date", "Kết thúc thử việc", "Hết hạn thử việc", "Probation End", "Đại diện cho", "Công ty", "Employer", "Đại diện", "Người lao động", "Ông/bà", "Họ và tên",
    "Employee Name", "CCCD số", "CMND số", "Employee ID", "Công việc/Chức danh", "Chức vụ/Vị trí", "Chức danh", "Vị trí công việc", "Job Title", "Địa điểm làm việc", "Mức lương thử việc", "Lương thử việc", "Salary", "Phụ cấp",
    "Phụ cấp và hỗ trợ", "Thanh toán", "Trả lương", "Hình thức trả lương", "Số giờ/tuần", "Giờ/tuần",
)
_DATE = r"((?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}))"
PARTY_A, PARTY_B = (("Bên A",), ("Bên B",)), (("Bên B",), ("Hai bên thỏa thuận", "Điều 1"))
_stop = lambda name, labels, convert=None: stopped(name, labels, CONTRACT_STOPS, convert)


def hours_a_week(text: Column, key: Column | None = None) -> Column:
    """`40 giờ/tuần` of a block that says so or names two spans of the working day; null else."""
    from quirefold.functions.dates import weekly_hours

    shown = lambda x: F.replace(F.regexp_replace(x.cast("string"), r"\.0+$", ""), F.lit("."), F.lit(","))
    daily = lambda told: once(told / 5, lambda d: F.when(d != F.floor(d), F.concat(F.lit(" — "), shown(d), F.lit(" giờ/ngày × 5 ngày"))).otherwise(""))
    week = once(weekly_hours(text), lambda told: F.concat(shown(told), F.lit(" giờ/tuần"), daily(told)))

    def of(key: Column) -> Column:
        said = F.when(key.contains("tuan"), filled_text(F.regexp_extract(key, r"\b(\d{1,3}) (?:gio tuan|gioltuan)\b", 1)))
        return F.coalesce(once(said, lambda x: F.when(x.isNotNull(), F.concat(x.cast("int").cast("string"), F.lit(" giờ/tuần")))), F.when(key.contains("thoi gio lam viec"), week))

    return once(key_of(text), of) if key is None else F.when(key.contains("tuan") | key.contains("thoi gio lam viec"), of(key))


def each_block(name: str, read: Callable[[Column, Column], Column], method: str) -> Rule:
    """The first block of whose text and key read gives a value."""
    return Rule(name, lambda blocks: F.transform(blocks, lambda b, i: once(read(b["text"], b["key"]), lambda v: F.when(v.isNotNull(), hit(v, i)))), method)


CONTRACT: list = [
    _stop("contract_number", ("Số hợp đồng", "Số", "Contract number")),
    with_instead(joined("contract_sign_date", (rf"ngày\s+{_DATE}",), spoken_date, next_too=False, anchors=("ngày",)), _stop("contract_sign_date", ("Ngày ký",), spoken_date)),
    with_instead(joined("effective_date", (rf"(?:kể\s+)?từ ngày\s+{_DATE}",), spoken_date, anchors=("ngày",)), _stop("effective_date", ("Hiệu lực từ", "Bắt đầu từ", "Effective Date"), spoken_date)),
    with_instead(joined("probation_end_date", (rf"đến(?:\s+hết)?\s+ngày\s+{_DATE}",), spoken_date, anchors=("ngày",)), _stop("probation_end_date", ("Kết thúc thử việc", "Hết hạn thử việc", "Probation End"), spoken_date)),
    with_instead(joined("employer_name", (r"Tên\s+công\s+ty\s*:\s*(.+)",), next_too=False, anchors=("công",)), _stop("employer_name", ("Đại diện cho", "Employer")), _stop("employer_name", ("Công ty",))),
    Within(with_instead(joined("employer_representative", (r"Đại\s+diện\s+(?:bởi|cho)\s*:\s*(?:Ông|Bà)\s+(.+?)(?=\s+Chức\s+(?:vụ|danh)\s*(?::|[-–—])|$)",), person, next_too=False, anchors=("đạ",)), _stop("employer_representative", ("Đại diện bởi", "Đại diện cho", "Đại diện"), person)), *PARTY_A),
    Within(with_instead(joined("employee_name", (r"Họ\s+và\s+tên\s*:\s*(.+?)(?=\s+Giới\s+tính\s*:|\s+Ngày\s+sinh\s*:|$)",), person, next_too=False, anchors=("và",)), _stop("employee_name", ("Người lao động", "Ông/bà", "Họ và tên", "Employee Name"), person)), *PARTY_B),
    with_instead(_stop("employee_id_number", ("CCCD số", "CMND số", "Employee ID"), identifier), joined("employee_id_number", (r"(?:CCCD\s+s(?:ố|ỗ|õ|o)|CMND\s+số)\s*[:\-]?\s*((?:[0-9][ \t]*){9,12})(?![ \t]*[0-9])",), identifier, next_too=False, anchors=("cccd", "cmnd"))),
    with_instead(narrated("professional_title", r"Chức\s+danh\s+công\s+việc\s*:\s*(.+?)(?:\.\s*$|$)", "professional_title_narrative", anchors=("công",)), _stop("professional_title", ("Công việc/Chức danh", "Chức danh chuyên môn", "Chức danh", "Vị trí công việc", "Job Title"))),
    Within(_stop("role_title", ("Chức vụ/Vị trí", "Chức vụ", "Vị trí", "Job Title"), lambda x: F.nullif(edge(F.regexp_extract(x, r"^([^;]*)", 1), " .;:-"), F.lit(""))), ("Bên B",), ()),
    with_instead(narrated("workplace", r"(?:Nơi|Địa\s+điểm)\s+làm\s+việc\s*:\s*(.+?)(?:\.\s*$|$)", "workplace_narrative", anchors=("làm",)), _stop("workplace", ("Địa điểm làm việc",))),
    each_block("weekly_hours", hours_a_week, "weekly_hours"),
    with_instead(joined("probation_salary_monthly", (r"Mức\s+lương\s+thử\s+việc\s*:\s*((?:[0-9][0-9.\s]*[0-9]))\s*đồng\s*/?\s*tháng",), monthly, next_too=False, anchors=("lương",)), _stop("probation_salary_monthly", ("Mức lương thử việc", "Lương thử việc", "Salary"))),
    with_instead(narrated("allowances_summary", r"Phụ\s+c[ấãẩậa]p(?:\s+và\s+hỗ\s+\S+)?\s*:\s*(.+?)(?:\.\s*$|$)", "allowances_narrative", anchors=("phụ",)), _stop("allowances_summary", ("Phụ cấp và hỗ trợ", "Phụ cấp"))),
    _stop("salary_payment_schedule", ("Hình thức trả lương", "Trả lương", "Thanh toán")),
]


def top_pair(which: int) -> Callable[[Column], Column]:
    """Name (1) or headline (2) in the first blocks of a CV: a name of one block and the next, or both glued in one."""

    def found(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            def name(x: Column) -> Column:
                return within(words_of(x), 2, 6) & (letters_of(x) >= 6) & once(key_of(x), lambda key: ~is_heading(key) & ~among(key, NO_NAME)) & ~x.rlike(r"[@\d]")

            def of(text: Column) -> Column:
                nxt = F.get(blocks, i + 1)
                whole = hit(text, i) if which == 1 else F.when(nxt.isNotNull() & ~is_heading(key_of(F.trim(nxt["text"]))), hit(F.trim(nxt["text"]), i + 1))
                rest = lambda g: hit(F.trim(g), i) if which == 1 else hit(F.trim(F.substr(text, F.length(g) + 1)), i)
                parted = once(filled_text(F.regexp_extract(text, r"^(.*?[a-zà-ỹ])(?=[A-ZĐ])", 1)), lambda g: F.when(g.isNotNull() & once(F.trim(g), name), rest(g)))
                return F.coalesce(parted, F.when(name(text), whole))

            return once(F.trim(b["text"]), of)

        return first_of(blocks, 12, one)

    return found


def skill_line(text: Column) -> Column:
    """A line of skills without its list mark and its short label."""

    def of(bare: Column) -> Column:
        label = F.regexp_extract(bare, r"^([^:]*):", 1)
        return F.when(once(label, lambda x: (x != "") & within(words_of(x), 1, 5)), edge(F.regexp_extract(bare, r"(?s)^[^:]*:(.*)$", 1), " ;")).otherwise(bare)

    return once(F.trim(F.regexp_replace(text, r"^[\s•·▪–—-]+", "")), of)


OBJECTIVE = (r"\b(?:vị trí|trở thành|theo hướng)\s+(.+?)(?=\s+(?:cho|trong|với|có)\b|[.;]|$)", r"^\s*[•-]?\s*([^,.;]+?)(?=\s+với\b)")
CV: list = [
    with_instead(stopped("full_name", ("Họ và tên", "Họ tên", "Full name")), Rule("full_name", top_pair(1), "cv_header")),
    with_instead(stopped("headline", ("Vị trí ứng tuyển", "Chức danh", "Vị trí", "Headline"), ("Địa chỉ", "Học vấn", "Kinh nghiệm", "Kỹ năng")), Rule("headline", top_pair(2), "cv_header")),
    pattern("email", (r"\b([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})\b",), method="email_pattern", anchors=("@",)),
    pattern("phone_number", (r"((?:\+?84|0)(?:[\s.-]?\d){8,10})",), method="phone_pattern", anchors=("0", "84")),
    stopped("address", ("Địa chỉ", "Address"), ("Mục tiêu nghề nghiệp", "Kinh nghiệm", "Kỹ năng", "Học vấn")),
    Within(joined("desired_role", OBJECTIVE, method="cv_objective_role", next_too=False), ("Mục tiêu nghề nghiệp", "Objective"), ("Học vấn", "Kinh nghiệm", "Kinh nghiệm làm việc", "Kỹ năng", "Chứng chỉ", "Dự án")),
    joined("years_experience", (r"((?:hơn|trên|ít nhất)\s+\d+\s+năm)", r"(\d+\s+năm\s+kinh\s+nghiệm)", r"(\d+\s+năm)"), method="cv_years_pattern", next_too=False, anchors=("năm",)),
    section("experience", ("Kinh nghiệm làm việc", "Kinh nghiệm")),
    Rule("skills", section("skills", ("Kỹ năng",)).found, "cv_skills_section", lambda x: F.array_join(F.filter(F.transform(F.split(x, "\n"), skill_line), lambda s: s != ""), "\n")),
    section("education", ("Học vấn",)),
]


def repaired_skills(skills: Column, experience: Column, least: int = 6) -> Column:
    """Words of the skills that the experience spells otherwise by one letter, in that spelling if only one word of it is so near."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))

    def of(x: Column) -> Column:
        anchors, known = x["anchors"], F.transform(x["anchors"], casefold)

        def one(text: Column, w: Column) -> Column:
            near = F.filter(anchors, lambda a: (F.length(a) >= least) & (F.levenshtein(casefold(a), casefold(w)) <= 1))
            use = once(near, lambda ns: F.when(~F.array_contains(known, casefold(w)) & (F.size(ns) == 1), ns[0]))
            return once(use, lambda u: F.when(u.isNull(), text).otherwise(F.regexp_replace(text, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}_])")), F.coalesce(u, F.lit("")))))

        return F.aggregate(words(skills), skills, one)

    return F.when(skills.isNotNull(), once(F.struct(words(F.coalesce(experience, F.lit(""))).alias("anchors")), of))


#: What an identity card's lines say (fixed values).
CARD_NOISE = ["viet nam", "cong hoa", "socialist", "republic", "independence", "freedom", "happiness", "identity card", "citzen", "can cuoc", "cn cuc"]
SHORT_NOISE = ["a", "e", "i", "o", "u", "x", "s", "d", "l", "wa", "hon", "ith", "un"]
CARD_LABELS = {
    "sex": ("gioi tinh", "sex"),
    "nationality": ("quoc tich", "nationality"),
    "placeOfOrigin": ("que quan", "place of origin"),
    "placeOfResidence": ("noi thuong tru", "place of residence", "pce rsidence", "rsidence"),
}


def noise(text: Column) -> Column:
    """A line of hardly any letters."""
    return once(fold_ocr(text), folded_noise)


def folded_noise(f: Column) -> Column:
    """noise of a line that is folded already."""
    return (F.length(f) <= 2) | f.isin(*SHORT_NOISE) | f.rlike(r"^[\d\W_]+$") | (letters_of(f) < F.greatest(F.lit(2), F.floor(F.length(f) / 3)))


def card_name(text: Column) -> Column:
    """Two to six words that look like a person's name on a card."""
    return once(fold_ocr(text), lambda f: card_named(text, f, folded_noise(f)))


def card_named(text: Column, f: Column, noisy: Column) -> Column:
    """card_name of a line with its folded text and whether it is noise."""
    return (F.length(text) >= 4) & ~noisy & ~among(f, CARD_NOISE) & within(words_of(text), 2, 6) & ~text.rlike(r"\p{Nd}") & (letters_of(text, r"[\p{L}\s]") / F.length(text) >= 0.7)


def identity_card(text: Column) -> Column:
    """map<string,string> of the front of an identity card: number, name, birth date, sex, nationality, places."""

    def of(lines: Column) -> Column:
        first = lambda xs: F.get(F.filter(xs, lambda v: v.isNotNull()), F.lit(0))
        joined_text = F.array_join(F.transform(lines, lambda x: x["raw"]), "\n")
        day = r"(?<![0-9])([0-3]?\d[/.-][01]?\d[/.-](?:19|20)\d{2})(?![0-9])"
        born = first(F.transform(lines, lambda x: F.when(x["fold"].rlike("sinh|birth|bith"), filled_text(F.regexp_extract(x["raw"], day, 1)))))

        def behind(labels: tuple[str, ...]) -> Column:
            has = lambda f: F.exists(F.array(*map(F.lit, labels)), lambda w: f.contains(w))

            def one(x: Column, i: Column) -> Column:
                right = edge(F.regexp_replace(F.regexp_extract(x["raw"], r"^[^:/]*[:/](.*)$", 1), r"(?i)\s*(?:date of|place of|full name|ful name|nationality).*$", ""), " :\t.-")

                def usable(r: Column) -> Column:
                    # The two letters of a sex are no noise.
                    return once(fold_ocr(r), lambda f: F.when((r != "") & (~folded_noise(f) | f.isin("nu", "nam")) & ~has(f), r))

                later = F.filter(F.slice(lines, i + 2, 8), lambda y: ~y["noise"] & ~has(y["fold"]))
                return F.when(has(x["fold"]), F.coalesce(once(right, usable), F.get(later, F.lit(0))["raw"]))

            return first(F.transform(lines, one))

        def named(x: Column, i: Column) -> Column:
            later = F.filter(F.slice(lines, i + 2, 9), lambda y: card_named(y["raw"], y["fold"], y["noise"]))
            return F.when(x["fold"].rlike("ho va ten|full name|ful name"), F.get(later, F.lit(0))["raw"])

        name = F.coalesce(first(F.transform(lines, named)), first(F.transform(lines, lambda x: F.when((x["raw"] == F.upper(x["raw"])) & card_named(x["raw"], x["fold"], x["noise"]), x["raw"]))))
        known_sex = lambda s: once(fold_ocr(s), lambda f: F.when(f.contains("nam"), "Nam").when(f.contains("nu"), "Nữ").otherwise(s))
        text_has = lambda p: filled_text(F.regexp_extract(joined_text, p, 1))
        found = {
            "idNumber": text_has(r"(?<![0-9])([0-9]{12})(?![0-9])"),
            "fullName": name,
            "dateOfBirth": F.coalesce(born, text_has(day)),
            "sex": once(behind(CARD_LABELS["sex"]), known_sex),
            "nationality": behind(CARD_LABELS["nationality"]),
            "placeOfOrigin": once(behind(CARD_LABELS["placeOfOrigin"]), lambda v: once(fold_ocr(v), lambda f: F.when(~f.contains("place of") & ~folded_noise(f), v))),
            "placeOfResidence": once(behind(CARD_LABELS["placeOfResidence"]), lambda v: F.when(~fold_ocr(v).rlike("expir|het han|tiden|date of|place of"), v)),
        }
        return F.map_filter(F.create_map(*(x for n, v in found.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())

    raw = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: edge(x, " :\t.-")), lambda x: x != "")
    return once(F.transform(raw, lambda x: once(fold_ocr(x), lambda f: F.struct(x.alias("raw"), f.alias("fold"), folded_noise(f).alias("noise")))), of)


#: A form number, its digits' places, and letters that a reader may take for digits there (fixed values).
FORM_NUMBER = "^[0-9]{2}[A-Z]{2}[0-9]{6}[A-Z]{3,4}[0-9]{3}[A-Z]$"
DIGIT_PLACES = [0, 1, 4, 5, 6, 7, 8, 9, 14, 15, 16]
LIKE_DIGITS, DIGITS = "OILSZ", "01152"


def repaired_form_number(token: Column, candidate: Column) -> Column:
    """A form number with misread digits put right, if it then holds the candidate's number at its place; null else."""
    letters = F.split(F.upper(token), "")
    fixed = F.array_join(F.transform(letters, lambda c, i: F.when(i.isin(*DIGIT_PLACES), F.translate(c, LIKE_DIGITS, DIGITS)).otherwise(c)), "")
    return once(fixed, lambda f: F.when((F.length(token) == 18) & (F.substring(f, 5, 6) == candidate) & f.rlike(FORM_NUMBER), f))


def score_report(blocks: Column) -> Column:
    """struct<recipient, candidate, form_number, type, overall, date> of a language test's report.

    The form number of highest priority wins (labelled, near a label, elsewhere, in the candidate's own row), then the lowest on
    the page. blocks: struct<text, y>.
    """

    def of(bs: Column) -> Column:
        first = lambda xs: F.get(F.filter(xs, lambda v: v.isNotNull()), F.lit(0))
        text = lambda i: F.trim(F.get(bs, i)["text"])

        def after(p: str, good: Callable[[Column], Column]) -> Column:
            def one(b: Column, i: Column) -> Column:
                own = F.trim(F.regexp_extract(b["text"], rf"(?i){p}\s*[:#]*\s*(.*)$", 1))
                return F.when(b["text"].rlike(rf"(?i){p}"), F.coalesce(F.when((own != "") & good(own), own), *(F.when(good(text(i + k)), text(i + k)) for k in (1, 2))))

            return first(F.transform(bs, one))

        name = lambda x: words_of(x).between(1, 5) & (letters_of(x, "[A-Za-zÀ-ỹ]") >= 2) & ~x.rlike(r"(?i)\d|candidate|family|first|date|number")
        candidate = after(r"\bcandidate\s+(?:number|no|num)\b", lambda x: x.rlike("^[0-9]{6}$"))
        band = after(r"(?:overall\s+band\s+(?:score|band)?|overall\s+(?:score|band)?|band\s+score)", lambda x: x.rlike(r"^(?:10|[0-9])(?:[.,][05])?$"))
        kind = first(F.transform(bs, lambda b: F.nullif(F.upper(F.regexp_extract(b["text"], r"(?i)\b(academic|general\s+training|life\s+skills)\b", 1)), F.lit(""))))
        date = after(r"\b(?:test\s+date|date\s+of\s+test|issue\s+date|date)\b", lambda x: x.rlike(r"(?i)^\d{1,2}[/-](?:\d{1,2}|[a-z]{3})[/-]\d{4}$"))

        def with_number(c: Column) -> Column:
            label = r"(?i)(?:trf|form|certificate)\s*(?:number|no|#)"
            anchors = F.filter(F.transform(bs, lambda b, i: F.when(b["text"].rlike(r"(?i)(?:form|trf)\s*(?:number|no|#)?"), i)), lambda i: i.isNotNull())

            def tokens(b: Column, i: Column) -> Column:
                tight = F.upper(F.regexp_replace(b["text"], "[^0-9A-Za-z]", ""))
                runs = F.transform(F.when(F.length(tight) >= 18, F.sequence(F.lit(1), F.length(tight) - 17)).otherwise(F.filter(F.array(F.lit(0)), lambda _: F.lit(False))), lambda p: F.substr(tight, p, F.lit(18)))
                good = F.filter(F.transform(runs, lambda r: F.coalesce(repaired_form_number(r, c), F.when(r.rlike(FORM_NUMBER), r))), lambda r: r.isNotNull())
                near = F.exists(anchors, lambda a: F.abs(a - i) <= 2)
                mine = b["text"].rlike(r"(?i)candidate\s+(?:number|no|num)")
                priority = F.when(b["text"].rlike(label), 3).when(mine, 0).when(near, 2).otherwise(1)
                return F.transform(good, lambda r: F.struct((-priority).alias("p"), (-F.coalesce(b["y"], F.lit(0.0))).alias("y"), r.alias("r")))

            return F.get(F.array_sort(F.flatten(F.transform(bs, tokens))), F.lit(0))["r"]

        recipient = F.nullif(F.concat_ws(" ", after(r"\bfamily\s+name\b", lambda x: name(x) & (words_of(x) <= 3)), after(r"\bfirst\s+names?(?:\(s\))?", name)), F.lit(""))
        return F.struct(recipient.alias("recipient"), candidate.alias("candidate"), once(candidate, with_number).alias("form_number"), kind.alias("type"), F.replace(band, F.lit(","), F.lit(".")).alias("overall"), date.alias("date"))

    return once(blocks, of)


__all__ = ["CONTRACT", "CV", "band_fields", "filled", "identity_card", "leave_request", "manual_only", "overtime_request", "region_evidence", "repaired_form_number", "repaired_skills", "review_only", "scanned_confidence", "score_report"]
