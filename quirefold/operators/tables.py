"""Tables: put together from the places of recognized words, brought to wanted columns, and values beside or below labels.

A page's words are one array, and its rows, header, columns and cells are folds and choices over that array: one aggregate a page, then
expressions. A page is bounded by what it is; nothing here groups by more than a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import label_likeness, once
from quirefold.operators.forms import key_of

#: Header words of the tables, and what ends them (fixed values).
HEADERS = {
    "ONBOARDING_CHECKLIST": ["stt", "hang muc", "phu trach", "han hoan thanh", "trang thai", "ghi chu"],
    "EMPLOYEE_MASTER_LIST": ["stt", "ma nv", "ho va ten", "bo phan", "chuc danh", "ngay vao", "loai hd", "trang thai"],
    "TRAINING_ATTENDANCE": ["stt", "ma nv", "ho va ten", "bo phan", "co mat", "diem", "ket qua", "ky nhan"],
}
STOPS = ["tong cong", "nguoi lap", "nguoi phe duyet", "xac nhan", "ghi chu cuoi"]
#: A row number and a staff code at a row's start (fixed values).
NUMBER, CODE = r"^\d{1,3}$", r"(?iu)^(?=.*\d)[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ0-9]{2,}(?:[-/][A-ZÀ-ỸĐ0-9]+)*$"
#: Tolerances: of rows (pixels, share of the middle height), of columns (pixels, share of the middle width), of the gap to a row's second line (fixed values).
ROW_REACH, COLUMN_REACH, LINE_REACH = (7.0, 0.48), (18.0, 0.18), 0.45
SURE = 0.94
NO_CELL = "CAST(NULL AS double)"


def middle_of(values: Column) -> Column:
    """The (upper) median of an array; null if it is empty."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def appended(xs: Column, x: Column) -> Column:
    return F.concat(xs, F.array(x))


def at(xs: Column, i: Column, changed: Column) -> Column:
    """xs with another element at place i."""
    return F.concat(F.slice(xs, F.lit(1), i), F.array(changed), F.slice(xs, i + 2, F.size(xs)))


def rows_by_height(words: Column) -> Column:
    """array<struct<y, words>> from top to bottom, words from left to right, of words by upper edge: each joins the row of the nearest mean height within reach, which moves that mean."""
    centre = lambda w: (w["y0"] + w["y1"]) / 2
    row = lambda y, ws: F.struct(y.alias("y"), ws.alias("words"))

    def with_reach(reach: Column) -> Column:
        def step(rows: Column, w: Column) -> Column:
            near = F.array_min(F.transform(rows, lambda r, i: F.struct(F.abs(centre(w) - r["y"]).alias("d"), i.alias("i"))))

            def placed(n: Column) -> Column:
                r = F.get(rows, n["i"])
                moved = row(r["y"] + (centre(w) - r["y"]) / (F.size(r["words"]) + 1), appended(r["words"], w))
                return F.when(n["d"] <= reach, at(rows, n["i"], moved)).otherwise(appended(rows, row(centre(w), F.array(w))))

            return once(near, placed)

        none = F.slice(F.array(row(F.lit(0.0), words)), 1, 0)
        from_left = lambda ws: F.transform(F.array_sort(F.transform(ws, lambda w, i: F.struct(w["x0"].alias("x"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
        found = F.aggregate(words, none, step)
        return F.transform(F.array_sort(F.transform(found, lambda r, i: F.struct(r["y"].alias("y"), i.alias("i"), from_left(r["words"]).alias("words")))), lambda r: row(r["y"], r["words"]))

    return once(F.greatest(F.lit(ROW_REACH[0]), middle_of(F.transform(words, lambda w: w["y1"] - w["y0"])) * ROW_REACH[1]), with_reach)


def header_hits(words: Column, markers: Column) -> Column:
    """How many of the markers a word of the header is, begins with or begins."""
    fits = lambda k, m: (k == m) | F.startswith(k, F.concat(m, F.lit(" "))) | ((k != "") & F.startswith(m, F.concat(k, F.lit(" "))))
    return F.size(F.filter(markers, lambda m: F.exists(words, lambda w: fits(w["key"], m))))


def header_of(rows: Column, markers: Column) -> Column:
    """struct<start, size, words> of the one or two rows that look most like the header: 100 a marker, less 10 a row, one a word up to nine."""
    words = lambda i, n: F.flatten(F.transform(F.slice(rows, i + 1, n), lambda r: r["words"]))

    def spot(i: Column, n: int) -> Column:
        points = lambda ws: header_hits(ws, markers) * 100 - 10 * n + F.least(F.size(ws), F.lit(9))
        return F.struct(once(words(i, F.lit(n)), points).alias("points"), (-i).alias("up"), F.lit(-n).alias("short"))

    places = F.transform(rows, lambda _, i: i)
    best = F.array_max(F.concat(F.transform(places, lambda i: spot(i, 1)), F.transform(F.filter(places, lambda i: i < F.size(rows) - 1), lambda i: spot(i, 2))))
    return once(best, lambda b: F.struct((-b["up"]).alias("start"), (-b["short"]).alias("size"), words(-b["up"], -b["short"]).alias("words")))


def columns_of(header: Column) -> Column:
    """array<struct<x, name>>: header words whose middles lie within reach of the mean of the column before them belong to it."""
    spots = F.array_sort(F.transform(header, lambda w: F.struct(((w["x0"] + w["x1"]) / 2).alias("x"), F.coalesce(w["text"], F.lit("")).alias("text"))))
    column = lambda xs, names: F.struct(xs.alias("xs"), names.alias("names"))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)

    def with_reach(reach: Column) -> Column:
        def step(cols: Column, w: Column) -> Column:
            last = F.get(cols, F.size(cols) - 1)
            joined = column(appended(last["xs"], w["x"]), appended(last["names"], w["text"]))
            return F.when(F.abs(w["x"] - mean(last["xs"])) <= reach, at(cols, F.size(cols) - 1, joined)).otherwise(appended(cols, column(F.array(w["x"]), F.array(w["text"]))))

        none = F.slice(F.array(column(F.array(F.lit(0.0)), F.array(F.lit("")))), 1, 0)
        return F.transform(F.aggregate(spots, none, step), lambda c: F.struct(mean(c["xs"]).alias("x"), F.array_join(F.array_distinct(c["names"]), " / ").alias("name")))

    return once(F.greatest(F.lit(COLUMN_REACH[0]), middle_of(F.transform(header, lambda w: w["x1"] - w["x0"])) * COLUMN_REACH[1]), with_reach)


def cells_of(words: Column, cols: Column) -> Column:
    """array<struct<text, confidence>>, one a column: each word stands in the column of the nearest middle, and a cell's first known confidence counts."""
    placed = F.transform(words, lambda w: F.struct(w.alias("w"), F.array_min(F.transform(cols, lambda c, j: F.struct(F.abs(c["x"] - (w["x0"] + w["x1"]) / 2).alias("d"), j.alias("j"))))["j"].alias("j")))

    def cell(ws: Column) -> Column:
        texts = F.filter(F.transform(ws, lambda p: F.trim(p["w"]["text"])), lambda t: t.isNotNull() & (t != ""))
        return F.struct(F.array_join(texts, " ").alias("text"), F.get(F.filter(F.transform(ws, lambda p: p["w"]["confidence"]), lambda c: c.isNotNull()), F.lit(0)).alias("confidence"))

    return once(placed, lambda ps: F.transform(cols, lambda _, j: cell(F.filter(ps, lambda p: p["j"] == j))))


def both_lines(first: Column, second: Column) -> Column:
    """The cells of two lines of one row; the first line's confidence counts where it has text."""
    said = lambda x, y: F.array_join(F.filter(F.array(x["text"], y["text"]), lambda t: t != ""), " ")
    return F.zip_with(first, second, lambda x, y: F.struct(said(x, y).alias("text"), F.when(x["text"] != "", x["confidence"]).otherwise(y["confidence"]).alias("confidence")))


def logical_rows(rows: Column, cols: Column) -> Column:
    """array<struct<y, cells>>: a row begins with a number or a staff code; a line close below one, or before one, belongs to it; what names an end ends the table."""
    lines = F.transform(rows, lambda r: F.struct(r["y"].alias("y"), cells_of(r["words"], cols).alias("cells"), F.exists(F.array(*map(F.lit, STOPS)), lambda s: F.array_join(F.transform(r["words"], lambda w: w["key"]), " ").contains(s)).alias("ends")))
    gaps = F.filter(F.transform(rows, lambda r, i: F.get(rows, i + 1)["y"] - r["y"]), lambda g: g > 0)

    def read(ls: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(F.transform(ls, lambda x, i: F.when(x["ends"], i)), lambda i: i.isNotNull())), F.size(ls))
        filled = lambda x: F.filter(F.transform(x["cells"], lambda c: c["text"]), lambda t: t != "")
        kept = F.filter(F.slice(ls, F.lit(1), end), lambda x: F.size(filled(x)) >= 2)
        cells = F.slice(F.array(F.array(F.struct(F.lit("").alias("text"), F.expr(NO_CELL).alias("confidence")))), 1, 0)
        none = F.struct(F.slice(F.array(F.struct(F.lit(0.0).alias("y"), F.get(cells, F.lit(0)).alias("cells"))), 1, 0).alias("rows"), F.get(cells, F.lit(0)).alias("waits"))
        near = F.coalesce(middle_of(gaps), F.lit(30.0)) * LINE_REACH

        def step(acc: Column, x: Column) -> Column:
            done, last = acc["rows"], F.get(acc["rows"], F.size(acc["rows"]) - 1)
            row = lambda y, cs: F.struct(y.alias("y"), cs.alias("cells"))
            state = lambda rs, waits: F.struct(rs.alias("rows"), waits.alias("waits"))
            begins = once(filled(x), lambda ts: F.get(ts, F.lit(0)).rlike(NUMBER) | F.exists(ts, lambda t: t.rlike(CODE)))
            whole = F.when(acc["waits"].isNull(), x["cells"]).otherwise(both_lines(x["cells"], acc["waits"]))
            below = F.coalesce(x["y"] - last["y"] <= near, F.lit(False))
            return (
                F.when(begins, state(appended(done, row(x["y"], whole)), F.get(cells, F.lit(0))))
                .when(below, state(at(done, F.size(done) - 1, row(last["y"], both_lines(last["cells"], x["cells"]))), acc["waits"]))
                .otherwise(state(done, x["cells"]))
            )

        return F.aggregate(kept, none, step)["rows"]

    return once(lines, read)


def table_of(words: Column, markers: Column) -> Column:
    """struct<columns, rows> of a page's words: none without a header of three markers and three columns."""

    def below(rows: Column, head: Column) -> Column:
        def of(cols: Column) -> Column:
            good = (header_hits(head["words"], markers) >= 3) & (F.size(cols) >= 3)
            body = F.slice(rows, head["start"] + head["size"] + 1, F.size(rows))
            return F.when(good, F.struct(cols.alias("columns"), logical_rows(body, cols).alias("rows")))

        return once(columns_of(head["words"]), of)

    return once(rows_by_height(words), lambda rows: once(header_of(rows, markers), lambda head: below(rows, head)))


def coordinate_tables(words: DataFrame, page: str, kind: str = "kind", headers: dict[str, list[str]] | None = None) -> DataFrame:
    """(page, row, column, name, value, status, row_status) of words (page, kind, x0, y0, x1, y1, text, confidence).

    Pages of an unknown kind, without words or without a header have no rows; null texts are blank; equal words all count.
    """
    markers = F.lit(None)
    for name, ms in (headers or HEADERS).items():
        markers = F.when(F.col("_kind") == name, F.array(*map(F.lit, ms))).otherwise(markers)
    word = F.struct(*(F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")), F.coalesce("text", F.lit("")).alias("text"), F.col("confidence").cast("double").alias("confidence"), key_of(F.coalesce("text", F.lit(""))).alias("key"))
    pages = words.groupBy(page).agg(F.min(kind).alias("_kind"), F.array_sort(F.collect_list(word)).alias("_words"))
    found = pages.withColumn("_markers", markers).where("_markers IS NOT NULL").select(page, table_of(F.col("_words"), F.col("_markers")).alias("t"))
    rows = found.select(page, F.col("t.columns").alias("cols"), F.posexplode_outer("t.rows").alias("row", "r")).where("r IS NOT NULL")
    status = lambda c: F.when(c["text"] == "", "not_found").when(F.coalesce(c["confidence"], F.lit(0.0)) >= SURE, "accepted").otherwise("needs_review")
    whole = F.when(F.exists("r.cells", lambda c: status(c) == "needs_review"), "needs_review").otherwise("accepted")
    cells = rows.select(page, "row", "cols", whole.alias("row_status"), F.posexplode("r.cells").alias("column", "c"))
    return cells.select(page, "row", "column", F.get("cols", F.col("column"))["name"].alias("name"), F.col("c.text").alias("value"), status(F.col("c")).alias("status"), "row_status")


def native_or_coordinate(native: DataFrame, coordinate: DataFrame, key_: str) -> DataFrame:
    """Native tables' cells; those put together from places only for documents without a native table."""
    return native.unionByName(coordinate.join(native.select(key_).distinct(), key_, "left_anti"), allowMissingColumns=True)


def label_pairs(lines: DataFrame, page: str, field: str = "field", multiline: str = "multiline") -> DataFrame:
    """(page, a_*, field, multiline, text, b_*, beside, cost): each label line with the value lines that stand beside or below it.

    lines (page, id, text, confidence, x0, y0, x1, y1, field, multiline): field names the field that a line labels, null for
    value lines. A value stands in the label's row (an overlap of 0.3 in height, right of 0.3 of its width) or up to five line heights
    below it, above the next label. Its cost is its distance less confidence times height. Lines pair within their page only.
    """
    cols = ["id", "confidence", "x0", "y0", "x1", "y1"]
    a = lines.where(F.col(field).isNotNull()).select(page, field, multiline, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = lines.where(F.col(field).isNull() & (F.trim("text") != "")).select(page, "text", *(F.col(c).alias(f"b_{c}") for c in cols))
    stops = a.select(F.col(page).alias("s_page"), F.col("a_y0").alias("s_y0"))
    nxt = a.join(stops, (F.col(page) == F.col("s_page")) & (F.col("s_y0") > F.col("a_y1")), "left").groupBy(page, "a_id").agg(F.min("s_y0").alias("stop"))
    c = F.col
    height, width = F.greatest(F.lit(8.0), c("a_y1") - c("a_y0")), c("a_x1") - c("a_x0")
    overlap = F.greatest(F.lit(0.0), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")) / F.nullif(F.least(c("a_y1") - c("a_y0"), c("b_y1") - c("b_y0")), F.lit(0.0))
    beside = (c("b_x0") >= c("a_x0") + width * 0.3) & (F.coalesce(overlap, F.lit(0.0)) >= 0.3)
    down, reach = c("b_y0") - c("a_y1"), F.greatest(width, c("b_x1") - c("b_x0"))
    below = down.between(-height * 0.2, height * 5.0) & (c("b_x1") >= c("a_x0") - reach * 0.35) & (c("b_x0") <= c("a_x1") + reach * 0.75)
    sure = F.least(F.lit(1.0), F.coalesce(c("b_confidence"), F.lit(0.0))) * height
    cost = F.when(beside, F.greatest(F.lit(0.0), c("b_x0") - c("a_x1")) - sure).otherwise(F.greatest(F.lit(0.0), down) + F.abs(c("b_x0") - c("a_x0")) * 0.05 - sure)
    return a.join(nxt, [page, "a_id"]).join(b, page).where((beside | below) & (c("stop").isNull() | (c("b_y0") < c("stop")))).withColumns({"beside": beside, "cost": cost})


def label_values(lines: DataFrame, page: str, field: str = "field", multiline: str = "multiline", most: int = 3) -> DataFrame:
    """(page, label, field, value): for each label line the value line of least cost, those beside it before those below; a multiline field keeps the first three in reading order."""
    c = F.col
    pairs = label_pairs(lines, page, field, multiline)
    cell = F.struct(F.when(c("beside"), 0).otherwise(1).alias("where"), F.when(c(multiline), F.when(c("beside"), c("b_x0")).otherwise(c("b_y0"))).otherwise(c("cost")).alias("order"), c("b_x0").alias("x"), c("b_id").alias("id"), c("text").alias("text"))
    got = pairs.groupBy(page, c("a_id").alias("label"), field, multiline).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    texts = F.transform("cells", lambda x: x["text"])
    return got.select(page, "label", field, F.array_join(F.slice(texts, 1, F.when(c(multiline), most).otherwise(1)), " ").alias("value"))


def cheapest(costs: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """One-to-one (label, value) pairs: as many as can be, and of these at the least cost in all, by cheapest augmenting paths."""
    labels = sorted({a for a, _ in costs})
    of: dict[int, list[int]] = {a: [] for a in labels}
    for a, v in sorted(costs):
        of[a].append(v)
    holder: dict[int, int] = {}
    held: dict[int, int] = {}
    while True:
        # Least cost to reach each value from any free label: along a free pair, back along a held one.
        far: dict[int, tuple[float, int]] = {}
        due = {a: 0.0 for a in labels if a not in held}
        while due:
            later: dict[int, float] = {}
            for a, d in due.items():
                for v in of[a]:
                    if held.get(a) != v and d + costs[a, v] < far.get(v, (float("inf"), 0))[0] - 1e-12:
                        far[v] = d + costs[a, v], a
                        if v in holder:
                            b = holder[v]
                            later[b] = min(later.get(b, float("inf")), far[v][0] - costs[b, v])
            due = later
        ends = [(d, v) for v, (d, _) in far.items() if v not in holder]
        if not ends:
            return sorted(held.items())
        v = min(ends)[1]
        while True:
            a = far[v][1]
            before = held.get(a)
            holder[v], held[a] = a, v
            if before is None:
                break
            v = before


#: Stands for an id that is null, and the most answers that a task remembers (fixed values).
ABSENT, ANSWERS = -(1 << 63), 4096


def one_to_one(pairs: DataFrame, page: list[str], label: str, value: str, cost: str) -> DataFrame:
    """(page, label, value): the assignment of values to labels of least cost among those of a page that assign most. Of equally cheap ones any may come."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at, best, seen = len(page), None, {}, {}

        def solved() -> list[tuple]:
            """The rows of the page that is read. Pages of equal costs, as tables of equal headers are, have one answer."""
            known = tuple(sorted(best.items()))
            got = seen.get(known)
            if got is None:
                if len(seen) >= ANSWERS:
                    seen.clear()
                got = seen[known] = cheapest(best)
            return [(*at, a, v) for a, v in got]

        def shown(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            kinds = [*(schema.field(i).type for i in range(n)), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * (n + 2)
            cols[n:] = [[None if x == ABSENT else x for x in c] for c in cols[n:]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*page, "label", "value"])

        schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != at:
                    if best:
                        out += solved()
                    at, best = row[:n], {}
                a, v, c = row[n:]
                best[a, v] = min(c, best.get((a, v), float("inf")))
            yield shown(out, schema)
        if best:
            yield shown(solved(), schema)

    # Pages come sorted, one after the other, so one page is held at a time.
    whole = lambda x: F.coalesce(F.col(x).cast("long"), F.lit(ABSENT))
    rows = pairs.select(*page, whole(label).alias("_a"), whole(value).alias("_v"), F.coalesce(F.col(cost).cast("double"), F.lit(float("nan"))).alias("_c"))
    kinds = ", ".join(f"{p} {rows.schema[p].dataType.simpleString()}" for p in page)
    return rows.repartition(*page).sortWithinPartitions(*page).mapInArrow(of, f"{kinds}, label long, value long")


#: What a value of a kind holds (fixed values): a date, an identity number.
KINDS = {"date": r"\d{1,2}[./-]\d{1,2}[./-]\d{4}", "number": r"(?<![0-9])(?:[0-9][ .]?){11}[0-9](?![0-9])"}


def assigned_values(lines: DataFrame, page: str, field: str = "field", kind: str = "kind") -> DataFrame:
    """(page, label, value, text, rescued): each label's own value line, no line for two labels.

    First labels and the lines that stand beside or below them are assigned one to one at the least cost in all. Then labels of a kind (date,
    number) that are left without a line that holds such a value get, one to one by distance, one of the page's lines that
    holds one and that no label has. A label whose line is not of its kind keeps none if none is found.
    """
    c = F.col
    wants = lambda text: F.coalesce(*(F.when(c(kind) == k, text.rlike(p)) for k, p in KINDS.items()), F.lit(True))
    rows = lines.withColumn("_multi", F.lit(False))
    pairs = label_pairs(rows, page, field, "_multi")
    first = one_to_one(pairs, [page], "a_id", "b_id", "cost")
    labels = lines.where(c(field).isNotNull()).select(page, c("id").alias("label"), kind, *(c(x).alias(f"a_{x}") for x in ("x0", "y0")))
    values = lines.where(c(field).isNull()).select(page, c("id").alias("value"), "text", *(c(x).alias(f"b_{x}") for x in ("x0", "y0")))
    own = labels.join(first, [page, "label"]).join(values.select(page, "value", "text"), [page, "value"]).where(wants(c("text"))).select(page, "label", "value", "text", F.lit(False).alias("rescued"))
    left = labels.where(c(kind).isin(*KINDS)).join(own.select(page, "label"), [page, "label"], "left_anti")
    free = values.join(own.select(page, "value"), [page, "value"], "left_anti")
    near = left.join(free, page).where(wants(c("text"))).withColumn("cost", F.abs(c("a_x0") - c("b_x0")) + F.abs(c("a_y0") - c("b_y0")))
    late = one_to_one(near, [page], "label", "value", "cost").join(values.select(page, "value", "text"), [page, "value"]).select(page, "label", "value", "text", F.lit(True).alias("rescued"))
    return own.unionByName(late)


#: Kinds of sources whose cells need no review, and the least likeness of a header to a wanted column (fixed values).
NATIVE, LIKE = ["xlsx_cells", "docx_table"], 0.6


def header_matches(columns: DataFrame, wanted: dict[str, list[str]], keys: list[str], kind: str = "kind", least: float = LIKE) -> DataFrame:
    """(keys, column, name): which wanted column each found column is, one to one within a table, by likeness of their folded headers.

    columns (keys, kind, column, header); wanted names the columns of each kind of table. As many columns as can be are matched, and of these the likest in all;
    a pair of less likeness than `least` never is. Headers meet the few names of their own kind only.
    """
    names = [(k, i, n) for k, ns in wanted.items() for i, n in enumerate(ns)]
    rules = columns.sparkSession.createDataFrame(names, "w_kind string, place long, name string")
    headers = columns.select(*keys, kind, "column", key_of(F.coalesce("header", F.lit(""))).alias("header"))
    # Each header text is compared once, however many tables hold it.
    texts = headers.select(kind, "header").distinct().join(F.broadcast(rules), F.col(kind) == F.col("w_kind"))
    like = texts.withColumn("likeness", label_likeness(F.col("header"), F.col("name"))).where(F.col("likeness") >= least).drop("w_kind")
    pairs = headers.join(like, [kind, "header"]).withColumn("cost", -F.col("likeness"))
    chosen = one_to_one(pairs, keys, "column", "place", "cost").select(*keys, F.col("label").alias("column"), F.col("value").alias("place"))
    return chosen.join(pairs.select(*keys, "column", "place", "name").distinct(), [*keys, "column", "place"]).select(*keys, "column", "name")


def normalized_tables(native: DataFrame, coordinate: DataFrame, document: str, wanted: dict[str, list[str]], kind: str = "kind") -> DataFrame:
    """(document, table, source, row, name, value, status): cells of a document's tables under the wanted columns.

    native and coordinate (document, table, kind, source, row, column, header, value, status): tables put together from places count only for documents without
    a native one. Columns that are like no wanted one are left out, and each wanted one is filled once. A row is accepted if its
    source needs no review and, where its cells have a status, all of them are accepted.
    """
    c = F.col
    cells = native_or_coordinate(native, coordinate, document)
    keys = [document, "table"]
    found = header_matches(cells.select(*keys, kind, "column", "header").distinct(), wanted, keys, kind)
    doubt = F.count_if(c("status").isNotNull() & (c("status") != "accepted")) > 0
    checked = F.count("status") > 0
    rows = cells.groupBy(*keys, "row", "source").agg(F.when(checked, doubt).otherwise(~F.coalesce(F.first("source").isin(*NATIVE), F.lit(False))).alias("review"))
    rows = rows.select(*keys, "row", F.when(c("review"), "needs_review").otherwise("accepted").alias("row_status"))
    return cells.join(found, [*keys, "column"]).join(rows, [*keys, "row"]).select(*keys, "source", "row", "name", "value", c("row_status").alias("status"))
