"""From documents to observations: the flat rows of text that every later operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import composed


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, text): one row a line, numbered from 0 without gaps. Array functions keep the order, so nothing is shuffled."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("seq", "text"))


def document_text(observations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a document's lines, composed and trimmed, joined again in order; blank ones are left out."""
    lines_ = observations.select(key, "seq", F.trim(composed(F.col("text"))).alias("text")).where("text <> ''")
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return lines_.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def key_values(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, seq, text) rows `name: value` of the named columns; a null value gives an empty one and is kept."""
    cells = F.array(*(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names))
    return df.select(key, F.posexplode(cells).alias("seq", "text"))


def delimited_rows(observations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, cells, is_header) of the tables in text: at least two lines of a document with at least two bars or tabs and three filled cells."""
    bars = lambda sep: F.length("text") - F.length(F.replace(F.col("text"), F.lit(sep), F.lit("")))
    sep = F.when(bars("|") >= 2, F.lit("[|]")).when(bars("\t") >= 2, F.lit("\t"))
    cells = F.filter(F.transform(F.split("text", sep), lambda x: F.trim(x)), lambda x: x != "")
    rows = observations.where(sep.isNotNull()).select(key, "seq", cells.alias("cells")).where(F.size("cells") >= 3)
    by = Window.partitionBy(key)
    rows = rows.withColumns({"n": F.count("*").over(by), "least": F.min("seq").over(by)}).where("n >= 2")
    return rows.select(key, "seq", "cells", (F.col("seq") == F.col("least")).alias("is_header"))


def native_lines(blocks: DataFrame, key: str, order: str, split: Column) -> DataFrame:
    """(key, seq, page, text) of blocks (key, order, page, text): blocks to be split give a row a line, others one; pages default to 0 and blank rows go."""
    parts = F.when(split, F.split("text", "\n")).otherwise(F.array("text"))
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select(key, order, F.coalesce("page", F.lit(0)).alias("page"), F.posexplode(kept).alias("_i", "text"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order, "_i")) - 1).select(key, "seq", "page", "text")


def content_rows(pages: DataFrame, loose: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, seq, text) of a document's contents in order: blocks of its pages, then loose blocks, then sheets, each by name before its cells.

    pages (key, page, block, kind, text, label), loose (key, block, kind, text, label), cells (key, sheet_no, sheet, row, column,
    text). A key-value block reads `label: text` and stays even if blank; other blank rows go.
    """
    shown = F.when(F.col("kind") == "key_value", F.concat_ws(": ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit("")))).otherwise(F.trim("text"))
    kept = (F.col("kind") == "key_value") | (F.coalesce(F.trim("text"), F.lit("")) != "")
    at = lambda part, *xs: F.struct(F.lit(part).alias("p"), *(x.cast("long").alias(f"x{i}") for i, x in enumerate(xs)))
    zero = F.lit(0)
    a = pages.where(kept).select(key, at(0, F.col("page"), F.col("block"), zero).alias("at"), shown.alias("text"))
    b = loose.where(kept).select(key, at(1, F.col("block"), zero, zero).alias("at"), shown.alias("text"))
    names = cells.select(key, "sheet_no", "sheet").distinct().select(key, at(2, F.col("sheet_no"), F.lit(-1), zero).alias("at"), F.col("sheet").alias("text"))
    c = cells.where("trim(text) <> ''").select(key, at(2, F.col("sheet_no"), F.col("row"), F.col("column")).alias("at"), F.trim("text").alias("text"))
    rows = a.unionByName(b).unionByName(names).unionByName(c)
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("seq"), "text")


def islands(rows: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, island, first, last, size) of the runs of consecutive flagged rows."""
    by = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_f", flag.cast("int"))
    marked = marked.withColumn("_new", ((F.col("_f") == 1) & (F.coalesce(F.lag("_f").over(by), F.lit(0)) == 0)).cast("int"))
    marked = marked.withColumn("island", F.sum("_new").over(by)).where("_f = 1")
    return marked.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))


def sections(rows: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """Adds section: the number of headings up to the row; 0 before the first."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("section", F.sum(heading.cast("int")).over(by))


def following(rows: DataFrame, key: str, order: str, column: str, k: int = 1) -> DataFrame:
    """Adds next_1 to next_k: the column in the rows that follow."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumns({f"next_{i}": F.lead(column, i).over(by) for i in range(1, k + 1)})


def last_rows(rows: DataFrame, order: str, most: int, key: str | None = None) -> DataFrame:
    """A ring: the newest rows by order, so many for each key or in all."""
    if key is None:
        return rows.orderBy(F.desc(order)).limit(most)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def two_columns(boxes: DataFrame, key: str, width: float = 0.12) -> DataFrame:
    """Reading order of boxes (key, box, x, y): by y then x; if the largest gap in x is at least `width` of the page with two boxes on
    either side, the left column first. Adds column and place."""
    by_x = Window.partitionBy(key).orderBy("x", "box")
    page = Window.partitionBy(key)
    rows = boxes.withColumns({"_gap": F.col("x") - F.lag("x").over(by_x), "_left": F.row_number().over(by_x) - 1, "_n": F.count("*").over(page)})
    rows = rows.withColumn("_wide", F.max(F.struct(F.coalesce("_gap", F.lit(-1.0)).alias("gap"), (-F.col("_left")).alias("left"), F.col("x").alias("x"))).over(page))
    span = F.max("x").over(page) - F.min("x").over(page)
    split = (F.col("_wide.gap") >= width * span) & (-F.col("_wide.left") >= 2) & (F.col("_n") + F.col("_wide.left") >= 2) & (span > 0)
    rows = rows.withColumn("column", F.when(split & (F.col("x") >= F.col("_wide.x")), 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy(key).orderBy("column", "y", "x", "box"))
    return rows.withColumn("place", place).drop("_gap", "_left", "_n", "_wide")


def column_sections(boxes: DataFrame, key: str, heading: Column, width: float = 0.12) -> DataFrame:
    """Adds column, place and section to boxes (key, box, x, y, text): the text of the last heading above a box in its own column; null before the first.

    A heading is no part of its section, so it carries the one before it.
    """
    rows = two_columns(boxes.withColumn("_head", heading), key, width)
    above = Window.partitionBy(key, "column").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("section", F.last(F.when(F.col("_head"), F.col("text")), ignorenulls=True).over(above)).drop("_head")
