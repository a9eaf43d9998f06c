"""Sections of a page by the places of its headings: each heading holds the lines of its own width down to the next heading there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of the page's width and pixels that bound a section (fixed values): a heading that spans the page, one that begins at its left edge, a section that reaches its right edge; headings of one column; headings of one band; lines of one row.
SPANS, AT_LEFT, AT_RIGHT = 0.6, 0.15, 0.75
SAME_COLUMN, SAME_BAND, SAME_LINE = (80.0, 0.18), (36.0, 1.5), (18.0, 0.65)
ABOVE = 4.0


def heading_bounds(boxes: DataFrame, page: str) -> DataFrame:
    """(page, heading, below, next_y, left, right): where the section of each heading lies. Headings pair with those of their page only."""
    c = F.col
    side = ["x0", "y0", "x1", "y1"]
    width = boxes.groupBy(c(page).alias("w_page")).agg(F.max("x1").alias("width"))
    h = boxes.where("heading").select(page, c("box").alias("heading"), *side).join(width, c(page) == c("w_page")).drop("w_page")
    h = h.withColumns({"spans": c("x1") - c("x0") >= c("width") * SPANS, "cx": (c("x0") + c("x1")) / 2, "cy": (c("y0") + c("y1")) / 2})
    o = boxes.where("heading").select(c(page).alias("o_page"), c("box").alias("other"), *(c(x).alias(f"o_{x}") for x in side))
    pairs = h.join(o, (c(page) == c("o_page")) & (c("heading") != c("other")), "left")
    o_cx = (c("o_x0") + c("o_x1")) / 2
    overlaps = F.least("x1", "o_x1") - F.greatest("x0", "o_x0") > 0
    column = c("spans") | overlaps | (F.abs(o_cx - c("cx")) <= F.greatest(F.lit(SAME_COLUMN[0]), c("width") * SAME_COLUMN[1]))
    band = F.abs((c("o_y0") + c("o_y1")) / 2 - c("cy")) <= F.greatest(F.lit(SAME_BAND[0]), F.greatest(F.lit(1.0), c("y1") - c("y0")) * SAME_BAND[1])
    edge = (c("cx") + o_cx) / 2
    h = pairs.groupBy(page, "heading", *side, "width", "spans", "cx").agg(
        F.min(F.when((c("o_y0") > c("y0")) & column, c("o_y0"))).alias("next_y"), F.count_if(band).alias("beside"),
        F.max(F.when(band & (o_cx < c("cx")), edge)).alias("left"), F.min(F.when(band & (o_cx > c("cx")), edge)).alias("right"),
    )
    lines = boxes.select(c(page).alias("l_page"), c("y0").alias("l_y0"), c("x1").alias("l_x1"))
    reach = h.join(lines, (c(page) == c("l_page")) & (c("l_y0") >= c("y1") - ABOVE) & (c("next_y").isNull() | (c("l_y0") < c("next_y"))), "left")
    reach = reach.groupBy(page, "heading", "x0", "y1", "width", "spans", "next_y", "beside", "left", "right").agg(F.max("l_x1").alias("far"))
    whole = c("spans") | ((c("beside") == 0) & (c("x0") <= c("width") * AT_LEFT) & (F.coalesce(c("far"), F.lit(0.0)) >= c("width") * AT_RIGHT))
    right = F.least(F.coalesce(c("far"), c("width")), F.coalesce(c("right"), F.lit(float("inf"))))
    return reach.select(page, "heading", (c("y1") - ABOVE).alias("below"), "next_y", F.when(whole, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce("left", F.lit(0.0)))).alias("left"), F.when(whole, c("width")).otherwise(right).alias("right"))


def sections(boxes: DataFrame, page: str) -> DataFrame:
    """(page, heading, lines, text) of the headings with any text below: boxes (page, box, x0, y0, x1, y1, text, heading boolean).

    A line belongs to every heading above it whose width it meets, down to the next heading of that column. Lines stand one below the other
    where their middles lie apart, else from left to right. Windows are by heading of a page; blank texts are left out.
    """
    c = F.col
    bounds = heading_bounds(boxes.where("trim(text) <> ''"), page)
    lines = boxes.where("trim(text) <> '' AND NOT heading").select(c(page).alias("l_page"), "box", "x0", "y0", "x1", "y1", F.trim("text").alias("line"))
    inside = (c("y0") >= c("below")) & (c("next_y").isNull() | (c("y0") < c("next_y"))) & (c("x1") > c("left")) & (c("x0") < c("right"))
    held = bounds.join(lines, (c(page) == c("l_page")) & inside).withColumn("cy", (c("y0") + c("y1")) / 2)
    each = Window.partitionBy(page, "heading")
    down = each.orderBy("cy", "x0", "box")
    heights = F.sort_array(F.collect_list(c("y1") - c("y0")).over(each))
    tolerance = F.greatest(F.lit(SAME_LINE[0]), F.get(heights, F.floor(F.size(heights) / 2).cast("int")) * SAME_LINE[1])
    held = held.withColumns({"tolerance": tolerance, "gap": c("cy") - F.lag("cy").over(down)})
    held = held.withColumn("row", F.sum(F.when(c("gap") > c("tolerance"), 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("row", "x0", "cy", "box", "line")
    return held.groupBy(page, "heading").agg((F.max("row") + 1).cast("int").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))
