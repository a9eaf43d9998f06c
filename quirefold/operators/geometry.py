"""Boxes: overlap, nearest column, clusters of rows, columns of tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import casefold, once


def area(b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{b}.x1") - F.col(f"{b}.x0")) * F.greatest(F.lit(0.0), F.col(f"{b}.y1") - F.col(f"{b}.y0"))


def intersection(a: str, b: str) -> Column:
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{q}"), F.col(f"{b}.{q}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")))
    return side("x0", "x1") * side("y0", "y1")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs (x0, y0, x1, y1); 0 for empty boxes."""
    both = intersection(a, b)
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def containment(a: str, b: str) -> Column:
    """Share of the smaller box that lies in the other."""
    return F.coalesce(intersection(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def vertical_overlap(a: str, b: str) -> Column:
    """Overlap in y over the lower height."""
    h = lambda x: F.col(f"{x}.y1") - F.col(f"{x}.y0")
    both = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0")))
    return F.coalesce(both / F.nullif(F.least(h(a), h(b)), F.lit(0.0)), F.lit(0.0))


def nearest_column(x: Column, centres: Column) -> Column:
    """Place of the centre nearest to x in an array of centres; ties to the left one."""
    best = F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))
    return best["i"]


def right_of(labels: DataFrame, values: DataFrame, page: str, band: float = 0.5) -> DataFrame:
    """(page, label, value): the value box nearest by |dx| + |dy| that begins right of the label within `band` of its height."""
    l, v = labels.select(page, F.col("id").alias("label"), F.col("box").alias("a")), values.select(page, F.col("id").alias("value"), F.col("box").alias("b"))  # noqa: E741
    mid = lambda x: (F.col(f"{x}.y0") + F.col(f"{x}.y1")) / 2
    j = l.join(v, page).where((F.col("b.x0") >= F.col("a.x1")) & (F.abs(mid("a") - mid("b")) <= band * (F.col("a.y1") - F.col("a.y0"))))
    d = F.col("b.x0") - F.col("a.x1") + F.abs(mid("a") - mid("b"))
    return j.groupBy(page, "label").agg(F.min(F.struct(d.alias("d"), "value"))["value"].alias("value"))


def row_clusters(boxes: DataFrame, page: str, tolerance: float) -> DataFrame:
    """(page, box, row): boxes by y, each joined to the running mean centre of the last row if within the tolerance.

    The mean moves with each member, so rows follow one another: pages come sorted, one after the other, and of each only its last row is held.
    """

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, centre, n = None, -1, 0.0, 0
        for batch in batches:
            rows = []
            for p, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if row < 0 or p != at:
                    at, row, centre, n = p, 0, y, 1
                elif abs(y - centre) > tolerance:
                    row, centre, n = row + 1, y, 1
                else:
                    n += 1
                    centre += (y - centre) / n
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.int32())], [page, "box", "row"])

    # Boxes without a place come last on their page.
    rows = boxes.select(page, "box", F.coalesce(F.col("y").cast("double"), F.lit(float("nan"))).alias("y"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.repartition(page).sortWithinPartitions(page, "y", F.col("box").asc_nulls_last()).mapInArrow(cluster, f"{page} {kind(page)}, box {kind('box')}, row int")


#: What makes a box a fragment of a larger one (fixed values): the share that lies in it, and the most of its text's length.
CONTAINED, FRAGMENT, SHORT = 0.75, 0.65, 4


def largest_first(boxes: DataFrame, page: str, least: float, *more: str) -> DataFrame:
    """(page, boxes): a page's boxes left, largest first, each struct<size, box, x0, y0, x1, y1, text, own, more...>.

    A box goes if a larger one that stays is its copy (the same folded text, overlap of `least`) or holds it as a short fragment. First each box gets
    the places of the larger ones that would cover it, then one pass from the largest on keeps those that no kept one covers. A page
    is a bounded group.
    """
    c = F.col
    own = F.trim(F.regexp_replace(casefold(F.coalesce("text", F.lit(""))), r"\s+", " "))
    item = F.struct((-(c("x1") - c("x0")) * (c("y1") - c("y0"))).alias("size"), "box", "x0", "y0", "x1", "y1", "text", own.alias("own"), *more)
    side = lambda a, b, p, q: F.greatest(F.lit(0.0), F.least(a[q], b[q]) - F.greatest(a[p], b[p]))

    def covers(k: Column, r: Column) -> Column:
        def of(both: Column) -> Column:
            union, inner = -k["size"] - r["size"] - both, F.least(-k["size"], -r["size"])
            copy = (k["own"] == r["own"]) & (union > 0) & (both / F.nullif(union, F.lit(0.0)) >= least)
            part = (inner > 0) & (both / F.nullif(inner, F.lit(0.0)) >= CONTAINED) & (F.length(r["own"]) <= F.greatest(F.lit(float(SHORT)), F.length(k["own"]) * FRAGMENT))
            return F.coalesce(copy, F.lit(False)) | F.coalesce(part, F.lit(False))

        return once(side(k, r, "x0", "x1") * side(k, r, "y0", "y1"), of)

    def kept(bs: Column) -> Column:
        places = lambda r, i: F.filter(F.transform(F.slice(bs, F.lit(1), i), lambda k, j: F.when(covers(k, r), j)), lambda j: j.isNotNull())
        covered = F.transform(bs, lambda r, i: F.struct(i.alias("i"), places(r, i).alias("by")))
        stay = F.aggregate(covered, F.array().cast("array<int>"), lambda acc, x: F.when(F.arrays_overlap(x["by"], acc), acc).otherwise(F.concat(acc, F.array(x["i"]))))
        return F.transform(stay, lambda i: F.get(bs, i))

    return boxes.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("boxes")).select(page, once(F.col("boxes"), kept).alias("boxes"))


def distinct_boxes(boxes: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """(page, box) of the boxes left after copies of larger ones (same text, overlap of `least`) and short fragments that lie in them are dropped, largest first."""
    return largest_first(boxes, page, least).select(page, F.explode(F.transform("boxes", lambda b: b["box"])).alias("box"))


def overlap_rows(boxes: DataFrame, page: str, least: float = 0.45) -> DataFrame:
    """(page, row, text, confidence, x0, y0, x1, y1): text rows of a page's distinct boxes.

    A box joins the row, of those that it overlaps in height by `least` of the lower one, whose middle is nearest; rows come by
    their upper edge, the boxes of a row from left to right, and a row's confidence is their mean. A page is a bounded group.
    """
    row = lambda top, low, bs: F.struct(top.alias("top"), low.alias("low"), bs.alias("boxes"))

    def step(rows: Column, b: Column) -> Column:
        def near(r: Column, i: Column) -> Column:
            height = F.least(r["low"] - r["top"], b["y1"] - b["y0"])
            share = (F.least(r["low"], b["y1"]) - F.greatest(r["top"], b["y0"])) / F.nullif(height, F.lit(0.0))
            return F.when((height > 0) & (share >= least), F.struct(F.abs((b["y0"] + b["y1"]) / 2 - (r["top"] + r["low"]) / 2).alias("d"), i.alias("i")))

        def joined(n: Column) -> Column:
            r = F.get(rows, n["i"])
            grown = row(F.least(r["top"], b["y0"]), F.greatest(r["low"], b["y1"]), F.concat(r["boxes"], F.array(b)))
            return F.when(n.isNull(), F.concat(rows, F.array(row(b["y0"], b["y1"], F.array(b))))).otherwise(F.concat(F.slice(rows, F.lit(1), n["i"]), F.array(grown), F.slice(rows, n["i"] + 2, F.size(rows))))

        return once(F.array_min(F.transform(rows, near)), joined)

    kept = largest_first(boxes, page, 0.5, "confidence")
    down = F.transform(F.array_sort(F.transform("boxes", lambda b: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), b["box"].alias("n"), b.alias("b")))), lambda x: x["b"])
    none = F.slice(F.array(row(F.lit(0.0), F.lit(0.0), F.col("boxes"))), 1, 0)
    found = kept.select(page, F.aggregate(down, none, step).alias("rows"))
    ordered = F.array_sort(F.transform("rows", lambda r, i: F.struct(r["top"].alias("top"), i.alias("i"), r.alias("r"))))
    each = found.select(page, F.posexplode_outer(F.transform(ordered, lambda x: x["r"])).alias("row", "r")).where("r IS NOT NULL")
    right = F.array_sort(F.transform("r.boxes", lambda b: F.struct(b["x0"].alias("x"), b["box"].alias("n"), b.alias("b"))))
    texts = F.filter(F.transform(right, lambda x: x["b"]["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    sure = F.aggregate("r.boxes", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size("r.boxes")
    edge = lambda of, side: of(F.transform("r.boxes", lambda b: b[side])).alias(side)
    return each.select(page, "row", F.array_join(texts, " ").alias("text"), F.round(sure, 4).alias("confidence"), edge(F.array_min, "x0"), F.col("r.top").alias("y0"), edge(F.array_max, "x1"), F.col("r.low").alias("y1"))


def crop_bounds(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad_x: float = 0.18, pad_y: float = 0.12) -> Column:
    """struct<left, top, right, bottom> of a box with a share of its height, 2 at least, around it, within the image; null if nothing is left."""
    line = F.greatest(F.lit(1.0), y1 - y0)
    pad = lambda r: F.greatest(F.lit(2), F.bround(line * r, 0).cast("int"))
    left, right = F.greatest(F.lit(0), x0.cast("int") - pad(pad_x)), F.least(width, x1.cast("int") + pad(pad_x))
    top, bottom = F.greatest(F.lit(0), y0.cast("int") - pad(pad_y)), F.least(height, y1.cast("int") + pad(pad_y))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def rescaled(boxes: Column, sx: Column, sy: Column) -> Column:
    """An array of points with both coordinates scaled."""
    return F.transform(boxes, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def column_index(letters: Column) -> Column:
    """Number of a spreadsheet column, from 0: A, B, ..., Z, AA, ..."""
    each = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(each, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1


#: Where groups of lines belong on an upright card (fixed values): (group, edge, points), above the edge for the first, below it for the others.
LAYOUT = [(4, 0.45, 0.75), (5, 0.45, 0.75), (6, 0.55, 0.5)]
TOP, TOP_EDGE, TOP_POINTS, PAIR_POINTS = 0, 0.45, 2.0, 4.0


def layout_score(points: DataFrame, by: list[str], tolerance: float = 0.015) -> DataFrame:
    """(by, score, agreement, groups) of lines (by, g, y), y as a share of the page's height: how upright a card lies.

    Agreement is right less inverted pairs of groups over both, null without any pair apart by more than the tolerance; groups
    where they belong add to the score, and take from it where they do not.
    """
    med = points.groupBy(*by, "g").agg(F.percentile("y", 0.5).alias("m"))
    all_ = med.groupBy(*by).agg(F.collect_list(F.struct("g", "m")).alias("ms"))  # one entry a group of a fixed list

    def of(ms: Column) -> Column:
        pairs = F.flatten(F.transform(ms, lambda a: F.transform(F.filter(ms, lambda b: b["g"] > a["g"]), lambda b: F.when(a["m"] + tolerance < b["m"], 1).when(b["m"] + tolerance < a["m"], -1).otherwise(0))))
        right, wrong = F.size(F.filter(pairs, lambda p: p == 1)), F.size(F.filter(pairs, lambda p: p == -1))
        agreement = (right - wrong) / F.nullif(right + wrong, F.lit(0))
        at = lambda g: F.get(F.filter(ms, lambda x: x["g"] == g), F.lit(0))["m"]
        score = F.coalesce(agreement, F.lit(0.0)) * PAIR_POINTS + F.coalesce(F.when(at(TOP) <= TOP_EDGE, TOP_POINTS).when(at(TOP).isNotNull(), -TOP_POINTS), F.lit(0.0))
        for g, edge, worth in LAYOUT:
            score += F.coalesce(F.when(at(g) >= edge, worth).when(at(g).isNotNull(), -worth), F.lit(0.0))
        return F.struct(F.bround(score, 6).alias("score"), F.bround(agreement, 6).alias("agreement"), F.size(ms).alias("groups"))

    return all_.select(*by, once(F.col("ms"), of).alias("s")).select(*by, "s.*")


def order_agreement(points: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(by, pairs, agreeing, agreement): whether groups' medians stand in the order of their numbers. points (by, g, y); pairs within the tolerance do not count."""
    med = points.groupBy(*by, "g").agg(F.percentile("y", 0.5).alias("m"))
    a, b = med, med.select(*by, F.col("g").alias("g2"), F.col("m").alias("m2"))
    j = a.join(b, by).where((F.col("g") < F.col("g2")) & (F.abs(F.col("m") - F.col("m2")) > tolerance))
    return j.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col("m") < F.col("m2")).alias("agreeing"))
