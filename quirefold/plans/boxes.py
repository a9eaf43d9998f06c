"""Queries over boxes. A line item is read as a box on the page of its order, placed by its figures."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.operators import geometry, layout, observe, tables
from quirefold.plans.registry import query, table

BOXES = "SELECT l_orderkey AS page, l_linenumber::BIGINT AS box, l_partkey % 100 AS x, l_suppkey % 50 AS y, (l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 50)::DOUBLE AS y0, (l_partkey % 100 + l_quantity)::DOUBLE AS x1, (l_suppkey % 50 + 10)::DOUBLE AS y1, l_returnflag AS text FROM lineitem"


def boxes(spark, sf_dir):
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("box"), x.alias("x"), y.alias("y"),
        x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + 10).alias("y1"), F.col("l_returnflag").alias("text"),
    )
    return rows.groupBy("page", "box").agg(F.min(F.struct("x", "y", "x0", "y0", "x1", "y1", "text")).alias("b")).select("page", "box", "b.*")


ONE = f"SELECT page, box, b.* FROM (SELECT page, box, min({{'x': x::DOUBLE, 'y': y::DOUBLE, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'text': text}}) AS b FROM ({BOXES}) GROUP BY ALL)"


def pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    side = lambda n: b.select("page", F.col("box").alias(f"box_{n}"), F.struct("x0", "y0", "x1", "y1").alias(n))
    return side("a").join(side("b"), "page").where("box_a < box_b")


@query(
    f"""WITH b AS ({ONE}), p AS (SELECT a.page, a.box AS box_a, b.box AS box_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM b a JOIN b ON a.page = b.page AND a.box < b.box)
SELECT page, box_a, box_b, round_even(coalesce(w * h / nullif(sa + sb - w * h, 0), 0), 6) AS iou, round_even(coalesce(w * h / nullif(least(sa, sb), 0), 0), 6) AS containment, round_even(h / 10, 6) AS vertical FROM p"""
)
def box_iou(spark, sf_dir):
    six = lambda c, n: F.bround(c, 6).alias(n)
    return pairs(spark, sf_dir).select("page", "box_a", "box_b", six(geometry.iou("a", "b"), "iou"), six(geometry.containment("a", "b"), "containment"), six(geometry.vertical_overlap("a", "b"), "vertical"))


CENTRES = [5.0, 30.0, 55.0, 80.0]


@query(f"WITH b AS ({ONE}), c AS (SELECT page, box, unnest(range(0, 4)) AS i, unnest({CENTRES}::DOUBLE[]) AS centre, x FROM b) SELECT page, box, (arg_min(i, abs(centre - x) * 10 + i / 1000.0))::INT AS column_no FROM c GROUP BY page, box")
def nearest_column(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "box", geometry.nearest_column(F.col("x"), F.array(*map(F.lit, CENTRES))).alias("column_no"))


@query(
    f"""WITH b AS ({ONE}), p AS (SELECT a.page, a.box AS label, v.box AS value, v.x0 - a.x1 + abs(v.y0 - a.y0) AS d FROM b a JOIN b v ON a.page = v.page AND v.x0 >= a.x1 AND abs(v.y0 - a.y0) <= 5)
SELECT page, label, value FROM (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY d, value) AS rn FROM p) WHERE rn = 1"""
)
def right_of(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", F.col("box").alias("id"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    return geometry.right_of(b, b, "page")


ORDERED = f"""WITH b AS ({ONE}), g AS (SELECT *, x - lag(x) OVER (PARTITION BY page ORDER BY x, box) AS gap, row_number() OVER (PARTITION BY page ORDER BY x, box) - 1 AS lft, count(*) OVER (PARTITION BY page) AS n, max(x) OVER (PARTITION BY page) - min(x) OVER (PARTITION BY page) AS span FROM b),
w AS (SELECT page, gap AS wide, lft AS wl, x AS wx FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(gap, -1) DESC, lft) AS rn FROM g) WHERE rn = 1),
c AS (SELECT g.page, box, g.x, y, CASE WHEN coalesce(wide, -1) >= 0.12 * span AND wl >= 2 AND n - wl >= 2 AND span > 0 AND g.x >= wx THEN 1 ELSE 0 END AS col FROM g JOIN w USING (page))"""


@query(f"{ORDERED} SELECT page, box, col AS column, row_number() OVER (PARTITION BY page ORDER BY col, y, x, box)::INT AS place FROM c")
def reading_order(spark, sf_dir):
    return observe.two_columns(boxes(spark, sf_dir), "page").select("page", "box", "column", "place")


@query(f"{ORDERED}, o AS (SELECT c.page, c.box, col, text || c.box AS label, text = 'R' AS head, row_number() OVER (PARTITION BY c.page ORDER BY col, c.y, c.x, c.box) AS place FROM c JOIN b USING (page, box)) SELECT page, box, last_value(CASE WHEN head THEN label END IGNORE NULLS) OVER (PARTITION BY page, col ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM o")
def column_sections(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("label", F.concat("text", F.col("box").cast("string")))
    found = observe.column_sections(rows.withColumn("mark", F.col("text") == "R").withColumn("text", F.col("label")), "page", F.col("mark"))
    return found.select("page", "box", "section")


@query(
    """WITH m AS (SELECT l_suppkey AS s, l_linenumber AS g, quantile_cont(l_quantity, 0.5) AS m FROM lineitem GROUP BY ALL)
SELECT a.s, count(*) AS pairs, count(*) FILTER (a.m < b.m) AS agreeing FROM m a JOIN m b ON a.s = b.s AND a.g < b.g AND abs(a.m - b.m) > 0.5 GROUP BY a.s"""
)
def order_agreement(spark, sf_dir):
    pts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("y"))
    return geometry.order_agreement(pts, ["s"], 0.5)


@query(
    """WITH p AS (SELECT l_orderkey AS page, l_linenumber - 1 AS g, quantile_cont((l_suppkey % 97) / 97.0::DOUBLE, 0.5) AS m FROM lineitem GROUP BY ALL), q AS (SELECT a.page, CASE WHEN a.m + 0.015 < b.m THEN 1 WHEN b.m + 0.015 < a.m THEN -1 ELSE 0 END AS s FROM p a JOIN p b ON a.page = b.page AND a.g < b.g),
r AS (SELECT page, sum(s) / nullif(sum(abs(s)), 0)::DOUBLE AS agreement FROM q GROUP BY page), t AS (SELECT page, count(*)::INT AS groups, sum(CASE WHEN g = 0 THEN CASE WHEN m <= 0.45 THEN 2.0 ELSE -2.0 END WHEN g IN (4, 5) THEN CASE WHEN m >= 0.45 THEN 0.75 ELSE -0.75 END WHEN g = 6 THEN CASE WHEN m >= 0.55 THEN 0.5 ELSE -0.5 END ELSE 0 END)::DOUBLE AS pts FROM p GROUP BY page)
SELECT page, round_even(coalesce(agreement, 0) * 4 + pts, 6) AS score, round_even(agreement, 6) AS agreement, groups FROM t LEFT JOIN r USING (page)"""
)
def layout_score(spark, sf_dir):
    pts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") - 1).alias("g"), ((F.col("l_suppkey") % 97) / F.lit(97.0)).alias("y"))
    return geometry.layout_score(pts, ["page"])


@query()
def row_cluster(spark, sf_dir):
    return geometry.row_clusters(boxes(spark, sf_dir), "page", 4.0)


@query()
def distinct_boxes(spark, sf_dir):
    return geometry.distinct_boxes(boxes(spark, sf_dir), "page")


@query("SELECT p_partkey, (26 * (ascii(substr(w, 1, 1)) - 64) + ascii(substr(w, 2, 1)) - 65)::INT AS column_no FROM (SELECT p_partkey, upper(substr(p_type, 1, 2)) AS w FROM part)")
def column_index(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geometry.column_index(F.substring("p_type", 1, 2)).alias("column_no"))


@query()
def overlap_rows(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("confidence", 0.5 + F.col("box") / 100)
    return geometry.overlap_rows(rows, "page").select("page", "row", "text", "confidence")


@query(
    f"""WITH b AS ({ONE}), p AS (SELECT page, box, x0, y0, x1, y1, greatest(2, round_even((y1 - y0) * 0.18, 0)::INT) AS px, greatest(2, round_even((y1 - y0) * 0.12, 0)::INT) AS py FROM b), c AS (SELECT page, box, greatest(0, trunc(x0)::INT - px) AS l, greatest(0, trunc(y0)::INT - py) AS t, least(90, trunc(x1)::INT + px) AS r, least(50, trunc(y1)::INT + py) AS d FROM p)
SELECT page, box, CASE WHEN r > l AND d > t THEN l END AS "left", CASE WHEN r > l AND d > t THEN t END AS top, CASE WHEN r > l AND d > t THEN r END AS "right", CASE WHEN r > l AND d > t THEN d END AS bottom FROM c"""
)
def crop_bounds(spark, sf_dir):
    c = F.col
    crop = geometry.crop_bounds(c("x0"), c("y0"), c("x1"), c("y1"), F.lit(90), F.lit(50))
    return boxes(spark, sf_dir).select("page", "box", crop.alias("c")).select("page", "box", "c.left", "c.top", "c.right", "c.bottom")


@query(f"SELECT page, box, round_even(x0 * 1.5, 6) AS x0, round_even(y0 * 0.5, 6) AS y0, round_even(x1 * 1.5, 6) AS x1, round_even(y1 * 0.5, 6) AS y1 FROM ({ONE})")
def box_rescale(spark, sf_dir):
    corners = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    rows = boxes(spark, sf_dir).select("page", "box", geometry.rescaled(corners, F.lit(1.5), F.lit(0.5)).alias("p"))
    six = lambda i, a, n: F.bround(F.col("p")[i][a], 6).alias(n)
    return rows.select("page", "box", six(0, "x", "x0"), six(0, "y", "y0"), six(1, "x", "x1"), six(1, "y", "y1"))


@query(f"SELECT page, box, ((y0 + y1) / 2 / 60.0::DOUBLE) BETWEEN 0.21 AND 0.30 AS in_band FROM ({ONE})")
def band_filter(spark, sf_dir):
    from quirefold.operators.templates import in_band

    return boxes(spark, sf_dir).select("page", "box", in_band(F.col("y0"), F.col("y1"), F.lit(60.0), 0.21, 0.30).alias("in_band"))


@query(
    f"""WITH b AS (SELECT *, box % 3 = 1 AS is_label, box % 2 = 0 AS multi, 0.5 + box / 100 AS conf FROM ({ONE})), a AS (SELECT * FROM b WHERE is_label), v AS (SELECT * FROM b WHERE NOT is_label),
s AS (SELECT a.page, a.box, min(o.y0) AS stop FROM a LEFT JOIN a o ON o.page = a.page AND o.y0 > a.y1 GROUP BY ALL),
j AS (SELECT a.page, a.box AS label, a.multi, v.box AS id, v.text, v.x0 AS bx, v.y0 AS vy, greatest(8.0, a.y1 - a.y0) AS h, a.x1 - a.x0 AS w, greatest(0, least(a.y1, v.y1) - greatest(a.y0, v.y0)) / nullif(least(a.y1 - a.y0, v.y1 - v.y0), 0) AS o, v.y0 - a.y1 AS down, greatest(a.x1 - a.x0, v.x1 - v.x0) AS reach, a.x0 AS ax0, a.x1 AS ax1, v.x1 AS bx1, least(1.0, v.conf) AS cf, stop
  FROM a JOIN s USING (page, box) JOIN v ON v.page = a.page),
k AS (SELECT *, bx >= ax0 + w * 0.3 AND coalesce(o, 0) >= 0.3 AS beside, down BETWEEN -h * 0.2 AND h * 5 AND bx1 >= ax0 - reach * 0.35 AND bx <= ax1 + reach * 0.75 AS below FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY NOT beside, CASE WHEN multi THEN CASE WHEN beside THEN bx ELSE vy END WHEN beside THEN greatest(0.0, bx - ax1) - cf * h ELSE greatest(0.0, down) + abs(bx - ax0) * 0.05 - cf * h END, bx, id) AS rn FROM k WHERE (beside OR below) AND (stop IS NULL OR vy < stop))
SELECT page, label, string_agg(text || id, ' ' ORDER BY rn) AS value FROM r WHERE rn <= CASE WHEN multi THEN 3 ELSE 1 END GROUP BY page, label"""
)
def label_lines(spark, sf_dir):
    b = F.col("box")
    lines = boxes(spark, sf_dir).select("page", b.alias("id"), F.concat("text", b.cast("string")).alias("text"), (0.5 + b / 100).alias("confidence"), "x0", "y0", "x1", "y1", F.when(b % 3 == 1, F.lit("f")).alias("field"), (b % 2 == 0).alias("multiline"))
    return tables.label_values(lines, "page").select("page", "label", "value")


@query()
def coordinate_tables(spark, sf_dir):
    """Line items as words of a page: the header of a staff list, and a row a line."""
    rows = boxes(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("box")))
    word = lambda x, y, text: F.struct(F.lit(float(x)).alias("x0"), y.cast("double").alias("y0"), F.lit(x + 40.0).alias("x1"), (y + 16).cast("double").alias("y1"), text.alias("text"), F.lit(0.97).alias("confidence"))
    y = F.col("n") * 30 + 30
    own = [word(10, y, F.col("n").cast("string")), word(110, y, F.concat(F.lit("NV00"), F.col("box").cast("string"))), word(210, y, F.col("text"))]
    head = [word(10, F.lit(0), F.lit("STT")), word(110, F.lit(0), F.lit("Mã NV")), word(210, F.lit(0), F.lit("Họ và tên"))]
    words = rows.select("page", F.lit("EMPLOYEE_MASTER_LIST").alias("kind"), F.explode(F.when(F.col("n") == 1, F.array(*head, *own)).otherwise(F.array(*own))).alias("w")).select("page", "kind", "w.*")
    return tables.coordinate_tables(words, "page")


@query(
    f"""WITH b AS (SELECT page, box, x0 * 4 AS x0, y0 * 3 AS y0, x0 * 4 + (x1 - x0) * 2 AS x1, y1 * 3 AS y1, text || box AS text, box % 3 = 1 AS heading FROM ({ONE})),
w AS (SELECT page, max(x1) AS width FROM b GROUP BY page),
h AS (SELECT b.*, width, x1 - x0 >= width * 0.6 AS spans, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM b JOIN w USING (page) WHERE heading),
p AS (SELECT h.page, h.box, h.x0, h.y0, h.y1, h.width, h.spans, h.cx, o.y0 AS oy, (o.x0 + o.x1) / 2 AS ox,
    h.spans OR least(h.x1, o.x1) - greatest(h.x0, o.x0) > 0 OR abs((o.x0 + o.x1) / 2 - h.cx) <= greatest(80, h.width * 0.18) AS col, abs((o.y0 + o.y1) / 2 - h.cy) <= greatest(36, greatest(1, h.y1 - h.y0) * 1.5) AS band
  FROM h LEFT JOIN h o ON o.page = h.page AND o.box <> h.box),
q AS (SELECT page, box, x0, y0, y1, width, spans, min(CASE WHEN oy > y0 AND col THEN oy END) AS nxt, count(*) FILTER (band) AS beside, max(CASE WHEN band AND ox < cx THEN (cx + ox) / 2 END) AS l, min(CASE WHEN band AND ox > cx THEN (cx + ox) / 2 END) AS r FROM p GROUP BY page, box, x0, y0, y1, width, spans, cx),
f AS (SELECT q.*, (SELECT max(b.x1) FROM b WHERE b.page = q.page AND b.y0 >= q.y1 - 4 AND (nxt IS NULL OR b.y0 < nxt)) AS far FROM q),
g AS (SELECT *, spans OR (beside = 0 AND x0 <= width * 0.15 AND coalesce(far, 0) >= width * 0.75) AS whole FROM f),
d AS (SELECT page, box AS heading, y1 - 4 AS below, nxt, CASE WHEN whole THEN 0 ELSE greatest(0, coalesce(l, 0)) END AS a, CASE WHEN whole THEN width ELSE least(coalesce(far, width), coalesce(r, 1e300)) END AS z FROM g),
i AS (SELECT d.page, d.heading, b.box, b.x0, b.text, (b.y0 + b.y1) / 2 AS cy, b.y1 - b.y0 AS high FROM d JOIN b ON b.page = d.page AND NOT b.heading AND b.y0 >= below AND (nxt IS NULL OR b.y0 < nxt) AND b.x1 > a AND b.x0 < z),
t AS (SELECT *, greatest(18, list_sort(list(high) OVER (PARTITION BY page, heading))[1 + count(*) OVER (PARTITION BY page, heading) // 2] * 0.65) AS tol, cy - lag(cy) OVER (PARTITION BY page, heading ORDER BY cy, x0, box) AS gap FROM i),
u AS (SELECT *, sum(CASE WHEN gap > tol THEN 1 ELSE 0 END) OVER (PARTITION BY page, heading ORDER BY cy, x0, box ROWS UNBOUNDED PRECEDING) AS line FROM t)
SELECT page, heading, (max(line) + 1)::INT AS lines, string_agg(text, chr(10) ORDER BY line, x0, cy, box) AS text FROM u GROUP BY page, heading"""
)
def placed_sections(spark, sf_dir):
    c = F.col
    rows = boxes(spark, sf_dir).select("page", "box", (c("x0") * 4).alias("x0"), (c("y0") * 3).alias("y0"), (c("x0") * 4 + (c("x1") - c("x0")) * 2).alias("x1"), (c("y1") * 3).alias("y1"), F.concat("text", c("box").cast("string")).alias("text"), (c("box") % 3 == 1).alias("heading"))
    return layout.sections(rows, "page")


def labelled_lines(spark, sf_dir):
    """Boxes as lines: every third one a label, of any kind or for a date or a number, the others values of which some are dates or numbers."""
    b = F.col("box")
    day = F.concat(F.lpad(b.cast("string"), 2, "0"), F.lit("/05/2024"))
    text = F.when((b + F.col("page")) % 4 == 0, day).when((b + F.col("page")) % 4 == 1, F.concat(F.lit("0123456789"), (b + 10).cast("string"))).otherwise(F.concat("text", b.cast("string")))
    kind = F.when(b % 3 == 1, F.element_at(F.array(F.lit("any"), F.lit("date"), F.lit("number")), ((b + F.col("page")) % 3).cast("int") + 1))
    return boxes(spark, sf_dir).select("page", b.alias("id"), text.alias("text"), (0.5 + b / 100).alias("confidence"), "x0", "y0", "x1", "y1", F.when(b % 3 == 1, F.lit("f")).alias("field"), kind.alias("kind"))


@query()
def assigned_values(spark, sf_dir):
    return tables.assigned_values(labelled_lines(spark, sf_dir), "page")


HEADER_WORDS = ["STT", "Mã NV", "Ho va tcn", "Bộ phận", "Chuc dauh", "Ngày vào làm", "Ghi chú", "Họ và tên"]


def found_tables(spark, sf_dir):
    """Native and coordinate tables of orders: six columns of eight headers, some misread or repeated, in an order of their own, and a row a line item."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("row")).agg(F.min("l_returnflag").alias("flag"))
    header = F.element_at(F.array(*map(F.lit, HEADER_WORDS)), ((F.col("doc") + F.col("column") * 3) % 8).cast("int") + 1)
    cells = li.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    cells = cells.select("doc", F.lit(0).cast("long").alias("table"), F.lit("EMPLOYEE_MASTER_LIST").alias("kind"), "row", "column", header.alias("header"), F.concat("flag", F.col("column").cast("string")).alias("value"))
    native = cells.where("doc % 3 <> 0").withColumns({"source": F.when(F.col("doc") % 2 == 0, "docx_table").otherwise("pdf_table"), "status": F.when(F.col("doc") % 5 == 0, F.when(F.col("row") % 2 == 0, "accepted").otherwise("needs_review"))})
    coordinate = cells.where("doc % 2 = 0").withColumns({"source": F.lit("coordinates"), "status": F.when((F.col("row") + F.col("column")) % 4 == 0, "not_found").otherwise("accepted")})
    return native, coordinate


@query()
def normalized_tables(spark, sf_dir):
    return tables.normalized_tables(*found_tables(spark, sf_dir), "doc", tables.HEADERS)
