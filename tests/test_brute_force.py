"""Queries that SQL does not express, against versions in one process."""

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from quirefold.functions import text as t
from quirefold.functions.text import word_distance
from quirefold.operators import classify, policy
from quirefold.plans import boxes, evaluation, extraction, registry

SF = "/root/testdata/sf0.001"


def rows(sql):
    c = duckdb.connect()
    for name in ("part", "documents", "lineitem", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c.execute(sql).fetchall()


def got(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def pages():
    out = {}
    for page, box, x, y, x0, y0, x1, y1, text in rows(boxes.ONE):
        out.setdefault(page, []).append((box, x, y, x0, y0, x1, y1, text))
    return out


def test_row_cluster(spark):
    want = set()
    for page, bs in pages().items():
        row, members = -1, []
        for box, _, y, *_ in sorted(bs, key=lambda b: (b[2], b[0])):
            if not members or abs(y - sum(members) / len(members)) > 4.0:
                row, members = row + 1, []
            members.append(y)
            want.add((page, box, row))
    assert {tuple(r) for r in got(spark, "row_cluster")} == want


def test_distinct_boxes(spark):
    want = set()
    for page, bs in pages().items():
        kept = []
        for b in sorted(bs, key=lambda b: (-(b[5] - b[3]) * (b[6] - b[4]), b[0])):
            def iou(k, b=b):
                w, h = max(0, min(k[5], b[5]) - max(k[3], b[3])), max(0, min(k[6], b[6]) - max(k[4], b[4]))
                both = (k[5] - k[3]) * (k[6] - k[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h
                return w * h / both if both else 0

            def inside(k, b=b):
                w, h = max(0, min(k[5], b[5]) - max(k[3], b[3])), max(0, min(k[6], b[6]) - max(k[4], b[4]))
                return w * h / min((k[5] - k[3]) * (k[6] - k[4]), (b[5] - b[3]) * (b[6] - b[4]))

            # All texts are one letter, so whatever lies in a larger box is a fragment of it.
            if not any(k[7] == b[7] and iou(k) >= 0.5 or inside(k) >= 0.75 for k in kept):
                kept.append(b)
        want |= {(page, k[0]) for k in kept}
    assert {tuple(r) for r in got(spark, "distinct_boxes")} == want


def test_wer_words(spark):
    pairs = {}
    for _, brand, truth, pred in rows(evaluation.PAIRS):
        pairs.setdefault(brand, []).append((truth.split(), (pred or "").split()))

    def edits(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    want = {b: round(sum(edits(*p) for p in ps) / sum(len(p[0]) for p in ps), 6) for b, ps in pairs.items()}
    assert {r.p_brand: r.wer for r in got(spark, "wer_words")} == want
    assert word_distance([(["a", "b"], ["b"]), (None, ["x"])]) == [1, 1]


def test_narratives(spark):
    import re

    want = {}
    for doc, text in rows("SELECT doc_id, text FROM documents"):
        lines = [x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")]
        out = ""
        for line in lines:
            if out and re.match(r"\s*[0-9]+[.)]", line):
                break
            out = f"{out} {line}" if out else line
            if out.endswith(".") or len(out) >= 320:
                break
        if lines:
            want[doc] = out
    assert {r.doc_id: r.narrative for r in got(spark, "narratives")} == want


def test_fuzzy_anti(spark):
    ps = rows("SELECT p_partkey // 50, p_name || ' ' || p_type, p_size FROM part")
    known = {(b, x) for b, x, s in ps if s <= 25}
    want = Counter((b, x, s) for b, x, s in ps if s > 25 and not any(kb == b and SequenceMatcher(None, k, x).ratio() >= 0.86 for kb, k in known))
    assert Counter((r.page, r.text, r.p_size) for r in got(spark, "fuzzy_anti")) == want
    both = Counter((r.page, r.text, r.p_size, r.source) for r in got(spark, "merged_readings"))
    assert both == Counter({(*k, "ocr"): n for k, n in want.items()}) + Counter((b, x, s, "native") for b, x, s in ps if s <= 25)


def test_phone_candidates_and_label_scores(spark):
    import re

    for r in got(spark, "phone_candidates"):
        text = f"tel +84 912-345-{str(r.o_orderkey % 1000)[:3]:0>3} or 0912345678901234 or 0987.654.321"
        assert r.phones.split(",") == list(dict.fromkeys(re.findall(r"(?<!\d)(?:\+?84|0)(?:[\s.\-]?\d){8,10}(?!\d)", text)))

    def score(key, label="blue widget"):
        words = set(label.split())
        return 1.0 if label in key else max(SequenceMatcher(None, key, label).ratio(), 0.92 * len(words & set(key.split())) / len(words))

    names = dict(rows("SELECT p_partkey, p_name FROM part"))
    assert {r.p_partkey: r.score for r in got(spark, "label_scores")} == {k: score(n.lower()) for k, n in names.items()}


def phrase(text, phrases):
    key = " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(c) != "Mn").split())
    if any(c.isdigit() or c == "@" for c in text):
        return text
    choice = phrases.get(key)
    if choice is None and len(key) >= 6:
        r = sorted(((SequenceMatcher(None, key, k).ratio(), k) for k in phrases), reverse=True)
        choice = phrases[r[0][1]] if r[0][0] >= 0.84 and r[0][0] - r[1][0] >= 0.08 else None
    if choice is None:
        return text
    return choice.upper() if text == text.upper() else choice[0].lower() + choice[1:] if text[0] == text[0].lower() else choice


def test_fuzzy_phrase(spark):
    want = {k: phrase(n.replace("i", "l"), extraction.PHRASES) for k, n in rows("SELECT p_partkey, p_name FROM part")}
    assert {r.p_partkey: r.text for r in got(spark, "fuzzy_phrase")} == want
    texts = ["Economv", "ECONOMY", "economyy", "red wldget", "Red wid9et", "small rin", "smal ring", "rings", "", "Small  Ring", "economie red"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    assert [r.corrected for r in policy.corrected(df, "s", extraction.PHRASES).collect()] == [phrase(x, extraction.PHRASES) if x else x for x in texts]


def test_decomposed_texts_fold_and_classify_alike(spark):
    texts = ["Hợp đồng lao động", "CURRICULUM VITAE\nKỹ năng: SQL\nHọc vấn", "Đơn nghỉ phép", "ÀÉÎÕÜ ñ ß Å"]
    both = spark.createDataFrame([(i, unicodedata.normalize("NFC", x), unicodedata.normalize("NFD", x)) for i, x in enumerate(texts)], "doc_id int, c string, d string")
    for fold in (t.fold_key, t.fold_strict, t.fold_ocr, t.fold_match, t.fold_evaluation, t.fold_agreement, t.compact_key, t.without_vietnamese_marks, t.mark_count):
        assert both.select((fold(F.col("c")) == fold(F.col("d"))).alias("x")).where("NOT x").count() == 0, fold
    kinds = [[(r.document_type, r.confidence) for r in classify.classify(both, text=c).orderBy("doc_id").collect()] for c in ("c", "d")]
    assert kinds[0] == kinds[1] and kinds[0][1][0] == "CV"


def test_scanned_templates_are_found_by_likeness(spark):
    docs = spark.createDataFrame([
        (1, "ĐƠN XIN NGHỈ PHÉP\nLý do xin nghỉ phép: ốm", "DOCX"), (2, "DON XIN NGHl PHEP\nLy do xln nghi phep: om", "IMAGE"), (3, "DON XIN NGHl PHEP\nLy do xln nghi phep: om", "DOCX"),
        (4, "Citizen Identity card\nDate of birth", "IMAGE"), (5, "Citizen Identity card\nDate of birth\nmat sau", "IMAGE"), (6, None, "IMAGE"), (7, "", None),
    ], "doc_id int, text string, source_format string")
    found = classify.detect_templates(docs, source_format=F.col("source_format"))
    assert {r.doc_id: r.template for r in found.collect()} == {1: "leave-request-v1", 2: "leave-request-v1", 3: None, 4: "vietnam-citizen-id-front-v1", 5: None, 6: None, 7: None}


def test_likest_window_equals_all_windows():
    import random

    r = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(0, 9)))
        marker = " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4)))
        words, n = text.split(), len(marker.split())
        want = 1.0 if text and marker in text else max((SequenceMatcher(None, " ".join(words[i : i + k]), marker).ratio() for k in range(max(1, n - 1), n + 2) for i in range(len(words) - k + 1)), default=0.0)
        assert t.likest_window(text, marker) == want


def sieved(boxes):
    """Boxes (id, x0, y0, x1, y1, text, ...) that are left when each one that stays, from the largest on, takes out what it covers."""
    size = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    fold = lambda b: " ".join((b[5] or "").casefold().split())
    left, out = sorted(boxes, key=lambda b: (-size(b), b[0])), []
    while left:
        top, *left = left
        out.append(top)

        def covered(b, top=top):
            w, h = (min(top[i + 2], b[i + 2]) - max(top[i], b[i]) for i in (1, 2))
            common = max(w, 0) * max(h, 0)
            total = size(top) + size(b) - common
            same = fold(b) == fold(top) and total > 0 and common / total >= 0.5
            inside = min(size(top), size(b)) > 0 and common / min(size(top), size(b)) >= 0.75
            return same or inside and len(fold(b)) <= max(4, 0.65 * len(fold(top)))

        left = [b for b in left if not covered(b)]
    return out


def test_distinct_boxes_on_random_pages(spark):
    import random

    from quirefold.operators import geometry

    r = random.Random(5)
    rows = []
    for page in range(60):
        for box in range(r.randrange(0, 12)):
            x, y = r.randrange(0, 30), r.randrange(0, 10)
            rows.append((page, box, float(x), float(y), float(x + r.randrange(0, 30)), float(y + r.randrange(0, 10)), r.choice(["an", "An", "bình  an", "something long", None, "", "x"])))
    got = sorted((x.page, x.box) for x in geometry.distinct_boxes(spark.createDataFrame(rows, "page long, box long, x0 double, y0 double, x1 double, y1 double, text string"), "page").collect())
    want = sorted((page, b[0]) for page in range(60) for b in sieved([x[1:] for x in rows if x[0] == page]))
    assert got == want and len(got) < len(rows)


def test_overlap_rows(spark):
    """The SQL-free rows of boxes, by a plain reading of the rule on the small tables' boxes."""
    got = {}
    for r in registry.QUERIES["overlap_rows"](spark, SF).collect():
        got.setdefault(r.page, []).append((r.row, r.text, r.confidence))
    want = {}
    for page, bs in pages().items():
        kept = sieved([(b[0], *b[3:7], b[7], 0.5 + b[0] / 100) for b in bs])
        groups = []
        for b in sorted(kept, key=lambda b: (b[2], b[1], b[0])):
            best = None
            for g in groups:
                top, low = min(x[2] for x in g), max(x[4] for x in g)
                h = min(low - top, b[4] - b[2])
                share = (min(low, b[4]) - max(top, b[2])) / h if h > 0 else 0
                d = abs((b[2] + b[4]) / 2 - (top + low) / 2)
                if share >= 0.45 and (best is None or d < best[0]):
                    best = (d, g)
            if best:
                best[1].append(b)
            else:
                groups.append([b])
        groups.sort(key=lambda g: min(x[2] for x in g))
        want[page] = [(i, " ".join(x[5] for x in sorted(g, key=lambda x: (x[1], x[0]))), round(sum(x[6] for x in g) / len(g), 4)) for i, g in enumerate(groups)]
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, x in want.items()}


def table_rows(spark, pages, kind="EMPLOYEE_MASTER_LIST"):
    """Cells (row, column, name, value, status, row status) by page."""
    from quirefold.operators import tables

    rows = [(p, kind, *w) for p, ws in pages.items() for w in ws]
    df = spark.createDataFrame(rows, "page long, kind string, x0 double, y0 double, x1 double, y1 double, text string, confidence double").repartition(3)
    out = {p: [] for p in pages}
    for r in tables.coordinate_tables(df, "page").collect():
        out[r.page].append((r["row"], r.column, r.name, r.value, r.status, r.row_status))
    return {p: sorted(x) for p, x in out.items()}


def test_coordinate_table(spark):
    word = lambda x, y, t, c=0.99: (float(x), float(y), x + 40.0, y + 16.0, t, c)
    words = [word(10, 0, "DANH SÁCH"), word(10, 40, "STT"), word(110, 40, "Mã NV"), word(210, 36, "Họ và"), word(210, 46, "tên"), word(310, 40, "Bộ phận")]
    words += [word(10, 90, "1"), word(110, 91, "NV001"), word(210, 90, "An"), word(310, 92, "Kho", 0.5), word(210, 102, "Nguyễn"), word(310, 101, "A")]
    words += [word(10, 140, "2"), word(110, 140, "NV002"), word(210, 141, "Bình"), word(10, 180, "Tổng cộng"), word(110, 180, "2")]
    got = table_rows(spark, {0: words, 1: words[:3], 2: [word(10, 0, None)]})
    assert [(r, n, v, s) for r, _, n, v, s, _ in got[0]] == [
        (0, "STT", "1", "accepted"), (0, "Mã NV", "NV001", "accepted"), (0, "Họ và / tên", "An Nguyễn", "accepted"), (0, "Bộ phận", "Kho A", "needs_review"),
        (1, "STT", "2", "accepted"), (1, "Mã NV", "NV002", "accepted"), (1, "Họ và / tên", "Bình", "accepted"), (1, "Bộ phận", "", "not_found"),
    ]
    assert {r: s for r, *_, s in got[0]} == {0: "needs_review", 1: "accepted"} and got[1] == got[2] == []
    assert table_rows(spark, {0: words}, "ANOTHER") == {0: []}


def by_hand(words, markers):
    """A page's table with lists and loops: clusters first, then rows of text, then lines put together from the end of each row on."""
    import re

    fold = lambda x: re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFD", x.casefold().replace("đ", "d")) if unicodedata.category(c) != "Mn")).strip()
    words = sorted(((y0, x0, x1, y1, t or "", c) for x0, y0, x1, y1, t, c in words), key=lambda w: (*w[:5], w[5] is not None, w[5] or 0))
    if not words:
        return []
    reach = max(7.0, sorted(w[3] - w[0] for w in words)[len(words) // 2] * 0.48)
    means, members = [], []
    for w in words:
        y = (w[0] + w[3]) / 2
        d, i = min(((abs(y - m), i) for i, m in enumerate(means)), default=(reach + 1, -1))
        if d <= reach:
            members[i].append(w)
            means[i] += (y - means[i]) / len(members[i])
        else:
            means.append(y)
            members.append([w])
    rows = [(means[i], sorted(members[i], key=lambda w: w[1])) for i in sorted(range(len(means)), key=lambda i: means[i])]
    hits = lambda ws: sum(any(fold(w[4]) == m or fold(w[4]).startswith(m + " ") or fold(w[4]) != "" and m.startswith(fold(w[4]) + " ") for w in ws) for m in markers)
    best = None
    for i in range(len(rows)):
        for n in (1, 2):
            ws = [w for _, r in rows[i : i + n] for w in r]
            p = 100 * hits(ws) - 10 * n + min(9, len(ws))
            if i + n <= len(rows) and (best is None or p > best[0]):
                best = (p, i, n, ws)
    _, i, n, head = best
    spots = sorted(((w[1] + w[2]) / 2, w[4]) for w in head)
    wide = max(18.0, sorted(w[2] - w[1] for w in head)[len(head) // 2] * 0.18)
    cols = []
    for x, t in spots:
        if cols and abs(x - sum(a for a, _ in cols[-1]) / len(cols[-1])) <= wide:
            cols[-1].append((x, t))
        else:
            cols.append([(x, t)])
    if hits(head) < 3 or len(cols) < 3:
        return []
    mids = [sum(a for a, _ in c) / len(c) for c in cols]
    body, out, waits = rows[i + n :], [], None
    gaps = sorted(b - a for (a, _), (b, _) in zip(body, body[1:]) if b > a)
    near = (gaps[len(gaps) // 2] if gaps else 30.0) * 0.45
    for y, ws in body:
        if any(s in " ".join(fold(w[4]) for w in ws) for s in ("tong cong", "nguoi lap", "nguoi phe duyet", "xac nhan", "ghi chu cuoi")):
            break
        cells = [[] for _ in cols]
        for w in ws:
            cells[min(range(len(mids)), key=lambda j: (abs(mids[j] - (w[1] + w[2]) / 2), j))].append(w)
        line = [(" ".join(w[4].strip() for w in c if w[4].strip()), next((w[5] for w in c if w[5] is not None), None)) for c in cells]
        texts = [t for t, _ in line if t]
        join = lambda a, b: [(" ".join(filter(None, (t, u))), c if t else d) for (t, c), (u, d) in zip(a, b, strict=True)]
        if len(texts) < 2:
            continue
        if re.fullmatch("[0-9]{1,3}", texts[0]) or any(re.fullmatch("(?i)(?=.*[0-9])[a-zà-ỹđ][a-zà-ỹđ0-9]{2,}([-/][a-zà-ỹđ0-9]+)*", t) for t in texts):
            out.append((y, join(line, waits) if waits else line))
            waits = None
        elif out and y - out[-1][0] <= near:
            out[-1] = (out[-1][0], join(out[-1][1], line))
        else:
            waits = line
    found = []
    for r, (_, line) in enumerate(out):
        states = ["not_found" if not t else "accepted" if (c or 0) >= 0.94 else "needs_review" for t, c in line]
        found += [(r, j, " / ".join(dict.fromkeys(t for _, t in cols[j])), t, s, "needs_review" if "needs_review" in states else "accepted") for j, ((t, _), s) in enumerate(zip(line, states, strict=True))]
    return found


def test_coordinate_tables_on_random_pages(spark):
    import random

    from quirefold.operators.tables import HEADERS

    r = random.Random(8)
    pages = {}
    for page in range(80):
        heads = r.sample(["STT", "Mã NV", "Họ và tên", "Bộ phận", "Chức danh", "Ngày vào", "other", "Trạng"], r.randint(3, 7))
        words = [(100.0 * j + r.randint(-5, 5), 40.0 + r.randint(-3, 30) * (r.random() < 0.3), 100.0 * j + 45, 58.0, h, 0.99) for j, h in enumerate(heads)]
        y = 100.0
        for i in range(r.randint(0, 8)):
            y += r.choice([6, 11, 30, 30, 31])
            for j in range(len(heads)):
                if r.random() < 0.75:
                    words.append((100.0 * j + r.randint(-40, 40), y + r.randint(-4, 4), 100.0 * j + r.randint(41, 60), y + r.randint(10, 18), r.choice([str(i + 1), "NV00" + str(i), "An", "Bình  An ", "kho 2", "", None, "Tổng cộng" if r.random() < 0.2 else "x"]), r.choice([0.99, 0.5, None])))
        r.shuffle(words)
        pages[page] = words
    got = table_rows(spark, pages)
    want = {p: sorted(by_hand(ws, HEADERS["EMPLOYEE_MASTER_LIST"])) for p, ws in pages.items()}
    assert sum(map(bool, want.values())) > 20
    for p in pages:
        assert got[p] == want[p], p


def test_label_likeness(spark):
    import random

    r = random.Random(6)
    words = ["họ", "tên", "ngay", "sinh", "ngaysinh", "so", "x"]
    pairs = [(r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))]), " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))) for _ in range(300)]

    def plain(a, b):
        if not a or (len(b) < 5 and b not in a):
            return 0.0
        part = sum(w in a.split() for w in set(b.split())) / len(set(b.split()))
        return 1.0 if b in a else max(0.92 * part, SequenceMatcher(None, a, b).ratio())

    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", t.label_likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(x.x - plain(*pairs[x.i])) < 1e-12 for x in got) and len(got) == 300


def every_assignment(costs):
    """(pairs, cost) of all one-to-one assignments, by trying each."""
    labels = sorted({a for a, _ in costs})

    def go(i, used, pairs, total):
        if i == len(labels):
            yield pairs, total
            return
        yield from go(i + 1, used, pairs, total)
        for (a, v), c in costs.items():
            if a == labels[i] and v not in used:
                yield from go(i + 1, used | {v}, [*pairs, (a, v)], total + c)

    yield from go(0, frozenset(), [], 0.0)


def test_cheapest_assignment_is_the_best_of_all():
    import random

    from quirefold.operators.tables import cheapest

    r = random.Random(2)
    for _ in range(300):
        costs = {(a, v): r.choice([r.uniform(-9, 9), float(r.randrange(-3, 4))]) for a in range(r.randrange(1, 5)) for v in range(r.randrange(1, 6)) if r.random() < 0.6}
        got = cheapest(costs)
        assert len({a for a, _ in got}) == len({v for _, v in got}) == len(got) and set(got) <= set(costs)
        size, cost = max((len(p), -c) for p, c in every_assignment(costs))
        assert len(got) == size and abs(sum(costs[x] for x in got) + cost) < 1e-9


def test_assigned_values(spark):
    """No line for two labels, the least cost of all assignments page by page, and the right kind after the rescue."""
    import re

    from quirefold.operators import tables

    lines = boxes.labelled_lines(spark, SF).cache()
    costs = {}
    for r in tables.label_pairs(lines.withColumn("m", F.lit(False)), "page", "field", "m").collect():
        costs.setdefault(r.page, {})[r.a_id, r.b_id] = r.cost
    by = {(r.page, r.id): r for r in lines.collect()}
    got = {}
    for r in registry.QUERIES["assigned_values"](spark, SF).collect():
        got.setdefault(r.page, []).append(r)
    first = {}
    for r in tables.one_to_one(tables.label_pairs(lines.withColumn("m", F.lit(False)), "page", "field", "m"), ["page"], "a_id", "b_id", "cost").collect():
        first.setdefault(r.page, []).append((r.label, r.value))
    rescued = 0
    for page, cs in costs.items():
        size, cost = max((len(p), -c) for p, c in every_assignment(cs))
        assert len(first[page]) == size and abs(sum(cs[x] for x in first[page]) + cost) < 1e-9
    fits = lambda label, text: label.kind == "any" or re.search(tables.KINDS[label.kind], text) is not None
    for page in {p for p, _ in by}:
        rows = got.get(page, [])
        assert len({r.label for r in rows}) == len({r.value for r in rows}) == len(rows)
        for r in rows:
            assert fits(by[page, r.label], r.text) and by[page, r.value].text == r.text and (r.rescued or (r.label, r.value) in first[page])
            rescued += r.rescued
        # Whoever is left without a value finds no free line of its kind on the page.
        free = [by[k].text for k in by if k[0] == page and by[k].field is None and k[1] not in {r.value for r in rows}]
        for k, label in by.items():
            if k[0] == page and label.kind in tables.KINDS and k[1] not in {r.label for r in rows}:
                assert not any(fits(label, x) for x in free)
    assert rescued > 5


def test_like_texts_meet_by_grams(spark):
    """The same pairs as by comparing all, at several ratios, with short, blank and repetitive texts."""
    import random

    from quirefold.operators import likeness, matching

    r = random.Random(12)
    base = ["".join(r.choice("abcdef  é") for _ in range(r.randrange(0, 25))) for _ in range(40)]

    def bent(x):
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(x) + 1)
            x = x[:i] + r.choice(["", "z", "ab"]) + x[i + r.randrange(0, 2) :]
        return x

    a = [(g, x) for g in range(3) for x in {bent(r.choice(base)) for _ in range(60)}] + [(0, "aaaa"), (1, ""), (2, "a")]
    b = [(g, x) for g in range(3) for x in {bent(r.choice(base)) for _ in range(60)}] + [(0, "aaaaa"), (1, ""), (2, "b")]
    da, db = (spark.createDataFrame([*x, (0, None)], "g int, t string") for x in (a, b))
    for least in (0.5, 0.7, 0.86, 0.95):
        want = {(g, x) for g, x in a if any(g == h and SequenceMatcher(None, y, x).ratio() >= least for h, y in b)}
        got = {tuple(x) for x in likeness.like_known(da, db, "g", "t", least).collect()}
        assert got == want, least
    assert Counter(map(tuple, matching.fuzzy_anti(da, db, "g", "t").collect())) == Counter((g, x) for g, x in a if not any(g == h and SequenceMatcher(None, y, x).ratio() >= 0.86 for h, y in b)) + Counter({(0, None): 1})


def test_few_pairs_of_a_hot_group_are_compared(spark):
    import random

    from quirefold.operators import likeness

    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    texts = [" ".join(word() for _ in range(5)) for _ in range(600)]
    a, b = spark.createDataFrame([("hot", x) for x in texts[:400]], "group string, text string"), spark.createDataFrame([("hot", x[:-1] + "q") for x in texts[200:]], "group string, text string")
    met = likeness.candidates(a, b, 0.86).count()
    assert 180 <= met < 0.05 * 400 * 400
    assert likeness.like_known(a, b, "group", "text", 0.86).count() >= 200


def test_normalized_tables(spark):
    """The best of all matchings of headers to wanted columns, native tables before others, and the status of rows."""
    from quirefold.operators import tables

    native, coordinate = (x.collect() for x in boxes.found_tables(spark, SF))
    with_native = {r.doc for r in native}
    cells = {}
    for r in [*native, *(r for r in coordinate if r.doc not in with_native)]:
        cells.setdefault(r.doc, []).append(r)
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.casefold().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    wanted = tables.HEADERS["EMPLOYEE_MASTER_LIST"]

    def like(a, b):
        part = len(set(a.split()) & set(b.split())) / len(set(b.split()))
        return 1.0 if b in a else 0.0 if len(b) < 5 else max(SequenceMatcher(None, a, b).ratio(), 0.92 * part)

    got = {}
    for r in registry.QUERIES["normalized_tables"](spark, SF).collect():
        got.setdefault(r.doc, []).append(r)
    misread = 0
    best = {}
    for doc, rs in cells.items():
        heads = tuple(fold(h) for _, h in sorted({(r.column, r.header) for r in rs}))
        costs = {(i, j): -like(h, w) for i, h in enumerate(heads) for j, w in enumerate(wanted) if like(h, w) >= 0.6}
        if heads not in best:
            best[heads] = max((len(p), -c) for p, c in every_assignment(costs)) if costs else (0, 0.0)
        size, total = best[heads]
        mine = got.get(doc, [])
        used = {r.name: int(r.value[1:]) for r in mine}
        assert len(used) == len(set(used.values())) == size and abs(sum(like(heads[i], n) for n, i in used.items()) - total) < 1e-9
        assert len(mine) == size * len({r.row for r in rs})
        status = {}
        for r in rs:
            ok = r.status == "accepted" if r.status else r.source == "docx_table"
            status[r.row] = status.get(r.row, True) and ok
        assert all(r.status == ("accepted" if status[r.row] else "needs_review") and r.source == rs[0].source for r in mine)
        misread += any(n == "ho va ten" and heads[i] == "ho va tcn" for n, i in used.items())
    assert set(got) <= set(cells) and misread and {r.source for rs in got.values() for r in rs} == {"docx_table", "pdf_table", "coordinates"}
