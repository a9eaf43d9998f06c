"""License scans against a plain search of every phrase and template at every word."""

import math
import random
import re

import duckdb
import pytest

from quirefold.llm import license_scan as ls
from quirefold.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    file = split(text)
    found = sorted((i, label) for label, p in PHRASES.items() for i in range(len(file)) if file[i : i + len(p.split())] == p.split())
    return len(file), found


def plain(text, documents):
    """Labels and score, by comparing word by word at every position."""
    files = [set(split(t)) for t in documents]
    weight = lambda w: math.log1p(len(files) / (1 + sum(w in f for f in files)))
    file, labels, score = split(text), {x for _, x in base(text)[1]}, 1.0 if base(text)[1] else 0.0
    for label, keys, body in ls.TEMPLATES:
        want, keys = split(body or keys[0]), [split(k) for k in keys]
        at = [next(i for i in range(len(want)) if want[i : i + len(k)] == k) for k in keys]
        stands = lambda k, i: i >= 0 and file[i : i + len(k)] == k
        for i in range(len(file)):
            if not stands(keys[0], i):
                continue
            start = i - at[0]
            met = all(any(stands(k, start + o + s) for s in range(-ls.SLACK, ls.SLACK + 1)) for k, o in zip(keys[1:], at[1:], strict=True))
            near = [w in file[max(0, start + j - ls.SLACK) : max(0, start + j + ls.SLACK + 1)] for j, w in enumerate(want)]
            cover = sum(weight(w) for w, n in zip(want, near, strict=True) if n) / sum(map(weight, want))
            met = met and (cover >= ls.COVERAGE or body is None)
            score = max(score, cover if met else cover / 2)
            if met:
                labels.add(label)
    return ",".join(sorted(labels)), score


def texts(seed):
    rng = random.Random(seed)
    bodies = [t or k[0] for _, k, t in ls.TEMPLATES]
    filler = "the of Éa work mit license apache gnu public general cc by 2 0 version software".split()
    out = [None, "", "...", "MIT LICENSE mit-license Mit\tLicense", "CC BY cc by-nc 4.0", "gnu general public general public license", "cc cc by by", "x\x00mit license", "ſmit license KK"]
    for _ in range(60):
        body = rng.choice(bodies).split()
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(body) + 1)
            body[i : i + rng.randint(0, 2)] = [rng.choice(filler) for _ in range(rng.randint(0, 3))]
        out.append(rng.choice([" ", "\n", ", "]).join([rng.choice(filler) for _ in range(rng.randint(0, 20))] + body + [rng.choice(filler) for _ in range(rng.randint(0, 20))] + body[: rng.randint(0, len(body))]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_search(spark, seed):
    rows = [(i // 2, t, "label", 1.0, "places") for i, t in enumerate(texts(seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, score double, places string").repartition(3)
    got = {}
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/licenses{seed}/documents.parquet")
    for r in QUERIES["op12_license_scan"](spark, path.removesuffix("/documents.parquet")).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = {}
    for i, t, *_ in rows:
        n, found = base(t)
        labels, score = plain(t, [r[1] for r in rows])
        want.setdefault(i, []).append((n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})), labels, round(score, 9)))
    key = lambda x: tuple(map(str, x))
    assert {i: sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in v), key=key) for i, v in got.items()} == {i: sorted(v, key=key) for i, v in want.items()}


def test_places_of_a_template(spark):
    text = "Copyright 2020 A. " + ls.TEMPLATES[0][2].replace("obtaining", "who is obtaining") + ". MIT License."
    df = spark.createDataFrame([(1, text), (None, text[:90])], "doc_id long, text string")
    one, cut = sorted(ls.scan_licenses(df).collect(), key=lambda r: r.doc_id is None)
    assert [(p.label, p.base, p.start) for p in one.places] == [("mit", False, 3), ("mit", True, len(split(text)) - 2)] and one.score == 1.0
    assert cut.places == [] and 0 < cut.score < 0.5


def test_base_columns_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = QUERIES["op12_license_scan"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts) and any(r.n_base for r in got)
    for r in got:
        n, found = base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
