"""The training-data operators against brute force, round trips and held-out accuracy, with the awkward rows of every kind."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bpe, fingerprints, html_extract, jaccard_join, language_id, mixing, pii, substring_dedup, topk, toxicity
from quirefold.llm.common import banding, components, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, k string"
SF = "/root/testdata/sf0.001"


def table(spark, texts, lang="en", ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# --- language -------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = language_id.identify(docs, language_id.fit(learn)).withColumn("held_out", language_id.held_out(F.col("doc_id")))
    r = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and 0 <= r.lo and r.hi <= 1


def test_language_awkward_rows(spark):
    docs = table(spark, [None, "", "123 !!", "the cat and the dog", "the cat and the dog", "x" * 2_000_000])
    model = language_id.fit(table(spark, ["the cat and the dog", "of the and to", None]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3] == got[4] and got[3][0] == "en" and got[5][0] == "en"
    assert language_id.fit(docs.limit(0)) is None
    assert language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs.limit(0), model).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------


def test_restores_obfuscated_words(spark):
    docs = spark.createDataFrame([("the idiot and the moron said stupid things to a loser with trash",)] * 3 + [("people said other things in the garden",)] * 5, "text string")
    r = toxicity.Restorer(toxicity.CharModel.fit(docs))
    for seen, want in [("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("iiidiooot", "idiot"), ("tr@sh", "trash"), ("$tupid!!", "stupid"), ("l o s e r", "loser")]:
        assert want in (r.words(seen) if " " not in seen else [r.decode(seen)]), seen
    assert "idiot" in r.words("1d10t")
    assert r.restore("plain words, stay. as they are!") == "plain words, stay. as they are!"


def test_plain_words_stay_beside_readings(spark):
    docs = spark.createDataFrame([("the idiot and the moron said stupid things to a liar and a fool with trash",)] * 3 + [("people said other good things well in the garden",)] * 5, "text string")
    r = toxicity.Restorer(toxicity.CharModel.fit(docs))
    for seen, want in [("you.idiot", "idiot"), ("liar/idiot", "liar idiot"), ("fool—idiot", "fool idiot"), ("well...idiot", "idiot"), ("iddiioott", "idiot"), ("id-iot", "idiot"), ("SttuuPPiidd!", "stupid"), ("st-u-pid,", "stupid"), ("good/1d10t", "good idiot"), ("well...m0r0n", "moron")]:
        assert set(want.split()) <= set(r.words(seen)), (seen, r.words(seen))
    assert r.words("good")[0] == "good" and r.words("plain") == ["plain"] and r.words("...") == []


def test_decoder_finds_the_best_path(spark):
    rng = np.random.default_rng(5)
    lm = toxicity.CharModel(rng.integers(0, 50, toxicity.WIDTH**3))
    d = toxicity.Decoder(lm)

    def brute(s):
        best = (-math.inf, "")
        lo, hi = toxicity._inside(s)

        def walk(i, a, b, seen, score, out):
            nonlocal best
            if i == len(s):
                best = max(best, (score + float(lm.log[a][b][0]), out))
                return
            c = s[i]
            options = [(c, toxicity.KEEP)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")]
            for x, cost in options:
                j = toxicity.PLACE.get(x, toxicity.OTHER)
                walk(i + 1, b, j, x, score + cost + (toxicity.DOUBLE if x == seen else 0) + float(lm.log[a][b][j]), out + x)
                if x == seen:
                    walk(i + 1, a, b, seen, score + toxicity.REPEAT, out)
            if not c.isalpha():
                drop = toxicity.KEEP if c.isspace() else toxicity.AFTER if not lo <= i < hi or not (c in toxicity.LEET or c.isdigit()) else toxicity.NOISE
                walk(i + 1, a, b, seen, score + drop, out)

        walk(0, 0, 0, "", 0.0, "")
        return best[1]

    for s in ["1d10t", "a a b", "oo0o", "$$x!", "s|y", "aab1"]:
        assert d(s) == brute(s), s


def test_toxicity_held_out_and_awkward_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where(language_id.held_out(F.col("doc_id"))).toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.6 * (got.toxic == 1).sum() and hit >= 0.8 * (got.predicted == 1).sum()
    assert got.score.between(0, 1).all()
    odd = table(spark, [None, "", "idiot " * 50_000, "fine words here", "fine words here"])
    rows = {r.doc_id: r.score for r in toxicity.score_documents(odd, model).collect()}
    assert rows[0] == rows[1] and rows[3] == rows[4] and rows[2] > 0.5
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 3, 4}
    none = toxicity.fit(odd.limit(0), labels.limit(0))
    assert 0 < toxicity.score_documents(odd, none).first().score < 0.3


# --- Jaccard join ---------------------------------------------------------------------------------------------


def brute_classes(rows, least=0.8):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[top(i)] = top(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[top(i)].append(rows[i][0])
    return Counter((rows[i][0], min((x for x in ids[top(i)] if x is not None), default=None), links[i]) for i in range(len(rows)))


def near_copies():
    texts = []
    for s in range(6):
        base = words(s, 120)
        for e in range(8):
            w, r = list(base), random.Random(100 * s + e)
            for _ in range(e // 2):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            texts.append(" ".join(w))
    return [*texts, None, "", "   ", "three short words", "three short words", "other", " ".join(words(50, 30_000)), " ".join(words(50, 30_000))]


def test_jaccard_equals_brute_force(spark):
    texts = near_copies()
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_classes(table(spark, texts).repartition(5)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)


def test_jaccard_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)


def test_jaccard_large_group_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    texts = near_copies()
    got = jaccard_join.jaccard_classes(table(spark, texts)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(list(enumerate(texts)))


def test_jaccard_odd_ids_and_empty(spark):
    t = " ".join(words(1, 50))
    docs = table(spark, [t, t, t, "a b c d e f", t], ids=[3, 3, None, 3, 2])
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect())
    assert got == Counter({(3, 2, 3): 2, (None, 2, 3): 1, (3, 3, 0): 1, (2, 2, 3): 1})
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_keep_one(spark):
    texts = near_copies()
    docs = table(spark, texts)
    want = {d for d, c, _ in brute_classes(list(enumerate(texts))) if d == c}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_banding_meets_its_recall():
    for s, r, rows in [(0.8, 0.999, 8), (0.5, 0.9, 3), (0.9, 0.99, 10)]:
        b, _ = banding(s, r, rows)
        assert 1 - (1 - s**rows) ** b >= r > 1 - (1 - s**rows) ** (b - 1)


def test_components_of_long_chains(spark):
    names = [hashlib.md5(str(i).encode()).digest() for i in range(60)]
    edges = [(names[i], names[i + 1]) for i in range(39)] + [(names[i], names[i + 1]) for i in range(41, 59)]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len(set(got[n] for n in names[:40])) == 1 and len(set(got[n] for n in names[41:])) == 1 and got[names[0]] != got[names[50]]


# --- pages ----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>bad</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header><div class="layout"><div class="left-bar sidebar"><p>{side}</p></div>
<div class="content item-{n}"><h2>Head &amp; more</h2><p>One <i>two</i>thr&eacute;e &nbsp; four<br>five<p>Six</p><div class="ad">buy</div><ul><li>a</li><li>b</li></ul>
<form><input name=q><button>Go</button></form></div><section id="comments"><div class="comment"><p>{comment}</p></div></section></div><footer>&copy; x</footer></body></html>"""
WANT = "Head & more One twothrée four five Six a b"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, paths string")


def test_extraction_by_host_votes(spark):
    long, short = "words that go on " * 60, "short"
    rows = [("http://a.example/x", PAGE.format(n=i, side=short, comment=short)) for i in range(5)]
    rows += [("http://A.example:80/y", PAGE.format(n=7, side=long, comment=long))]
    odd = [(None, None), ("http://b.example", ""), ("x", "plain <b>te</b>xt"), ("http://b.example", "<div>" * 3000 + "deep"), ("http://b.example", "<p>" + "word " * 200_000), ("http://c.example", "<!-- open"), ("http://c.example", "<script>never closed")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(pages(spark, rows + odd)).collect()}
    assert all(got[i][0] == WANT for i in range(6))
    assert [got[6 + i][0] for i in (0, 1, 2, 3, 5, 6)] == ["", "", "plain text", "deep", "", ""] and got[10][1] == 200_000 * 5 - 1
    assert all(n == len(t) for t, n in got.values())
    assert html_extract.extract_pages(pages(spark, rows).limit(0)).count() == 0


def test_votes_decide_over_a_page_of_its_own(spark):
    one = "<body><div class=main><p>{0}</p></div><div class=extra><p>{1}</p></div></body>"
    rows = [("http://a.example", one.format("article text here", "x"))] * 3 + [("http://a.example", one.format("tiny", "much more text " * 20))]
    got = [r.text for r in html_extract.extract_pages(pages(spark, rows)).orderBy("page_id").collect()]
    assert got == ["article text here"] * 3 + ["tiny"]


@pytest.mark.parametrize("few", [20_000, 0])
def test_votes_count_beyond_the_listed_paths(spark, monkeypatch, few):
    monkeypatch.setattr(html_extract, "BROADCAST_CHOICES", few)
    one = "<body><div class=t-{0}><p>{1}</p></div><div class=extra-{0}><p>{2}</p></div></body>"
    names = [chr(97 + i) * 3 for i in range(24)]
    rows = [("http://a.example", one.format(n, f"article of {n} here", "x")) for i, n in enumerate(names) for _ in range(30 - i)]
    rows += [("http://a.example", one.format(n, "tiny", "much more text " * 20)) for n in names] * 2
    rows += [("http://a.example", None), ("http://a.example", "<nav>menu</nav>"), ("http://b.example", one.format("zzz", "tiny", "much more text " * 20))]
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    want = [re.search(r"<p>(.*?)</p>", h)[1] for _, h in rows[:-3]] + ["", "", ("much more text " * 20).strip()]
    assert [got[i] for i in range(len(rows))] == want and len(got) == len(rows)


def test_extraction_equals_the_article_on_pages(spark):
    import html

    for r in html_extract.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        art = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        art = re.sub(r"<[^>]+>", "", re.sub(r"<(?:br|/?p|/?h1|/?li|/?ul)[^>]*>", " ", art))
        assert r.text == " ".join(html.unescape(art).split())


# --- BPE ------------------------------------------------------------------------------------------------------

HARD = [
    None, "", "İstanbul ΣΑΣ ς <|endoftext|>hi<|startoftext|>  there", "it's we'LL don't 'dog 1234 ½ Ⅷ ﬁ àé ​ 　x 日本語テキスト 👩‍👩‍👧 naïve…", "<|endoftext|><|endoftext|>", "a" * 300,
    "ab" * 500, "!?" * 100, "\x00\x01\x1c\x1d\x85 x\x1fy", "<|endoftext", "word " * 30_000,
]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib = Tokenizer.from_file(path)
    r = random.Random(3)
    letters = "abcdefgthinesor'ßéÜñ 019.,!\n\t日ऄ😀İΣ"
    texts = HARD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(500)] + [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = table(spark, texts)
    enc = bpe.encode_documents(docs, path)
    back = {x.doc_id: x.text for x in bpe.decode_documents(enc, path).collect()}
    for x in enc.collect():
        ids = lib.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert x.ids == np.array(ids, "<u4").tobytes() and x.n_tokens == len(ids)
        text = lib.decode(ids, skip_special_tokens=False)
        assert back[x.doc_id] == text and x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and x.ids_sha256 == hashlib.sha256(bytes(x.ids)).hexdigest()
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


def test_bpe_lookup_tables_stay_bounded():
    e = bpe.Encoder(bpe.tokenizer_path())
    e.words.most = e.chunks.most = 50
    texts = [" ".join(words(i, 40, 10_000)) for i in range(20)]
    assert [e.encode([t])[0] for t in texts] == bpe.Encoder(bpe.tokenizer_path()).encode(texts)


def test_bpe_looks_up_each_word_once_however_it_is_cased_or_punctuated(monkeypatch):
    asked = []
    lacks = bpe.Recent.lacks
    monkeypatch.setattr(bpe.Recent, "lacks", lambda self, keys: asked.extend(keys) or lacks(self, keys))
    texts = [" ".join(case(w) + sign for w in words(1, 200, 20)) for sign in ".,;:!?" for case in (str.lower, str.upper)]
    plain = bpe.Encoder(bpe.tokenizer_path())
    got = plain.encode(texts)
    # "w" and the ten digits, and the six signs: the stretches between white space are some 240.
    assert len(asked) <= 17 and got[0] == got[1]


def test_bpe_of_parts_and_other_patterns_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib = Tokenizer.from_file(path)
    r = random.Random(11)
    bits = ["'s", "'T", "'re", "'LL", "''", "'", "a", "The", "ing", "12", "½", "!'", "...", " ", "\n", "\x1c", "\x85", "\u3000", "é", "e\u0301", "\u0301", "ΑΣ", "ß", "日本", "😀", "<|endoftext|>", "<|"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(1500)] + [t for t in HARD if t is not None]
    ids = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    want = [(np.array(x, "<u4").tobytes(), lib.decode(x, skip_special_tokens=False)) for x in ids]
    for signs in (7, 500, 1 << 20):
        monkeypatch.setattr(bpe.Encoder, "SIGNS", signs)
        assert bpe.Encoder(path).encode(texts) == want
    monkeypatch.setattr(bpe, "WORDS", "")  # as for a pattern that is not known by its kinds of signs
    assert bpe.Encoder(path).encode(texts) == want


def test_bpe_forgets_steps_and_pairs(monkeypatch):
    texts = [" ".join(words(i, 40, 10_000)) + " internationalization unbelievably" for i in range(10)]
    want = bpe.Encoder(bpe.tokenizer_path()).encode(texts)
    monkeypatch.setattr(bpe, "STEPS_KEPT", 20)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    e = bpe.Encoder(bpe.tokenizer_path())
    e.forget()
    assert [e.encode([t])[0] for t in texts] == want and len(e.v.steps) <= 20 and sum(map(len, e.v.pairs.values())) <= 5
    e.forget()


def test_pairs_that_stand_equal_plain_merging():
    v = bpe.vocabulary(bpe.tokenizer_path())
    inner = [t for t in v.whole if bpe.MARK not in t]
    r = random.Random(9)
    every = sorted(v.whole)
    for _ in range(4000):
        a, b = r.choice(inner), r.choice(every)
        assert v.stand(a, b) == (v.merge(v.symbols(a) + v.symbols(b)) == [a, b])


# --- fingerprints ---------------------------------------------------------------------------------------------


def test_fingerprints_equal_brute_force(spark):
    texts = ["a b c d e f g h", "é" * 7, None, "", " ".join(words(2, 400)), " ".join(words(2, 400)), " ".join(words(3, 9_000))]
    rows = sorted(zip([5, 9, 1, 7, 3, 3, 11], texts, strict=True), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    docs = table(spark, texts, ids=[5, 9, 1, 7, 3, 3, 11])
    got = sorted((tuple(r) for r in fingerprints.with_next(docs, fingerprints._digest, fingerprints.SCHEMA, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()), key=str)
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = a or "", b or ""
        k = len(a) // 2
        e = a[: len(a) - k] + b[:k]
        sig = [fingerprints.signature(x) for x in (a, e, b)]
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(a), fingerprints.fingerprint(e), float((sig[0] == sig[1]).mean()), float((sig[0] == sig[2]).mean())))
    assert got == sorted(want, key=str)


def test_likeness_estimates_jaccard():
    base = words(4, 2000, 10**6)
    for share in (0.05, 0.2, 0.5):
        other = base[: int(2000 * (1 - share))] + words(5, int(2000 * share), 10**6)
        a, b = " ".join(base), " ".join(other)
        true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        assert abs(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - true) < 0.15
    assert fingerprints.likeness(fingerprints.signature("x y"), fingerprints.signature("x y")) == 1


def test_fingerprints_single_and_empty_table(spark):
    args = (fingerprints._digest, fingerprints.SCHEMA, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    one = fingerprints.with_next(table(spark, ["abc"]), *args).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert fingerprints.with_next(table(spark, ["abc"]).limit(0), *args).count() == 0
    assert fingerprints.with_next(table(spark, ["a", "b"], ids=[None, None]), *args).count() == 2


# --- mixing ---------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / w > 3 * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            rest -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 1000, 5, 3], [0, 7, 100], [5], [1, 1, 1, 10_000]])
def test_mix_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02}", s, i % 3 + 1) for i, s in enumerate(sizes)], "source string, source_size long, weight long")
    got = [r.target for r in mixing.source_targets(rows).orderBy("source").collect()]
    assert got == pytest.approx(brute_targets(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def test_mixed_documents(spark):
    rows = [(i, " ".join(words(i, 3 + i % 40)), "en", None if i % 7 == 0 else f"s{i % 4}", 0, "n", "k", "k") for i in range(600)] + [(9999, None, None, "s1", None, "n", "k", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    slim = docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))
    plan = {r.doc_id: r for r in mixing.mix_sizes(slim).collect()}
    taken, target = Counter(), {}
    for r in plan.values():
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert math.floor(r.rate) <= r.copies <= min(3, math.floor(r.rate) + 1)
    assert {s: (taken[s], target[s]) for s in target if abs(taken[s] - target[s]) >= 0.02 * target[s] + 40} == {}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: r.copies for k, r in plan.items() if r.copies})
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_targets_are_met_with_null_and_repeated_ids(spark):
    rows = [(None, f"one two three {i}", "en", "x", 0, "n", "k", "k") for i in range(200)] + [(7, "the same four words", "en", "y", 0, "n", "k", "k")] * 300
    rows += [(8, f"a b c {i}", "en", "z", 0, "n", "k", "k") for i in range(500)] + [(i, "p q r s", "en", "w", 0, "n", "k", "k") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, DOCS)
    for one in (mixing.mix_documents(docs), mixing.mix_documents(docs.repartition(7))):
        taken = Counter({r.source: r.n for r in one.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()})
        goal = {r.source: r.target for r in mixing.mix_sizes(docs.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"), F.md5("text").alias("content"))).select("source", "target").distinct().collect()}
        assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in goal), (taken, goal)
    again = mixing.mix_documents(docs)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, one.collect()))


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EACH", 3)
    rows = spark.createDataFrame([("a", 10), ("b", 0), ("c", 3), ("d", 4)], "x string, n long")
    assert Counter((r.x, r.at) for r in mixing.repeated(rows, "n", "at").collect()) == Counter((x, i) for x, n in (("a", 10), ("c", 3), ("d", 4)) for i in range(n))


# --- personal data --------------------------------------------------------------------------------------------


def base_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(11)
    parts = ["a@b.c", "x.y@mail.example.com", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+1 (555) 123-4567", "+44 20 7946 0958", "+", " ", "-", ".", "é", "word", "0", "12", "\n", "a@b", "._%+-@x.y", "٣"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)] + [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        got = [(s.kind, s.start, s.end) for s in pii.find(text) if s.rank < 4]
        assert got == base_spans(text), text


def test_personal_data_validators_and_awkward_rows(spark):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert "iban" in {s.kind for s in pii.find("account GB82 WEST 1234 5698 7654 32.")}
    assert [s.kind for s in pii.find("call 555-1234 now")] == ["local_phone"] and pii.find("part 555-1234 now") == []
    for long in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "a." * 150_000 + "@", "A1" * 150_000):
        pii.find(long)
    docs = table(spark, [None, "", "mail a@b.co and a@b.co", "x"])
    got = {r.doc_id: (r.kinds, r.starts, r.ends) for r in pii.find_personal_data(docs).collect()}
    assert got == {0: ([], [], []), 1: ([], [], []), 2: (["email", "email"], [5, 16], [11, 22]), 3: ([], [], [])}
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_documents(docs).collect()}
    assert out[2] == ("mail [email] and [email]", 24) and out[0] == (None, None) and pii.mask_documents(docs).columns == docs.columns
    assert pii.mask_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("iban", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"])
@pytest.mark.parametrize("after", ["", ".", " Please pay", " Bitte", " BIC COBADEFF", " BIC", " I", " 7 days", " 2024 AND 12 MORE", "\nNext", " A1" * 40, " x", "é"])
def test_iban_before_words_and_numbers(spark, iban, after):
    for before in ("", "account ", "AB12 ", "NO12 CODE "):
        text = f"{before}{iban}{after}"
        got = [(s.start, s.end) for s in pii.find(text) if s.kind == "iban"]
        assert got == [(len(before), len(before) + len(iban))], text
        assert pii.masked(text) == f"{before}[iban]{after}"


def test_iban_equals_every_start_and_end():
    r = random.Random(7)
    assert pii.find("GB82 WEST 1234 5698 7654 33 Please") == pii.find("GB82WEST12345698765432X") == pii.find("xGB82WEST12345698765432") == []
    for _ in range(300):
        text = " ".join(r.choice(["GB82", "WEST", "1234", "5698", "7654", "32", "DE89370400440532013000", "Pay", "QZ", "É1", "7"]) for _ in range(r.randrange(12)))
        every = [(a, b) for a in range(len(text)) for b in range(a + 15, len(text) + 1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", text[a:b]) and not re.match(r"[A-Za-z0-9]", text[b:]) and not re.search(r"[A-Za-z0-9]$", text[:a]) and pii.mod97(text[a:b])]
        want, at = [], 0
        for a in sorted({a for a, _ in every}):
            if a >= at:
                at = max((b for x, b in every if x == a), key=lambda b: (len(text[a:b].replace(" ", "")) == {"GB": 22, "DE": 22}.get(text[a : a + 2]), b))
                want.append((a, at))
        assert pii.ibans(text) == want, text
    for long in ("AA11 " * 60_000, "AA11BB22CC33DD44 " * 20_000):
        pii.ibans(long)


# --- repeated strings -----------------------------------------------------------------------------------------


def brute_removed(rows):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c)
    return out


def test_suffix_array():
    r = random.Random(2)
    for _ in range(1500):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randrange(50))]
        assert substring_dedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    s = np.random.default_rng(1).integers(1, 1 << 40, 500)
    assert substring_dedup.suffix_array(s).tolist() == sorted(range(500), key=lambda i: s[i:].tolist())


def repeating_texts():
    passage, other = " ".join(words(70, 60)), " ".join(words(71, 30))
    texts = [" ".join(words(i, 80, 10**6)) for i in range(6)]
    texts += [f"{texts[0][:200]} {passage} {i} {other} {'é' * (i % 3)}" for i in range(12)]
    texts += [texts[1], texts[1], texts[2][:150], "In. " * 400, "x" * 700, passage, None, "", "short", texts[3][:99], texts[3][:100]]
    return texts


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST", most)
    texts = repeating_texts()
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.without_repeats(table(spark, texts).repartition(4)).collect()}
    assert got == brute_removed(list(enumerate(texts)))


def test_repeats_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    texts = repeating_texts()
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.without_repeats(table(spark, texts)).collect()}
    assert got == brute_removed(list(enumerate(texts)))


def test_repeats_with_odd_ids(spark):
    t = " ".join(words(5, 60))
    docs = table(spark, [t, t, t + " end", None], ids=[4, 4, 4, None])
    got = Counter((r.doc_id, bytes(r.kept)) for r in substring_dedup.without_repeats(docs).collect())
    b = t.encode()
    assert got == Counter({(4, b): 2, (4, (t + " end").encode()[len(b) :]): 1, (None, b""): 1})
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


# --- top k ----------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) if x > 0.2 else 0.0 for x in r.normal(size=6)]) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]
    bad = [(1000, None), (1100, [None] * 6), (1200, [float("nan")] * 6), (1300, [float("inf")] + [0.0] * 5), (None, [9.0] * 6)]
    v = topk.quantise(spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>"))
    # Every row counts: also one without an id, and each of those that share one.
    q = [(i, np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in [*rows, *rows[:2], (None, [9.0] * 6)]]
    want = Counter()
    for a, (i, x) in enumerate(q):
        if i is not None and i % 100 == 0:
            best = sorted((-int(x @ y), j is None, j or 0) for b, (j, y) in enumerate(q) if b != a)[:10]
            want.update((i, n, None if none else j, -s) for n, (s, none, j) in enumerate(best, 1))
    assert any(x[2] is None for x in want) and max(want.values()) == 2
    for blocks in ((8192, 1024), (64, 2)):
        assert Counter(tuple(x) for x in topk.top_k(v, "vec_id % 100 = 0", 10, *blocks).collect()) == want
    assert topk.top_k(v.where("vec_id < 3"), "vec_id % 100 = 0", 10).count() == 2 * 4
    assert topk.top_k(v.limit(0), "vec_id % 100 = 0", 10).count() == 0


def test_accumulation_skips_absent_terms():
    r = np.random.default_rng(3)
    a, b = r.integers(-3, 4, (7, 9)) * r.integers(0, 2, (7, 9)), r.integers(-3, 4, (40, 9)) * r.integers(0, 2, (40, 9))
    assert (topk.accumulate(a, b) == a @ b.T).all()


# --- shingles -------------------------------------------------------------------------------------------------


def test_shingles_count_distinct_grams():
    for text in (None, "", "a", "a b c d e", "a b c d e f a b c d e f", " ".join(words(1, 5000, 20))):
        assert len(shingles(text)) == len(grams(text))
    assert set(shingles("a b c d e")) != set(shingles("a b c e d"))


@pytest.mark.parametrize(("block", "size"), [(2, 1 << 24), (192, 4_000), (3, 2_000)])
def test_links_over_many_blocks(spark, monkeypatch, block, size):
    """The same classes and links however few nodes or bytes a block holds, also where unlike texts are chained into one component."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
    r = random.Random(5)
    chain = [f"w{i}" for i in range(400)]
    # Windows of one chain: each is like its neighbours, the ends are unlike, and all are one component.
    texts = [" ".join(chain[i : i + 120]) for i in range(0, 260, 6)] + [" ".join(chain[:100] + [f"x{r.randrange(9)}"]) for _ in range(12)] + [" ".join(words(i, 90)) for i in range(10)]
    got = {x.doc_id: x for x in jaccard_join.jaccard_classes(table(spark, texts)).collect()}
    sets = [set(grams(t)) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8
    for i, a in enumerate(sets):
        assert got[i].n_links == sum(like(a, b) for j, b in enumerate(sets) if j != i), i
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if like(sets[i], sets[j])) for i in range(len(texts))]
    assert [got[i].class_id for i in range(len(texts))] == root
