"""The pipeline's stages, one after the other, against brute force."""

from collections import Counter

import numpy as np
import pytest

from quirefold.llm import bpe, mixing, pii, toxicity
from tests.llm.test_llm import brute_classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "personal_data", "mixing", "bpe"]

    # A scorer in one process over all rows, with the fitted weights.
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    r = toxicity.Restorer(model.chars, set(model.names))
    clean = {x.doc_id: x.text for x in docs.collect() if model.score(r.count(x.text)) < toxicity.THRESHOLD}
    docs = stages["toxicity"](spark, docs, SF).cache()
    assert docs.columns == columns and {x.doc_id: x.text for x in docs.collect()} == clean

    first = {d for d, c, _ in brute_classes(list(clean.items())) if d == c}
    docs = stages["jaccard_join"](spark, docs, SF).cache()
    assert docs.columns == columns and sorted(x.doc_id for x in docs.collect()) == sorted(first)

    docs = stages["personal_data"](spark, docs, SF).cache()
    texts = {d: pii.masked(clean[d]) for d in first}
    assert docs.columns == columns and {x.doc_id: (x.text, x.n_chars) for x in docs.collect()} == {d: (t, len(t)) for d, t in texts.items()}

    sizes = {x.doc_id: (x.source, len([w for w in x.text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w])) for x in docs.collect()}
    slim = spark.createDataFrame([(d, s, n) for d, (s, n) in sizes.items()], "doc_id long, source string, size long")
    want = Counter({x.doc_id: x.copies for x in mixing.mix_sizes(slim).collect() if x.copies})
    docs = stages["mixing"](spark, docs, SF).cache()
    assert docs.columns == columns and Counter(x.doc_id for x in docs.collect()) == want

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    ids = {d: np.array(lib.encode(texts[d], add_special_tokens=False).ids, "<u4").tobytes() for d in want}
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((x.doc_id, bytes(x.ids)) for x in got) == Counter({(d, ids[d]): n for d, n in want.items()})


ODD = "doc_id long, source string, lang string, text string, n_chars int, node string, key string, root string, row string, label string"


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, null and blank texts, a very long text, and columns with names that the stages use inside."""
    from pathlib import Path

    t = "the garden of the house is old and the people are kind to all of them each day of the year"
    texts = [(1, t), (2, t), (3, None), (4, ""), (5, "word " * 60_000), (6, "another text of that id"), (6, "a second text of that id"), (6, "a second text of that id"), (None, "a text without an id at all"), (7, "mail a@b.co to the old house")]
    rows = [(i, None if i == 7 else "s", "en", x, len(x or ""), "n", "k", "r", "w", "l") for i, x in texts]
    spark.createDataFrame(rows, ODD).coalesce(1).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a").cache()
        assert docs.columns == [c.split()[0] for c in ODD.split(", ")], name
        seen.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    assert seen[0] == Counter(texts)
    # One of the two rows of the same text stays; repeated rows of an id are one; the row without an id stays.
    assert {k for k, _ in seen[1]} == {1, 3, 4, 5, 6, 7, None} and seen[1][6, "a second text of that id"] <= 1 and sum(n for (k, _), n in seen[1].items() if k == 1) == 1
    assert (7, "mail [email] to the old house") in seen[2] and set(seen[3]) <= set(seen[2])
    before = {p.name for p in Path(corpus_pipeline.shared_folder(spark).removeprefix("file:")).glob("corpus-*")}
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: sum(n for (i, _), n in seen[3].items() if i == k) for k in {i for i, _ in seen[3]}})
    (folder,) = [p for p in Path(corpus_pipeline.shared_folder(spark).removeprefix("file:")).glob("corpus-*") if p.name not in before]
    assert [p.name for p in folder.iterdir()] == ["mixing"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
