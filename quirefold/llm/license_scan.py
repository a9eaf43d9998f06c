"""License scans: a positional index of licence phrases by their rarest word, intersected with a file's postings.

The words of all phrases and templates are the licence vocabulary, of fixed size; their document frequencies are counted
over all documents. A file's postings hold the positions of its licence words alone. From the licence word of highest IDF on, the
index names the phrases of which that word is the rarest; their other words must stand at the same relative positions. A template
stands where all of its mandatory key phrases stand in its order, each within some words of its place; its coverage is the share
of its words, weighted by IDF, that stand near their places too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import map_arrow

#: Words by which a part of a template may have moved.
SLACK = 12
#: Share of a template's weight that must stand besides its key phrases.
COVERAGE = 0.5

# The base phrases.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Fixed values: (label, key phrases, text) of well-known public licences; a text of None is the key phrase itself.
TEMPLATES = [
    ("mit", ["permission is hereby granted free of charge to any person", "to deal in the software without restriction"],
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", ["permission to use copy modify and or distribute this software for any purpose", "with or without fee is hereby granted"],
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"],
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("zlib", ["this software is provided as is without any express or implied warranty", "in no event will the authors be held liable"],
     "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("apache-2.0", ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
     "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-or-later", ["it under the terms of the gnu general public license", "or at your option any later version"],
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", ["subject to the terms of the mozilla public license v 2 0"], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", ["free and unencumbered software released into the public domain"], "This is free and unencumbered software released into the public domain."),
    ("apache-2.0", ["apache license version 2 0"], None),
    ("gpl-2.0", ["gnu general public license version 2"], None),
    ("gpl-3.0", ["gnu general public license version 3"], None),
    ("lgpl", ["gnu lesser general public license"], None),
    ("agpl", ["gnu affero general public license"], None),
    ("mpl", ["mozilla public license"], None),
    ("epl", ["eclipse public license"], None),
    ("bsl-1.0", ["boost software license version 1 0"], None),
    ("artistic", ["artistic license"], None),
    ("bsd", ["bsd license"], None),
    ("cc-by", ["creative commons attribution"], None),
    ("cc-by-nc", ["cc by nc"], None),
    ("cc-by-sa", ["cc by sa"], None),
    ("cc-by-nd", ["cc by nd"], None),
    ("cc-by-nc", ["creative commons attribution noncommercial"], None),
    ("cc-by-sa", ["creative commons attribution sharealike"], None),
    ("cc0-1.0", ["cc0 1 0"], None),
    ("all-rights-reserved", ["all rights reserved"], None),
    ("mit", ["spdx license identifier mit"], None),
    ("apache-2.0", ["spdx license identifier apache 2 0"], None),
    ("gpl-2.0", ["spdx license identifier gpl 2 0"], None),
    ("gpl-3.0", ["spdx license identifier gpl 3 0"], None),
]

#: Digits, letters of ASCII (the large ones made small) and all bytes beyond it make words; all else parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, only A-Z made small; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def places(haystack: list[bytes], needle: list[bytes]) -> int:
    """Where the first run of the needle starts in a template's own words."""
    return next(i for i in range(len(haystack)) if haystack[i : i + len(needle)] == needle)


@dataclass
class Template:
    label: str
    base: bool
    text: list[bytes]
    keys: list[tuple[bytes, ...]]
    offsets: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.offsets = [places(self.text, list(k)) for k in self.keys]


def templates(base: list = BASE, more: list = TEMPLATES) -> list[Template]:
    return [Template(label, True, words(p), [tuple(words(p))]) for label, p in base] + [Template(label, False, words(text or keys[0]), [tuple(words(k)) for k in keys]) for label, keys, text in more]


class Index:
    """Phrases by their rarest word, with weights from document frequencies."""

    def __init__(self, known: list[Template], documents: int, frequency: dict[bytes, int]):
        self.known = known
        self.vocabulary = sorted({w for t in known for w in t.text})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.weight = np.array([math.log1p(documents / (1 + frequency.get(w, 0))) for w in self.vocabulary])
        self.rank = [int(x) for x in np.argsort(np.lexsort((np.arange(len(self.weight)), -self.weight)))]  # 0: highest IDF
        self.by_rarest: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for phrase in {k for t in known for k in t.keys}:
            ids = tuple(self.number[w] for w in phrase)
            rarest = min(range(len(ids)), key=lambda j: (self.rank[ids[j]], j))  # noqa: B023
            self.by_rarest.setdefault(ids[rarest], []).append((ids, rarest))
        self.keys = [[tuple(self.number[w] for w in k) for k in t.keys] for t in known]
        self.texts = [np.array([self.number[w] for w in t.text]) for t in known]

    def postings(self, file: list[bytes]) -> dict[int, np.ndarray]:
        """Positions of a file's licence words."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in file), np.int32, len(file))
        at = np.flatnonzero(ids >= 0)
        order = at[np.argsort(ids[at], kind="stable")]
        kinds, first = np.unique(ids[order], return_index=True)
        return dict(zip(kinds.tolist(), np.split(order, first[1:]), strict=True)) if len(at) else {}

    def standing(self, posts: dict[int, np.ndarray]) -> dict[tuple[int, ...], np.ndarray]:
        """All starts of each phrase that stands in the file, from the file's licence word of highest IDF on."""
        out = {}
        for rare in sorted(posts, key=self.rank.__getitem__):
            for phrase, j in self.by_rarest.get(rare, ()):
                starts = posts[rare] - j
                # Rare words first: they leave the fewest places.
                for k in sorted(range(len(phrase)), key=lambda k: self.rank[phrase[k]]):  # noqa: B023
                    if k != j and len(starts):
                        starts = np.intersect1d(starts, posts.get(phrase[k], starts[:0]) - k, assume_unique=True)
                if len(starts):
                    out[phrase] = starts
        return out

    def coverage(self, t: int, starts: np.ndarray, posts: dict[int, np.ndarray]) -> np.ndarray:
        """Of each start of template t, the weighted share of its words that stand within SLACK of their places."""
        got = np.zeros(len(starts))
        for o, w in enumerate(self.texts[t].tolist()):
            where = posts.get(w)
            if where is not None:
                i = np.searchsorted(where, starts + o - SLACK)
                got += self.weight[w] * (where[np.minimum(i, len(where) - 1)] <= starts + o + SLACK) * (i < len(where))
        return got / self.weight[self.texts[t]].sum()

    def scan(self, file: list[bytes]) -> tuple[list[tuple[str, bool, int, int, float]], float]:
        """All places (label, base, start, words, coverage) in order, and the score."""
        posts = self.postings(file)
        standing = self.standing(posts)
        out, score = [], 0.0
        for t, keys in enumerate(self.keys if standing else []):
            found = [standing.get(k) for k in keys]
            if found[0] is None:
                continue
            starts, met = found[0] - self.known[t].offsets[0], np.ones(len(found[0]), bool)
            if len(self.texts[t]) == len(keys[0]):
                cover = np.ones(len(starts))
            else:
                cover = self.coverage(t, starts, posts)
                for k, o in zip(found[1:], self.known[t].offsets[1:], strict=True):
                    k = k if k is not None else np.zeros(0, np.int64)
                    i = np.searchsorted(k, starts + o - SLACK)
                    met &= (i < len(k)) & (np.append(k, -1)[i] <= starts + o + SLACK)
                met &= cover >= COVERAGE
            score = max(score, float(np.where(met, cover, cover / 2).max()))
            out += [(self.known[t].label, self.known[t].base, int(s) + self.known[t].offsets[0], len(self.texts[t]), float(c)) for s, c in zip(starts[met], cover[met], strict=True)]
        return sorted(out, key=lambda x: (x[2], x[0], x[3], not x[1])), min(1.0, score)


def learn(docs: DataFrame, known: list[Template] | None = None) -> Index:
    """An index with the document frequencies of the licence vocabulary over all documents; what comes to the driver is one number a word."""
    known = templates() if known is None else known
    vocabulary = frozenset(w for t in known for w in t.text)

    def count(cols: dict[str, list]) -> dict[str, list]:
        seen: dict[bytes, int] = {}
        for text in cols["text"]:
            for w in vocabulary.intersection(words(text)):
                seen[w] = seen.get(w, 0) + 1
        return {"word": [None, *seen], "n": [len(cols["text"]), *seen.values()]}

    rows = map_arrow(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = {None if r.word is None else bytes(r.word): r.n for r in rows}
    return Index(known, total.pop(None, 0), total)


def scan_licenses(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, places array<struct<label, base, start, words, coverage>>, score) of every row of docs (doc_id, text).

    places are all places of all phrases and templates, in order of their first key phrase; score, from 0 to 1, is the largest
    coverage (a base phrase or single phrase has 1), halved where key phrases are missing. Null or blank texts have no words, no place and
    score 0. Rows repeat as often as they stand in docs; null ids pass; very long texts are read whole, in one task each.
    Other columns are not read.
    """
    index = learn(docs) if index is None else index

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "label", "base", "start", "words", "coverage", "score")}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            file = words(text)
            found, score = index.scan(file)
            parts = list(zip(*found, strict=True)) or [()] * 5
            for k, v in zip(out, (doc_id, len(file), list(parts[0]), [int(b) for b in parts[1]], list(parts[2]), list(parts[3]), list(parts[4]), score), strict=True):
                out[k].append(v)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flat = map_arrow(rows, run, "doc_id long, n_words long, label array<string>, base array<long>, start array<long>, words array<long>, coverage array<double>, score double")
    zipped = F.transform(F.arrays_zip("label", "base", "start", "words", "coverage"), lambda x: F.struct(x.label.alias("label"), (x.base == 1).alias("base"), x.start.alias("start"), x.words.alias("words"), x.coverage.alias("coverage")))
    return flat.select("doc_id", "n_words", zipped.alias("places"), "score")


def op12(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("places", lambda x: x.base)
    starts = F.transform(base, lambda x: x.start)
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"), "score",
    )
