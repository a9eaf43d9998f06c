"""Toxicity: Viterbi decoding of character lattices under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import MEMO_WORDS, bound_batches, map_arrow, tidy
from quirefold.llm.language_id import held_out

#: Labelled documents that the scorer is fitted on, at about this number; and the features that it may use.
SAMPLE = 12_000
FEATURES = 600
THRESHOLD = 0.3
#: Features that a task counts before it hands on the sums.
TALLY = 200_000
RIDGE = 0.3

#: Letters that a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "*": "aeiou", "@": "a", "$": "s", "!": "i", "|": "il", "(": "c", "<": "c", "+": "t", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: Natural logarithms of what the channel does to a letter.
KEEP, SWAP, NOISE, AFTER, REPEAT, DOUBLE = -0.05, -1.5, -4.0, -0.5, -0.4, -3.0

#: The language model's alphabet: gap, a-z, the lower-case letters of Latin-1, and one place for every other letter.
ALPHABET = " abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
WIDTH = 64
PLACE = {c: i for i, c in enumerate(ALPHABET)}
OTHER = len(ALPHABET)

WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){3,}(?!\S)")
#: A stretch without white space is decoded if a sign or digit stands among or before its letters, or a letter stands three times.
MIXED = re.compile(r"[^\w\s,;:'’\"()\[\]-][^\W\d_]|[^\W\d_][\d_]|\d[^\W\d_]|([^\W\d_])\1\1|(?:[^\W\d_][\W_]){2}", re.I)

#: Stretches that may hold obfuscation without such signs: letters told twice, hyphens between letters.
DOUBLED = re.compile(r"([^\W\d_])\1|[^\W\d_]-+[^\W\d_]", re.I)
#: What parts the pieces of a stretch: signs that stand for no letter.
PARTS = re.compile(rf"(?:(?![{re.escape(''.join(LEET))}])[\W_])+")
SIGNS = frozenset(LEET)
RUN = re.compile(r"(.)\1+", re.S)
#: Signs that stand for no letter and change nothing at a stretch's ends.
OUTER = ".,;:'’\"[]{}?-–—…_/\\«»“”„"


def _table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = PLACE.get(c, OTHER)
    return out


_PLACES: list[np.ndarray] = []


def trigrams(text: str | None) -> np.ndarray | None:
    """Counts of letter trigrams, gaps run together, of a whole text."""
    if not text:
        return None
    if not _PLACES:
        _PLACES.append(_table())
    c = _PLACES[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    c = np.concatenate([[0, 0], c[keep], [0]]).astype(np.int32)
    return (c[:-2] * WIDTH + c[1:-1]) * WIDTH + c[2:]


class CharModel:
    """Interpolated trigram model of letters; score(a, b, c) is log P(c | a, b)."""

    def __init__(self, three: np.ndarray):
        n3 = three.reshape(WIDTH, WIDTH, WIDTH).astype(np.float64)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1 + 1).sum()
        p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)

    @classmethod
    def fit(cls, docs: DataFrame) -> CharModel:
        """Counts over all texts, summed in Spark; the table has WIDTH ** 3 places whatever the input's size."""
        bound_batches(docs.sparkSession)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(WIDTH**3, np.int64)
            for batch in batches:
                held, n = [], 0
                for text in batch.column(0).to_pylist():
                    if (t := trigrams(text)) is not None:
                        held.append(t)
                        n += len(t)
                    if n > 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=WIDTH**3)
                        held, n = [], 0
                if held:
                    total += np.bincount(np.concatenate(held), minlength=WIDTH**3)
            at = np.flatnonzero(total)
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

        rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(WIDTH**3, np.int64)
        total[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        return cls(total)


class Decoder:
    """Restores one obfuscated stretch: the most probable letters behind it, by Viterbi over its lattice.

    A sign is a letter that it may stand for, or noise and dropped, at little cost after the letters; a letter is itself; a letter after the same letter may
    be a mere repetition; a gap between single letters is dropped. States are the last two letters that were kept.
    """

    def __init__(self, model: CharModel):
        self.lm = model.log.tolist()

    def __call__(self, stretch: str, noise: bool = True) -> str:
        """The best path; noise: signs that may stand for a letter may be dropped all the same."""
        lm, stretch = self.lm, stretch.lower()
        if SIGNS.isdisjoint(stretch):
            return self.thinned("".join(filter(str.isalpha, stretch)))
        inner = range(*_inside(stretch))
        # (letter before last, last letter, place of the sign before): (score, letters as a linked list)
        beam: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for place, c in enumerate(stretch):
            drop = KEEP if c.isspace() else AFTER if place not in inner or not (c in LEET or c.isdigit()) else NOISE
            nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            options = [(c, KEEP)] if c.isalpha() else [(x, SWAP) for x in LEET.get(c, "")]
            for (a, b, seen), (s, path) in beam.items():
                moves = []
                for x, cost in options:
                    i = PLACE.get(x, OTHER)
                    again = x == seen
                    moves.append(((b, i, x), s + cost + (DOUBLE if again else 0.0) + lm[a][b][i], (path, x)))
                    if again:
                        moves.append(((a, b, seen), s + REPEAT, path))
                if not c.isalpha() and (noise or not options):
                    moves.append(((a, b, seen), s + drop, path))
                for key, score, p in moves:
                    if key not in nxt or nxt[key][0] < score:
                        nxt[key] = (score, p)
            beam = nxt
        path = max(((s + lm[a][b][0], p) for (a, b, _), (s, p) in beam.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(out[::-1])


    def thinned(self, letters: str) -> str:
        """The best path of mere letters: how often each run of one letter is kept.

        A run keeps at least one letter and the model looks back two, so no run's choice bears on another's, and the score is
        linear in the number kept from two on: one, two or all are the only candidates.
        """
        lm = self.lm

        def kept(m: re.Match) -> str:
            x, n = m[1], m.end() - m.start()
            q = PLACE.get(letters[m.start() - 1], OTHER) if m.start() else 0
            r = PLACE.get(letters[m.end()], OTHER) if m.end() < len(letters) else 0
            i = PLACE.get(x, OTHER)
            first, last, more = lm[q][i][i], lm[i][i][r], KEEP + DOUBLE
            one = (n - 1) * REPEAT + lm[q][i][r]
            two = (n - 2) * REPEAT + more + first + last
            every = (n - 1) * more + first + (n - 2) * lm[i][i][i] + last
            return x if one >= max(two, every) else x * n if every > two else x * 2

        return RUN.sub(kept, letters)


def _inside(stretch: str) -> tuple[int, int]:
    """From the start to behind the last letter; signs after that are mostly marks of their own."""
    return 0, max((i + 1 for i, c in enumerate(stretch) if c.isalpha()), default=0)


def features_of(word: str) -> list[str]:
    """Features of a restored word: itself, and its first letters."""
    return [f"={word}"] + [f"{n}{word[:n]}" for n in (5, 6) if len(word) > n]


class Restorer(dict):
    """Features of whole texts after restoration; lower-case stretches met before in this task are looked up, up to a bound."""

    def __init__(self, model: CharModel, wanted: set[str] | None = None):
        super().__init__()
        self.decode = Decoder(model)
        self.wanted = wanted

    def words(self, chunk: str) -> list[str]:
        """Words of a stretch as they stand; of one that may be obfuscated also the readings of the whole and of its pieces."""
        chunk = chunk.lower()
        if chunk.isalpha():
            read = self.decode.thinned(chunk)
            return [chunk] if read == chunk else [chunk, read]
        plain = WORD.findall(chunk)
        if not MIXED.search(chunk) and not DOUBLED.search(chunk):
            return plain
        pieces = [p for p in PARTS.split(chunk) if MIXED.search(p) or DOUBLED.search(p)]
        readings = dict.fromkeys(w for c in dict.fromkeys([chunk, *pieces]) for w in self.readings(c))
        return plain + [w for w in readings if w and w not in plain]

    def readings(self, stretch: str) -> list[str]:
        """The most probable reading, and the one in which every sign that may be a letter is one."""
        return [self.decode(stretch)] if SIGNS.isdisjoint(stretch) else [self.decode(stretch), self.decode(stretch, noise=False)]

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        """Wanted features of a lower-case stretch."""
        core = chunk.strip(OUTER)
        if core != chunk and core in self:
            got = self[core]
        else:
            got = tuple(f for w in self.words(core) for f in features_of(w))
            if self.wanted is not None:
                got = tuple(f for f in got if f in self.wanted)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[chunk] = got
        return got

    def spaced(self, text: str) -> list[str]:
        """Features in restored runs of single letters, whose words have no known ends."""
        out = []
        for m in SPACED.finditer(text):
            run = self.decode(m.group())
            for n in range(3, min(16, len(run)) + 1):
                out += [f"={run[i : i + n]}" for i in range(len(run) - n + 1) if self.wanted is None or f"={run[i : i + n]}" in self.wanted]
        return out

    def count(self, text: str | None) -> Counter:
        """How often the text has each (wanted) feature."""
        if not text:
            return Counter()
        out = Counter(chain.from_iterable(filter(None, map(self.__getitem__, text.lower().split()))))
        if SPACED.search(text):
            out.update(self.spaced(text))
        return out

    def restore(self, text: str | None) -> str:
        """The whole text with obfuscated stretches restored, for reading."""
        text = SPACED.sub(lambda m: self.decode(m.group()), text or "")
        return re.sub(r"\S+", lambda m: self.decode(m.group()) if MIXED.search(m.group()) else m.group(), text)


@dataclass(frozen=True)
class Scorer:
    chars: CharModel
    names: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def score(self, found: Counter) -> float:
        at = {n: i for i, n in enumerate(self.names)} if not hasattr(self, "_at") else self._at
        object.__setattr__(self, "_at", at)
        z = self.bias + sum(float(self.weights[at[f]]) * math.log1p(n) for f, n in found.items() if f in at)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton's method."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    pen = np.full(len(w), ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pen), x1.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about `sample` labelled documents that may be learned from, chosen by a hash of doc_id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    n = known.count()
    part = min(1.0, sample / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(part * (1 << 20)))
    chosen = chosen.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(2 * sample)
    # At most 2 * sample rows of two numbers; rows that share a doc_id are one row, of the smallest of their texts.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), (F.max("toxic") == 1).cast("int").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Scorer:
    """The language model from all texts; features and weights from a bounded sample of labelled rows, chosen by doc_id.

    A feature is used if it tells the classes apart by its document counts (signed chi-square); ties go by name.
    Without labelled rows the score is the same small number everywhere.
    """
    chars = CharModel.fit(docs)
    rows = labelled(docs, labels, sample)

    def sums_of(n: Counter, bad: Counter) -> pa.RecordBatch:
        names = list(n)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[k] for k in names], pa.int64()), pa.array([bad[k] for k in names], pa.int64())], names=["feature", "n", "bad"])

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = Counter(), Counter()
        restorer = Restorer(chars)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [*restorer.count(text), ""]
                n.update(found)
                if toxic:
                    bad.update(found)
                if len(n) > TALLY:
                    yield sums_of(n, bad)
                    n.clear(), bad.clear(), restorer.clear()
        yield sums_of(n, bad)
        tidy()

    sums = rows.mapInArrow(tally, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = sums.cache()
    every = sums.where("feature = ''").first()
    if every is None or not every.bad or every.bad == every.n:
        sums.unpersist()
        return Scorer(chars, (), np.zeros(0), math.log((every.bad + 0.5) / (every.n - every.bad + 0.5)) if every else -3.0)
    total, share = float(every.n), every.bad / every.n
    lead = F.col("bad") - F.col("n") * F.lit(share)
    z = lead / F.sqrt(F.col("n") * F.lit(share * (1 - share)) * (1 - F.col("n") / F.lit(total)) + F.lit(0.5))
    top = sums.where("feature <> '' AND bad >= 3").select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(features).collect()
    sums.unpersist()
    names = tuple(r.feature for r in top if r.z > 2)
    if not names:
        return Scorer(chars, (), np.zeros(0), math.log(share / (1 - share)))
    wanted = set(names)

    def vectors(c: dict[str, list]) -> dict[str, list]:
        restorer, at = Restorer(chars, wanted), {n: i for i, n in enumerate(names)}
        found = [restorer.count(t) for t in c["text"]]
        return {"toxic": c["toxic"], "at": [[at[k] for k in f] for f in found], "n": [[f[k] for k in f] for f in found]}

    got = map_arrow(rows, vectors, "toxic int, at array<long>, n array<long>").toPandas()
    x = np.zeros((len(got), len(names)))
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[i, np.asarray(at, np.int64)] = np.log1p(np.asarray(n, np.float64))
    w, b = logistic(x, got["toxic"].to_numpy(np.float64))
    return Scorer(chars, names, w, b)


def score_documents(docs: DataFrame, model: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text alone.

    Null and blank texts get the score of a text without features. Repeated rows, null and repeated doc_id stay, each with its
    own text's score; a very long text takes time in proportion to its length; an empty table gives an empty one; other
    columns play no part.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by WIDTH ** 3 and FEATURES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.chars, set(m.names))
        for batch in batches:
            scores = [m.score(restorer.count(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])
        tidy()

    bound_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; a score at the threshold goes. No shuffle. Null texts, repeated rows and an empty table are kept as they are scored."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer, at = Restorer(m.chars, set(m.names)), names.index("text")
        for batch in batches:
            keep = [m.score(restorer.count(t)) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        tidy()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_documents(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
