"""BPE encoding and decoding with a public word-level vocabulary, by depth-first traversal of a trie of distinct words.

The encoding of a prefix determines all that a longer word needs from it: the last token. For the words of a batch a trie
is built, and each node gets, once, the last token of the encoding of the path to it: the longest vocabulary token that ends there
and that BPE would leave standing beside the last token of what precedes it. Words that share a prefix share its states.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quirefold.llm.common import map_arrow

SPACE = regex.compile(r"\s")
#: Stands for the end-of-word suffix inside this module, so that a word end is one letter.
MARK = "\n"
NEVER = 1 << 60
#: The pre-tokenizer's pattern that Vocabulary.words finds by kinds of signs, and its contractions: an apostrophe inside a run of signs starts none.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = regex.compile(r"(?<![^\s\p{L}\p{N}])'(?:s|t|re|ve|m|ll|d)")
#: Words that each of a worker's two generations remembers.
WORDS_KEPT = 3 << 16
#: Steps of tries and pairs of tokens that a worker remembers.
STEPS_KEPT, PAIRS_KEPT = 1 << 16, 1 << 17


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Of each code point: 0 for white space, 1 for letters, 2 for numbers, 3 for all other signs."""
    out = np.full(0x110000, 3, np.uint8)
    # Surrogates, which stand for nothing here, are such signs.
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, signs in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(signs, every):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = 3
    return out


class Vocabulary:
    """Ids, merge ranks, specials and the pre-tokenizer's pattern, as the tokenizer file states them."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        # Each id's token with a space after it; ids are few beyond the number of tokens.
        self.texts = pa.array([self.tokens.get(i, "").encode() + b" " for i in range(max(self.tokens) + 1)], pa.large_binary())
        end = model["end_of_word_suffix"]
        mark = lambda t: t[: -len(end)] + MARK if t.endswith(end) else t
        self.of = {mark(t): (i, t) for t, i in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(mark(a), mark(b)): i for i, (a, b) in enumerate(merges)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.letters = byte_letters()
        self.whole = {t for t in self.of if self.merge(self.symbols(t)) == [t]}
        self.starts = {t[:i] for t in self.whole for i in range(len(t))}
        self.steps: dict[str, tuple] = {}
        self.pairs: dict[str, dict[str | None, bool]] = {}
        self.n_pairs = 0
        self.ends: dict[str, tuple] = {}

    def symbols(self, token: str) -> list[str]:
        out = list(token)
        if len(out) > 1 and out[-1] == MARK:
            out[-2:] = [out[-2] + MARK]
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked pair, leftmost first, until none is left."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """The pieces at the token's left and right end while it is merged, each with the rank of the merge that ends it."""
        if token not in self.ends:
            if len(self.ends) >= 1 << 14:
                self.ends.clear()
            parts, left, right = self.symbols(token), [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.ends[token] = ([*left, (parts[0], NEVER)], [*right, (parts[0], NEVER)])
        return self.ends[token]

    def stand(self, left: str | None, right: str) -> bool:
        """Whether BPE leaves the two tokens as they are side by side. No token (None) stands beside each.

        Ranks rise while BPE merges, as a merge's parts are made by earlier ones. So the two tokens grow together if some
        piece at the left one's end and some piece at the right one's start have a merge of lower rank than what ends
        either piece (of equal rank: if it stands further left).
        """
        beside = self.pairs.setdefault(right, {})
        if (known := beside.get(left)) is None:
            if self.n_pairs >= PAIRS_KEPT:
                self.forget_pairs()
            self.n_pairs += 1
            known = beside[left] = left is None or self._stand(self.edges(left)[1], self.edges(right)[0])
        return known

    def _stand(self, ends: list[tuple[str, int]], starts: list[tuple[str, int]]) -> bool:
        rank = self.ranks.get
        for a, ea in ends:
            for b, eb in starts:
                if (r := rank((a, b))) is not None and r < ea and r <= eb:
                    return False
        return True

    def forget_pairs(self) -> None:
        # Steps hold these tables too, so they are emptied, not replaced.
        for beside in self.pairs.values():
            beside.clear()
        self.n_pairs = 0

    def step(self, state: str, letter: str) -> tuple[str, list[tuple[int, str, dict, int]]]:
        """The state after one more letter, and (letters, token, what is known of tokens before it, id) of the tokens that end with it, longest first.

        A path's state is its longest end that some token starts with, so all tokens that end with the next letter end
        in state + letter.
        """
        key = state + letter
        if (known := self.steps.get(key)) is None:
            if len(self.steps) >= STEPS_KEPT:
                self.steps.clear()
            tails = [key[i:] for i in range(len(key))]
            after = next((t for t in tails if t in self.starts), "")
            known = self.steps[key] = (after, [(len(t) - (t[-1] == MARK), t, self.pairs.setdefault(t, {}), self.of[t][0]) for t in tails if t in self.whole])
        return known

    def words(self, text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the words of a normalised text; codes: its code points."""
        if self.pattern.pattern != WORDS:
            stretches = regex.finditer(r"\S+", text)
            spans = np.array([(s.start() + m.start(), s.start() + m.end()) for s in stretches for m in self.pattern.finditer(s.group())], np.int64).reshape(-1, 2)
            return spans[:, 0], spans[:, 1]
        kind = kinds()[codes]
        # A word ends where the kind changes; a number is a word by itself.
        ends = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        if "'" in text:
            for m in CONTRACTIONS.finditer(text):
                ends[m.start()] = False
                ends[m.end() - 1 : m.end()] = True
        ends = np.append(np.flatnonzero(ends) + 1, len(kind))[: len(kind)]
        starts = np.append(0, ends[:-1])[: len(kind)]
        full = kind[starts] > 0
        return starts[full], ends[full]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Trie:
    """Encodes a set of distinct words (in letters of bytes) by one depth-first walk over their trie."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids of its tokens), in the order of words. Letters that the vocabulary lacks are left out, as the library does without an unknown token.

        The walk visits the words in order, so that a word's path starts with the part that it shares with the word
        before; last[i] is the last token of the path's first i letters, as step gives it, and is kept for all words below
        that node, as is states[i], by which the vocabulary tells the tokens that may end at the next letter.
        """
        v = self.v
        known, step, stand = v.steps.get, v.step, v.stand
        nothing = (1, None, {}, None)
        last, states = [nothing], [""]
        before = ""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(len(before), n) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            before, state = word, states[-1]
            for i in range(len(last), n + 1):
                letter = word[i - 1] if i < n else word[-1] + MARK
                state, ends = known(state + letter) or step(state, letter)
                for end in ends:
                    left = last[i - end[0]][1]
                    if (stands := end[2].get(left)) or (stands is None and stand(left, end[1])):
                        break
                else:
                    end = nothing
                last.append(end)
                states.append(state)
            ids, i = [], n
            while i > 0:
                end = last[i]
                if end is not nothing:
                    ids.append(end[3])
                i -= end[0]
            yield word, ids[::-1]
            # A longer word goes on below the last letter without the mark.
            last.pop()
            states.pop()


class Recent:
    """A lookup table of bounded size: two generations, of which the older one is dropped when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def lacks(self, keys: list[bytes]) -> list[bytes]:
        """The keys without a value; those of the older generation move to the younger one."""
        if len(self.young) + len(keys) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [k for k in keys if k not in young]
        for k in new:
            if k in old:
                young[k] = old.pop(k)
        return [k for k in new if k not in young]


class Encoder:
    """Whole texts to ids and back. Words that this Python worker met before are looked up."""

    #: Code points of the texts that are taken together.
    SIGNS = 1 << 20

    def __init__(self, path: str):
        self.path, self.v = path, vocabulary(path)
        self.words = Recent(WORDS_KEPT)

    @property
    def chunks(self) -> Recent:
        """What is looked up of a text are its words: the stretches between white space have no table besides."""
        return self.words

    def forget(self) -> None:
        """Frees the lookup tables: a Python worker lives on for other operators' tasks."""
        self.words = Recent(self.words.most)
        self.v.steps.clear()
        self.v.pairs.clear()
        self.v.n_pairs = 0
        self.v.ends.clear()

    def parts(self, text: str | None) -> list[tuple[str, bool]]:
        """The text's special tokens (True) and what stands between them, cut before white space where it is very long."""
        special, out = self.v.special, []
        for i, p in enumerate(special.split(text) if text and special and "<|" in text else [text or ""]):
            at = 0
            while i % 2 == 0 and len(p) - at > self.SIGNS and (m := SPACE.search(p, at + self.SIGNS)):
                out.append((p[at : m.start()], False))
                at = m.start()
            out.append((p[at:], i % 2 == 1))
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: no rule for a final sigma.
        return "".join(ch.lower() for ch in text) if "\u03a3" in text else text.lower()

    def spell(self, word: bytes) -> str:
        """The word in letters of bytes."""
        if word.isascii() and (w := word.decode()).isprintable():
            return w
        letters = self.v.letters
        return "".join([letters[b] for b in word])

    def learn(self, words: list[bytes]) -> None:
        spelled = {self.spell(w): w for w in self.words.lacks(words)}
        known = self.words.young
        for w, ids in Trie(self.v).encode(spelled):
            known[spelled[w]] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        return list(self.each(texts))

    def each(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """What encode returns, text by text, so that not all of it need be held."""
        whole = lambda raw, text: (b"".join(raw), b"".join(text)[:-1].decode())
        raw, text, at = [], [], 0
        for held in self.held(texts):
            for (i, _, _), (ids, decoded) in zip(held, self._encode(held), strict=True):
                if i > at:
                    yield whole(raw, text)
                    raw, text, at = [], [], i
                raw.append(ids)
                text.append(decoded)
        if texts:
            yield whole(raw, text)

    def held(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, bool]]]:
        """(number of the text, part, whether it is a special token) of all parts, so many at a time as are taken together."""
        held, signs = [], 0
        for i, text in enumerate(texts):
            for p, special in self.parts(text):
                if signs and signs + len(p) > self.SIGNS:
                    yield held
                    held, signs = [], 0
                held.append((i, p, special))
                signs += len(p)
        if held:
            yield held

    def _encode(self, held: list[tuple[int, str, bool]]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded text, with a space after each token, of each part."""
        # A special token leaves an empty line, so that each part is one line.
        lines = ["" if special else self.normal(p) for _, p, special in held]
        text = "\n".join(lines)
        code, dtype = ("ascii", np.uint8) if text.isascii() else ("utf-32-le", np.uint32)
        codes = np.frombuffer(text.encode(code, "surrogatepass"), dtype)
        starts, ends = self.v.words(text, codes)
        first = np.searchsorted(starts, np.append(0, np.cumsum([len(x) + 1 for x in lines]))).tolist()
        # The words' bytes, of which Arrow finds the distinct ones.
        data = text.encode("utf-8", "surrogatepass")
        if dtype == np.uint32:
            sizes = np.ones(len(codes), np.uint8)
            for most in (0x7F, 0x7FF, 0xFFFF):
                sizes += codes > most
            at = np.append(0, np.cumsum(sizes, dtype=np.int64))
            starts, ends = at[starts], at[ends]
        # Words and what lies between them take turns.
        offsets = np.stack([starts, ends], 1).ravel().astype(np.int64)
        met = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(offsets) - 1), [None, pa.py_buffer(offsets), pa.py_buffer(data)])[::2].dictionary_encode()
        words = met.dictionary.to_pylist()
        self.learn(words)
        ids, at = joined(pa.array(map(self.words.young.__getitem__, words), pa.large_binary()).take(met.indices))
        tokens, token_at = joined(self.v.texts.take(pa.array(np.frombuffer(ids, "<u4"))))
        for j, (_, p, special) in enumerate(held):
            if special:
                yield pack("<I", self.v.specials[p]), p.encode() + b" "
            else:
                a, b = int(at[first[j]]), int(at[first[j + 1]])
                yield ids[a:b], tokens[token_at[a // 4] : token_at[b // 4]]


def joined(values: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values in a row, and where each value starts, with the last one's end."""
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(values) + 1]
    return memoryview(data)[: at[-1]], at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decode(ids: bytes | None, path: str) -> str:
    """Token strings joined by one space: the file names no decoder."""
    v = vocabulary(path)
    return " ".join(v.tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist())


def encode_documents(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ids (little-endian unsigned 32-bit) if asked.

    No shuffle: each task keeps its own remembered words and steps. Null texts have no ids, blank ones those of their white
    space, if any; repeated rows and null doc_id stay as they are; a very long text is one row of its batch, which bytes
    bound; an empty table gives an empty one; other columns are left out.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": c["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for raw, text in encoder(path).each(c["text"]):
            out["n_tokens"].append(len(raw) // 4)
            out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            if ids:
                out["ids"].append(raw)
        return out

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids, lambda: encoder(path).forget())


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows."""
    return map_arrow(encoded.select("doc_id", "ids"), lambda c: {"doc_id": c["doc_id"], "text": [decode(x, path) for x in c["ids"]]}, "doc_id long, text string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), ids=False)
