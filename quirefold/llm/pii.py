"""Personal data: patterns propose spans, checksum validators confirm them, nearby context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.llm.common import bound_batches, map_arrow, tidy

#: Kinds in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "local_phone")
KINDS = BASE + EXTRA

# Each pattern is anchored so that a failed attempt is not repeated from inside the same run: time stays linear in the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Start of an IBAN, and the run of at most 30 signs behind it in which its end is looked for.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_RUN = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
ALNUM = re.compile(r"[A-Za-z0-9]")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")

#: Signs of an IBAN by country (fixed values).
IBAN_SIGNS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in codes.split()
}

#: Words that speak for a kind, and words that speak against every kind, looked for within NEAR code points.
NEAR = 40
#: In English, German, French and Spanish.
CONTEXT = {
    "email": "mail email e-mail contact write schreiben kontakt courriel adresse écrire correo contacto escribir",
    "ip": "ip host server address login adresse rechner serveur hôte servidor dirección",
    "card": "card visa credit payment pay karte kreditkarte zahlung zahlen carte crédit paiement payer tarjeta crédito pago pagar",
    "phone": "phone call tel mobile fax telefon anruf anrufen handy mobil rufnummer téléphone appel appeler portable teléfono llamar móvil llamada",
    "iban": "iban bank account transfer konto überweisung banque compte virement banco cuenta transferencia",
    "ssn": "ssn social security sozialversicherung sécurité sociale seguridad",
    "local_phone": "phone call tel mobile fax contact telefon anruf anrufen handy mobil rufnummer téléphone appel appeler portable teléfono llamar móvil llamada",
}
AGAINST = "version isbn sku order example bestellung beispiel commande exemple pedido ejemplo versión"
WORDS = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(v.split()) + r")(?![^\W\d_])") for k, v in {**CONTEXT, "": AGAINST}.items()}
#: Score of a confirmed span before its context: how much the pattern and the validator prove alone.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.5, "local_phone": 0.3}
ACCEPT = 0.5


@dataclass(frozen=True, order=True)
class Span:
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; found from each @ outwards, so a long run without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def ibans(text: str, at: int = 0) -> list[tuple[int, int]]:
    """Leftmost non-overlapping IBANs. What follows may look like more of one, so each end at a word edge is tried with mod-97.

    The one of the country's number of signs wins, else the longest. A start has at most 30 ends, so time stays linear in the text.
    """
    out = []
    while m := IBAN.search(text, at):
        at, start = m.end(), m.start()
        if run := IBAN_RUN.match(text, m.end()):
            signs = IBAN_SIGNS.get(text[start : start + 2])
            ends, n = [], 4
            for i in range(m.end(), run.end()):
                if text[i] == " ":
                    continue
                n += 1
                if n >= 15 and not ALNUM.match(text, i + 1):
                    ends.append((n == signs, i + 1))
            for _, end in sorted(ends, reverse=True):
                if mod97(text[start:end]):
                    out.append((start, end))
                    at = end
                    break
    return out


def _confirmed(kind: str, found: str) -> bool:
    digits = "".join(DIGIT.findall(found))
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def find(text: str | None) -> list[Span]:
    """All spans of one text, by start, then kind; a null or blank text has none.

    Base kinds stay whatever their score. Extra kinds need a score of at least ACCEPT and give way to base spans that
    they overlap.
    """
    if not text:
        return []
    digit = DIGIT.search(text)
    spans = {"email": emails(text) if "@" in text else []}
    if digit:
        for kind, p in (("ip", IP), ("card", CARD), ("phone", PHONE), ("ssn", SSN), ("local_phone", LOCAL_PHONE)):
            if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
                continue
            spans[kind] = [m.span() for m in p.finditer(text) if _confirmed(kind, m.group())]
        spans["iban"] = ibans(text, max(0, digit.start() - 4))
    out: list[Span] = []
    for kind in BASE:
        out += [Span(a, KINDS.index(kind), b, score(text, kind, a, b)) for a, b in spans.get(kind, ())]
    taken = sorted((s.start, s.end) for s in out)
    for kind in EXTRA:
        for a, b in spans.get(kind, ()):
            i = bisect_left(taken, (b,))
            near = taken[max(0, i - len(BASE)) : i]
            if (v := score(text, kind, a, b)) >= ACCEPT and not any(x < b and a < y for x, y in near):
                out.append(Span(a, KINDS.index(kind), b, v))
    return sorted(out)


def score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    v = PRIOR[kind] + 0.3 * bool(WORDS[kind].search(around)) - 0.3 * bool(WORDS[""].search(around))
    return min(1.0, max(0.0, v))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends, scores): arrays with one entry for each span, in code points, ends exclusive.

    No shuffle. Null doc_id and repeated rows stay; an empty table gives an empty table; other columns are left out.
    """

    def run(c: dict[str, list]) -> dict[str, list]:
        found = [find(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "kinds": [[s.kind for s in f] for f in found], "starts": [[s.start for s in f] for f in found], "ends": [[s.end for s in f] for f in found], "scores": [[s.score for s in f] for f in found]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>, scores array<double>")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest."""
    spans = sorted(find(text), key=lambda s: (s.start, -s.end))
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with masked texts, and n_chars, where docs has it, as the new text's length. No shuffle."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
        tidy()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    def run(c: dict[str, list]) -> dict[str, list]:
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")} | {"doc_id": c["doc_id"]}
        for text in c["text"]:
            spans = find(text)
            base = [s for s in spans if s.rank < len(BASE)]
            for i, kind in enumerate(BASE):
                out[f"n_{kind}"].append(sum(s.rank == i for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return map_arrow(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
