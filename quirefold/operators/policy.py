"""Policies over several recognizers: verification, switching, attribution of errors, choice of the best."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quirefold.functions.numbers import clamp
from quirefold.functions.text import casefold, collapse, fold_key, once, without_vietnamese_marks


def verified(primary: Column, verifier: Column) -> Column:
    """Whether a second reading agrees; the primary one is always kept."""
    p, v = collapse(primary), collapse(verifier)
    return F.when((p != "") & (p == v), "verified").otherwise("needs_review")


def switched(primary: Column, confidence: Column, second: Column, third: Column, least: float) -> tuple[Column, Column]:
    """(text, rule): two others that agree against the primary reading win; else at low confidence the third reading, if it differs."""
    p, s, t = (casefold(collapse(F.coalesce(x, F.lit("")))) for x in (primary, second, third))
    agree = (F.coalesce(second, F.lit("")) != "") & (s == t) & (s != p)
    low = (clamp(confidence) < least) & (F.coalesce(third, F.lit("")) != "") & (t != p)
    text = F.when(agree, second).when(low, third).otherwise(primary)
    return text, F.when(agree, "AGREEMENT").when(low, "LOW_CONFIDENCE").otherwise("UNCHANGED")


def root_cause(found: Column, candidates: Column, selected: Column, expected: Column, contaminated: Column) -> Column:
    """Why a field is wrong, in order: its region, the parser, the selection, the marks, the reading."""
    plain = lambda x: F.regexp_replace(without_vietnamese_marks(casefold(x)), r"\s+", "")
    return (
        F.when(~found, "ROI_MISS").when(selected == expected, "EXACT").when(contaminated, "PARSER_CONTAMINATION")
        .when(F.array_contains(candidates, expected), "SELECTOR_MISS")
        .when(F.exists(candidates, lambda c: plain(c) == plain(expected)), "DIACRITIC_MISS").otherwise("RECOGNIZER_MISS")
    )


def field_comparison(present: Column, expected: Column, predicted: Column, signals: Column) -> Column:
    """NOT_IN_SOURCE, EXACT, NOT_FOUND, DIACRITICS_ONLY, the first signal, or MISMATCH."""
    e, p = collapse(F.coalesce(expected, F.lit(""))), collapse(F.coalesce(predicted, F.lit("")))
    plain = lambda x: casefold(without_vietnamese_marks(x))
    return (
        F.when(~present, "NOT_IN_SOURCE").when(e == p, "EXACT").when(p == "", "NOT_FOUND").when(plain(e) == plain(p), "DIACRITICS_ONLY")
        .otherwise(F.coalesce(F.upper(F.get(signals, F.lit(0))), F.lit("MISMATCH")))
    )


def best_profile(metrics: DataFrame, profile: str, by: list[str] | None = None) -> DataFrame:
    """The profile of most exact matches, then lowest diacritic errors, then highest precision, then lowest p95, then name."""
    order = F.struct((-F.col("exact")).alias("a"), F.col("der").alias("b"), (-F.col("precision")).alias("c"), F.col("p95").alias("d"), F.col(profile).alias("e"))
    return metrics.groupBy(*(by or [])).agg(F.min_by(profile, order).alias(profile))


def error_shares(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, kind, n, share) of each error kind within its group."""
    n = rows.groupBy(by, kind).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


#: Phrase correction (fixed values): least likeness, least lead over the second, least length of a text that is compared.
LIKENESS, LEAD, COMPARED = 0.84, 0.08, 6


def corrected(rows: DataFrame, text: str, phrases: dict[str, str], out: str = "corrected", least: float = LIKENESS, lead: float = LEAD, shortest: int = COMPARED) -> DataFrame:
    """Adds the phrase of a dictionary (folded key to phrase) that a text is, or is clearly likest, in the text's own capitals; else the text.

    A key can only reach a likeness r if its edit distance is at most (1 - r) times both lengths, so Spark rules most keys
    out first, and only texts with a key left are compared in Python. Texts with a digit or an at-sign stay.
    """
    keys = F.array(*map(F.lit, phrases))
    table = F.create_map(*(F.lit(x) for kv in phrases.items() for x in kv))
    reach = 1 - (least - lead)

    def choice(f: Column) -> Column:
        close = F.filter(keys, lambda k: F.levenshtein(k, f) <= reach * (F.length(k) + F.length(f)))
        worth = ~F.array_contains(keys, f) & (F.length(f) >= shortest)
        return F.struct(f.alias("folded"), F.when(worth & (F.size(close) > 0), close).alias("close"))

    t = F.col(text)
    rows = rows.withColumn("_c", once(fold_key(t), choice)).withColumn("_r", likeness(F.col("_c.folded"), F.col("_c.close")))
    ranked = F.array_sort(F.zip_with("_r", "_c.close", lambda r, k: F.struct((-r).alias("r"), k.alias("k"))))
    pick = once(ranked, lambda x: F.when((-x[0]["r"] >= least) & (-x[0]["r"] + F.coalesce(F.get(x, F.lit(1))["r"], F.lit(0.0)) >= lead), x[0]["k"]))
    rows = rows.withColumn("_k", F.when(~t.rlike("[0-9@]"), F.element_at(table, F.when(F.array_contains(keys, F.col("_c.folded")), F.col("_c.folded")).otherwise(pick))))
    found, first = F.col("_k"), F.substring(t, 1, 1)
    small = F.concat(F.lower(F.substring(found, 1, 1)), F.substr(found, F.lit(2)))
    return rows.withColumn(out, F.coalesce(F.when(t == F.upper(t), F.upper(found)).when(first == F.lower(first), small).otherwise(found), t)).drop("_c", "_r", "_k")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def likeness(text: pd.Series, keys: pd.Series) -> pd.Series:
    """Match ratio of a text with each of its few keys; null where there are none."""
    from difflib import SequenceMatcher

    return pd.Series([None if ks is None else [SequenceMatcher(None, t, k).ratio() for k in ks] for t, ks in zip(text, keys, strict=True)], dtype=object)


def mismatch_cause(expected: Column, predicted: Column, found: Column, signals: Column) -> Column:
    """Why a field's text differs, in order: no value, only case or spacing, only marks, only punctuation, text missing or added, a first signal, else another reading."""
    e, p = collapse(F.coalesce(expected, F.lit(""))), collapse(F.coalesce(predicted, F.lit("")))
    bare = lambda x: F.regexp_replace(fold_key(x), " ", "")
    return (
        F.when(~found, "FIELD_NOT_PRESENT").when(e == p, "EXACT").when(p == "", "NOT_FOUND").when(casefold(e) == casefold(p), "CASE_ONLY")
        .when(casefold(without_vietnamese_marks(e)) == casefold(without_vietnamese_marks(p)), "DIACRITICS_ONLY").when(bare(e) == bare(p), "PUNCTUATION_OR_SPACING_ONLY")
        .when(bare(e).contains(bare(p)), "TRUNCATED").when(bare(p).contains(bare(e)), "OVER_EXTRACTED")
        .otherwise(F.coalesce(F.upper(F.get(signals, F.lit(0))), F.lit("OTHER_READING")))
    )
