"""Guarded recovery: readings of independent families replace a field's value only where that is empty or unsafe, and only what is safe itself.

Every choice is an aggregate: readings are grouped by field and folded value, the best group of a field and its best member are
maxima of structs, so no window and no list of readings is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import fold_key, once

#: Folded labels that no value of a field may hold (fixed values).
LABELS = {
    "fullName": ["ho va ten", "full name"],
    "dateOfBirth": ["ngay sinh", "date of birth"],
    "placeOfOrigin": ["que quan", "place of origin"],
    "placeOfResidence": ["noi thuong tru", "place of residence"],
    "dateOfExpiry": ["co gia tri den", "date of expiry"],
}
PLACES = ["placeOfOrigin", "placeOfResidence"]
#: Families of recognizers by a word of the profile's name, and weights of profiles (fixed values).
FAMILIES = ["vietocr", "easyocr", "paddle"]
WEIGHTS = [("vietocr_vgg_seq2seq", 3), ("vietocr_vgg_transformer", 2), ("paddle", 2), ("easyocr", 1)]
TRUSTED = "vietocr"
DAY = r"^(\d{2})/(\d{2})/(\d{4})$"


def family(profile: Column) -> Column:
    name = F.lower(F.coalesce(profile, F.lit("")))
    return F.coalesce(*(F.when(name.contains(f), F.lit(f)) for f in FAMILIES), F.when(name == "", F.lit("unknown")).otherwise(name))


def weight(profile: Column) -> Column:
    name = F.lower(F.coalesce(profile, F.lit("")))
    return F.coalesce(*(F.when(name.contains(p), F.lit(w)) for p, w in WEIGHTS), F.lit(0))


def problem(field: Column, value: Column) -> Column:
    """Why a field's value may not be used: EMPTY, INVALID or LABEL; null for a safe one. Fields without a rule of their own only have to be filled."""
    words = F.size(F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != ""))
    day = F.try_to_date(F.regexp_replace(value, DAY, "$3-$2-$1"), "yyyy-MM-dd")
    valid = (
        F.when(field == "identityNumber", value.rlike("^[0-9]{12}$"))
        .when(field == "fullName", words.between(2, 6) & ~value.rlike("[0-9]"))
        .when(field.isin("dateOfBirth", "dateOfExpiry"), value.rlike(DAY) & day.isNotNull())
        .when(field == "sex", value.isin("Nam", "Nữ"))
        .when(field.isin(*PLACES), words >= 2)
        .otherwise(F.lit(True))
    )

    def labelled(folded: Column) -> Column:
        holds = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: folded.contains(x))
        everywhere = [x for f in ("fullName", "dateOfBirth", *PLACES) for x in LABELS[f]]
        own = [F.when(field == f, holds(names)) for f, names in (LABELS | {"fullName": LABELS["fullName"] + LABELS["dateOfBirth"]} | dict.fromkeys(PLACES, everywhere)).items()]
        return F.coalesce(*own, F.lit(False))

    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    return F.when(blank, "EMPTY").when(~F.coalesce(valid, F.lit(False)), "INVALID").when(once(fold_key(value), labelled), "LABEL")


def marks(value: Column) -> Column:
    """How many letters of a value carry what its folded form lacks."""
    return F.size(F.filter(F.split(value, ""), lambda c: c.rlike(r"[^\x00-\x7F]")))


def recommended(readings: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """(keys, field, value, confidence, members, families, reason) of readings (keys, field, profile, value, confidence), a row a field with any reading.

    Only safe readings count. Values that fold alike are one group; the group of most families wins, then of most members, of most weight, with the
    trusted family, of highest mean confidence, then the smaller folded value. With two members of two families its member of most weight,
    confidence and marks is recommended; else value is null and reason tells why.
    """
    c = F.col
    rows = readings.withColumns({"_value": F.trim("value"), "_family": family(c("profile")), "_weight": weight(c("profile")), "_sure": F.coalesce(c("confidence").cast("double"), F.lit(0.0))})
    rows = rows.withColumn("_safe", problem(c(field), c("_value")).isNull()).withColumn("_fold", F.when(c("_safe"), fold_key(c("_value"))))
    best = F.max(F.struct(c("_weight").alias("weight"), c("_sure").alias("confidence"), marks(c("_value")).alias("marks"), c("_value").alias("value")))
    groups = rows.groupBy(*keys, field, "_fold").agg(
        F.count("*").alias("members"), *(F.max((c("_family") == f).cast("int")).alias(f"_is_{f}") for f in FAMILIES),
        F.collect_set(F.when(~c("_family").isin(*FAMILIES), c("_family"))).alias("_others"), F.sum("_weight").alias("weight"), F.bround(F.avg("_sure"), 9).alias("confidence"), best.alias("best"),
    )
    families = sum((c(f"_is_{f}") for f in FAMILIES), F.size("_others")).cast("long")
    # Of equal ranks the smaller folded value: max of its negated order is had by min_by over the ranks' reverse.
    rank = F.struct(-families, -c("members"), -c("weight"), -c(f"_is_{TRUSTED}"), -c("confidence"), "_fold")
    top = groups.withColumn("families", families).groupBy(*keys, field).agg(F.min_by(F.struct("members", "families", "best"), F.when(c("_fold").isNotNull(), rank)).alias("top"))
    enough = (c("top.members") >= 2) & (c("top.families") >= 2)
    reason = F.when(c("top").isNull(), "NO_SAFE_READING").when(enough, "INDEPENDENT_FAMILIES").otherwise("TOO_LITTLE_SUPPORT")
    got = lambda name: F.when(enough, c(f"top.best.{name}")).alias(name)
    return top.select(*keys, field, got("value"), got("confidence"), c("top.members").alias("members"), c("top.families").alias("families"), reason.alias("reason"))


def guarded(baseline: DataFrame, readings: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """(keys, field, value, status, recovered, doubt, reason) of a baseline (keys, field, value).

    A baseline that is empty or unsafe (doubt tells how) takes the recommended value; an unsafe one without a recommendation stays.
    Recovered or not, a filled field needs review and an empty one is not found.
    """
    r = recommended(readings, keys, field).select(*keys, field, F.col("value").alias("_new"), "reason")
    rows = baseline.join(r, [*keys, field], "left").withColumn("doubt", problem(F.col(field), F.trim("value")))
    use = F.col("doubt").isNotNull() & F.col("_new").isNotNull()
    value = F.when(use, F.col("_new")).otherwise(F.col("value"))
    status = F.when(F.coalesce(F.trim(value), F.lit("")) == "", "NOT_FOUND").otherwise("NEEDS_REVIEW")
    return rows.select(*keys, field, value.alias("value"), status.alias("status"), use.alias("recovered"), "doubt", F.coalesce("reason", F.lit("NO_READING")).alias("reason"))
