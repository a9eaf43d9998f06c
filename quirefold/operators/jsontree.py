"""JSON documents at any depth as rows: one row a node, unfolded level by level from VARIANT, and strict checks over these rows.

How many levels there are is counted first, over the distinct bracket structures, so one projection unfolds them all: a document is parsed once, and a level
is made once from what the one before it has in objects and arrays. Checks are joins with rule lists of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import once

#: Names of members that hold what a blinded review may not see, by letters and digits (fixed values).
UNSEEN = ["prediction", "predictions", "draft", "drafttranscription", "drafttext", "recognizedtext", "rawtext", "suggestion", "suggestions"]


#: A JSON string, and runs of what is no bracket. Ranges stand for negated classes, which Java tries far more slowly.
TEXT = r'"[\x00-!#-\[\]-\x{10FFFF}]*+(?:\\.[\x00-!#-\[\]-\x{10FFFF}]*+)*+"'
NO_BRACKET = r"[\x00-Z\\^-z|~-\x{10FFFF}]+"


def brackets(json: Column) -> Column:
    """The brackets of a JSON text, those in strings apart."""
    return F.regexp_replace(F.regexp_replace(json, TEXT, ""), NO_BRACKET, "")


def nesting(marks: Column) -> Column:
    """How deep objects and arrays nest that have these brackets."""
    step = lambda acc, c: once(acc["at"] + F.when(c.isin("[", "{"), 1).otherwise(-1), lambda at: F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most")))
    return F.coalesce(F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step)["most"], F.lit(0))


def node(path: Column, shape: Column, parent: Column, name: Column, v: Column) -> Column:
    """struct<path, shape, parent, name, members, items, scalar> of a value: its members if it is an object, its elements if an array, else itself."""
    both = F.struct(F.try_variant_get(v, "$", "map<string, variant>").alias("members"), F.try_variant_get(v, "$", "array<variant>").alias("items"))
    names = {"path": path, "shape": shape, "parent": parent, "name": name}
    return once(both, lambda b: F.struct(*(x.alias(n) for n, x in names.items()), b["members"].alias("members"), b["items"].alias("items"), F.when(b["members"].isNull() & b["items"].isNull(), v).alias("scalar")))


def below(n: Column) -> Column:
    """The nodes one level below a node."""
    member = lambda e: node(F.concat(n["path"], F.lit("."), e["key"]), F.concat(n["shape"], F.lit("."), e["key"]), n["path"], e["key"], e["value"])
    item = lambda x, i: node(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), F.concat(n["shape"], F.lit("[*]")), n["path"], F.lit(None).cast("string"), x)
    return F.when(n["members"].isNotNull(), F.transform(F.map_entries(n["members"]), member)).otherwise(F.transform(n["items"], item))


def shown(n: Column) -> Column:
    """struct<path, shape, parent, name, kind, members, v> of a node: the names of its members, and its value if it is a scalar."""
    first = lambda: F.substring(F.to_json(n["scalar"]), 1, 1)
    scalar = once(first(), lambda c: F.when(c == '"', "string").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number"))
    kind = F.when(n["members"].isNotNull(), "object").when(n["items"].isNotNull(), "array").when(n["scalar"].isNull(), "broken").otherwise(scalar)
    return F.struct(*(n[x].alias(x) for x in ("path", "shape", "parent", "name")), kind.alias("kind"), F.map_keys(n["members"]).alias("members"), n["scalar"].alias("v"))


def nodes(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, shape, parent, name, kind, members, value) of all nodes of each document.

    path names each member and element from $ on, shape the same with [*] for elements; members are an object's names, value is a scalar's text. A text that does not parse has one
    node of the kind `broken`, as has one that repeats a name in an object; a null text has none.
    """
    rows = docs.where(F.col(json).isNotNull())
    marks = rows.where(F.try_parse_json(json).isNotNull()).select(brackets(F.col(json)).alias("marks")).distinct()
    levels = marks.agg(F.max(nesting(F.col("marks")))).first()[0] or 0
    none = F.lit(None).cast("string")

    def unfolded(level: Column, left: int) -> Column:
        """The nodes of a level and of all levels below, each made once."""
        own = F.transform(level, shown)
        return own if left == 0 else once(F.flatten(F.transform(F.filter(level, lambda n: n["scalar"].isNull()), lambda n: F.coalesce(below(n), F.slice(level, 1, 0)))), lambda nxt: F.concat(own, unfolded(nxt, left - 1)))

    root = F.try_parse_json(json)
    every = once(root, lambda v: once(F.array(node(F.lit("$"), F.lit("$"), none, none, v)), lambda level: unfolded(level, levels)))
    each = rows.select(key, F.explode(every).alias("n")).select(key, "n.*")
    return each.withColumn("value", F.when(F.col("kind").isin("string", "number", "boolean"), F.col("v").cast("string"))).drop("v")


def forbidden(tree: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, path) of members of a forbidden name, compared by letters and digits alone."""
    return tree.where(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]", "").isin(*names)).select(key, "path")


def problems(docs: DataFrame, key: str, json: str, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, path, problem) of nodes of JSON documents that break a strict schema.

    rules give the kinds that the node of a shape may have, `?` for members that may be absent. UNKNOWN names a node without a rule, where its
    parent has one; KIND a node of another kind; MISSING a member that an object lacks; BROKEN a text that is no JSON. Documents of one key count as one where
    members are missing, so what one of them has is not missing in another; without a key nothing is found.
    """
    c = F.col
    listed = [(s, [k for k in kinds if k != "?"], "?" not in kinds) for s, kinds in rules.items()]
    known = F.broadcast(docs.sparkSession.createDataFrame([(s, kinds, [s2.rpartition(".")[2] for s2, _, needed in listed if needed and s2.rpartition(".")[0] == s]) for s, kinds, _ in listed], "r_shape string, kinds array<string>, needs array<string>"))  # the rules, of fixed size
    rows = nodes(docs, key, json).join(known, c("shape") == c("r_shape"), "left")
    outer = F.regexp_replace("shape", r"(\.[^.\[]*|\[\*\])$", "")
    own = F.when(c("kind") == "broken", "BROKEN").when(c("r_shape").isNull() & outer.isin(*rules), "UNKNOWN").when(c("r_shape").isNotNull() & ~F.array_contains("kinds", c("kind")), "KIND")
    lacks = F.when(c("kind") == "object", F.when(c(key).isNull(), c("needs")).otherwise(F.array_except("needs", "members")))
    rows = rows.select(key, "path", own.alias("own"), lacks.alias("lacks")).where("own IS NOT NULL OR size(lacks) > 0")
    entry = lambda path, problem: F.struct(path.alias("path"), problem.alias("problem"))
    missing = F.transform(F.coalesce("lacks", F.array().cast("array<string>")), lambda m: entry(F.concat("path", F.lit("."), m), F.lit("MISSING")))
    found = rows.select(key, F.explode(F.concat(F.array_compact(F.array(F.when(c("own").isNotNull(), entry(c("path"), c("own"))))), missing)).alias("p")).select(key, "p.*")
    repeated = docs.groupBy(key).count().where(f"count > 1 AND `{key}` IS NOT NULL").select(key)
    if repeated.isEmpty():
        return found
    others = nodes(docs.join(repeated, key, "left_semi"), key, json).select(c(key).alias("_key"), c("path").alias("_path"))
    return found.join(others, (c(key) == c("_key")) & (c("path") == c("_path")) & (c("problem") == "MISSING"), "left_anti")
