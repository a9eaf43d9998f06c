"""Strict JSON sources and the sinks: typed exports, aggregate reports, an idempotent result store."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of exactly the schema's keys; a row that does not parse or has another key fails the job."""
    wanted = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    raw = spark.read.text(path).where("trim(value) <> ''")
    extra = F.array_except(F.json_object_keys("value"), F.array(*(F.lit(f.name) for f in wanted.fields)))
    bad = F.when(F.coalesce(F.size(extra), F.lit(1)) > 0, F.raise_error(F.concat(F.lit("unexpected or broken JSON: "), F.substring("value", 1, 80))))
    rows = raw.select(F.coalesce(bad.cast("string"), F.col("value")).alias("value"))
    return rows.select(F.from_json("value", wanted, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def business_json(results: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as a JSON document without its null members."""
    return results.select(key, F.to_json(F.struct(*[c for c in results.columns])).alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A flat export: arrays and structs as JSON text, nulls as empty fields."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


#: Columns of the flat export, in order (fixed values).
EXPORT = ["caseId", "category", "documentType", "sourceFormat", "pageCount", "fieldName", "dataType", "normalizationStatus", "value", "unit", "sensitive", "reviewStatus"]


def typed_export(documents: DataFrame, columns: list[str] = EXPORT) -> DataFrame:
    """One row a field of the active documents, of exactly these columns as text; what is not there is empty.

    documents (caseId, scopeStatus, ..., fields array<struct<fieldName, ...>>).
    """
    rows = documents.where("scopeStatus = 'ACTIVE'").withColumn("f", F.explode("fields"))
    inner = set(rows.schema["f"].dataType.names)
    cell = lambda c: F.col(f"f.{c}") if c in inner else F.col(c) if c in documents.columns else F.lit(None)
    return rows.select(*(F.coalesce(cell(c).cast("string"), F.lit("")).alias(c) for c in columns))


def write_aggregates(rows: DataFrame, path: str, allowed: list[str]) -> None:
    """A report as JSON lines, one file, members by name. Columns that were not allowed, as any that could hold raw values, are refused."""
    if extra := sorted(set(rows.columns) - set(allowed)):
        raise ValueError(f"not an aggregate: {', '.join(extra)}")
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """(letter): the distinct letters of a reader's character list, one a line, or of the `character` list of a YAML file."""
    lines = spark.read.text(path)
    plain = F.regexp_replace(F.regexp_replace("value", r"^\s*(?:-|character(?:_dict)?\s*:)\s*", ""), "^['\"]|['\"]$", "")
    return lines.select(F.explode(F.split(plain, "")).alias("letter")).where("trim(letter) <> ''").distinct()


def new_results(results: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Results whose key is not stored yet, one for each key, with the digest of their JSON."""
    rows = business_json(results, key).groupBy(key).agg(F.min("json").alias("json"))
    return rows.join(stored.select(key), key, "left_anti").withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("json", 256)))


#: Seconds after which a lock that its writer has not renewed is taken for a dead writer's.
STALE = 600


def store(results: DataFrame, path: str, key: str, batch: str | None = None, stale: float = STALE) -> int:
    """Adds new results to a Parquet store; replays change nothing. Gives the number of rows written.

    With a batch name the rows go to that batch's own folder, which a rerun writes over, so a run that failed half-way or ran
    twice leaves one copy. Batches of one store must not run at the same time: a lock file, made only if it is not there, sees
    to that. Its writer renews it; one that a killed driver left is taken away when it has not been renewed for so many seconds.
    """
    spark = results.sparkSession
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = lambda at: time.time() - fs.getFileStatus(at).getModificationTime() / 1000 < stale
    if not fs.createNewFile(lock):
        if fresh(lock):
            raise RuntimeError(f"{path} is being written")
        # Whoever moves the old lock away goes on; one that has moved a new one instead puts it back.
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.lock-{uuid.uuid4().hex}")
        moved = fs.rename(lock, aside)
        if moved and fresh(aside):
            fs.rename(aside, lock)
            moved = False
        if not (moved and fs.delete(aside, False) and fs.createNewFile(lock)):
            raise RuntimeError(f"{path} is being written")
    done = threading.Event()

    def renew() -> None:
        while not done.wait(stale / 4):
            fs.setTimes(lock, int(time.time() * 1000), -1)

    threading.Thread(target=renew, daemon=True).start()
    try:
        return _store(results, path, key, batch)
    finally:
        done.set()
        fs.delete(lock, False)


def _store(results: DataFrame, path: str, key: str, batch: str | None) -> int:
    spark = results.sparkSession
    schema = f"{key} {results.schema[key].dataType.simpleString()}, json string, digest string"
    try:
        stored = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        if batch:
            stored = stored.where(~F.input_file_name().contains(f"/{batch}/"))
        stored.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    fresh = new_results(results, stored, key).persist()
    n = fresh.count()
    if n and batch:
        fresh.write.mode("overwrite").parquet(f"{path}/{batch}")
    elif n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
