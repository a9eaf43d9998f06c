"""Structured Streaming over replayed tables: windows with watermarks, idempotent rows, versioned corrections."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirefold.operators.governance import shared_folder


def folder(spark: SparkSession) -> str:
    """A new place for a stream's checkpoint or output, in the folder that the cluster names for checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the schema is the table's."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not _is_file(spark, path) else sf_dir, pathGlobFilter=f"{name}.parquet" if _is_file(spark, path) else "*.parquet")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and gives its output as a table."""
    spark, out = stream.sparkSession, folder(stream.sparkSession)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", folder(spark)).trigger(availableNow=True)
    if mode == "append":
        run.format("parquet").start(out).awaitTermination()
    else:
        # Each batch of complete mode is the whole result and takes the place of the one before; a repeated batch changes nothing.
        run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def daily_totals(events: DataFrame, late: str | None = "2 days") -> DataFrame:
    """Counts and sums of (ts, event_type, value) events by day. With `late`, ts needs a zone, and rows later than the watermark are left out."""
    by = (events.withWatermark("ts", late) if late else events).groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return by.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("day"), "events", "total")


def once(events: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The first row of each key; with `within`, keys are forgotten when the watermark on ts has passed them by so much."""
    if within:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


class Corrections(StatefulProcessor):
    """Optimistic corrections of one case: a correction must name the hash of what it corrects; a replay of the last one is a no-op.

    Rows (case_id, seq, base_hash, new_hash) give (case_id, seq, version, hash, outcome): ACCEPTED, REPLAY or CONFLICT. Within a
    batch they apply in order of seq.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "version int, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        version, held = self.current.get() if self.current.exists() else (0, "")
        out = []
        for pdf in [pd.concat(list(rows)).sort_values(["seq", "new_hash"], kind="stable")]:
            for seq, base, new in zip(pdf["seq"], pdf["base_hash"], pdf["new_hash"], strict=True):
                if version and new == held:
                    outcome = "REPLAY"
                elif base == held:
                    version, held, outcome = version + 1, new, "ACCEPTED"
                else:
                    outcome = "CONFLICT"
                out.append((key[0], seq, version, held, outcome))
        self.current.update((version, held))
        yield pd.DataFrame(out, columns=["case_id", "seq", "version", "hash", "outcome"])

    def close(self) -> None:
        pass


def corrections(stream: DataFrame) -> DataFrame:
    """Applies Corrections by case_id; needs the RocksDB state store."""
    return stream.groupBy("case_id").transformWithStateInPandas(Corrections(), "case_id string, seq long, version int, hash string, outcome string", "Append", "None")
