"""Discovery as a stream: new names once each, the last state of each queued name, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text

#: The order of states; a later state is never undone by a late row of an earlier one.
STATES = ("PENDING", "PROCESSING", "COMPLETED", "ERROR", "SKIPPED")


def discovered(names: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each normal form once within the watermark. Works on streams and, without state, on tables."""
    keyed = names.withColumn("key", text.match_form(F.col("name"))).where("key <> ''")
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["key"]) if names.isStreaming else keyed.dropDuplicates(["key"])


def last_states(changes: DataFrame) -> DataFrame:
    """(key, state, ts): the last change of each key by time, ties to the later state. Streams need outputMode complete or update."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    return changes.groupBy("key").agg(F.max(F.struct("ts", rank.alias("rank"), "state")).alias("m")).select("key", "m.state", "m.ts")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type; rows later than the watermark are left out of streams."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, content: str):
    """Starts a query that adds rows of new keys or new contents to a table of Parquet files at ``target``.

    A row counts as unchanged if its key and content's hash are there; a batch that is run again adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("hash", text.fingerprint(F.col(content))).dropDuplicates([key, "hash"])
        try:
            rows = rows.join(spark.read.parquet(target).select(key, "hash"), [key, "hash"], "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
