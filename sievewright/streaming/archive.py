"""Archiving on events: merged removals and deployments.

State isn't kept: each batch joins its events to what is outstanding at that time, so a row held back is asked again by
the next one. Rows are written with the event's id, and an id that was written is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import archive
from ..sources import events


def archived_on_merge(raw: DataFrame, live: DataFrame, base: str) -> DataFrame:
    """key, pull_request and outcome for each merged removal: archive, skip (the flag doesn't live) or ignore (another base). Works on a batch or a stream of JSON texts."""
    merged = events.merged_requests(raw)
    flags = live.select("key", F.lit(True).alias("lives")).distinct()
    met = merged.join(flags, "key", "left")
    outcome = F.when(F.col("base") != base, "ignore").when(F.col("lives"), "archive").otherwise("skip")
    return met.select("key", "pull_request", outcome.alias("outcome"))


def archived_on_deploy(deployments: DataFrame, environment: str, outstanding: DataFrame, ancestry: DataFrame) -> DataFrame:
    """event_id and key of the outstanding removals that each successful deployment to the environment contains."""
    seen = archive.deployed(deployments, environment).select("event_id", "sha").dropDuplicates(["event_id"])
    held = seen.join(ancestry, "sha").select("event_id", F.col("ancestor").alias("merge_commit_sha")).union(seen.select("event_id", "sha"))
    return held.join(outstanding.select("key", "merge_commit_sha"), "merge_commit_sha").select("event_id", "key").distinct()


def stream(spark: SparkSession, folder: str, checkpoint: str, out: str, decide: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Run `decide` on each batch of JSON event files of a folder, and append rows that `out` doesn't hold yet."""
    raw = spark.readStream.schema("value string").option("wholetext", True).text(folder)

    def batch(rows: DataFrame, number: int) -> None:
        new = decide(rows).withColumn("batch", F.lit(number))
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.schema(new.schema).parquet(out)
            new = new.join(old.select(*new.drop("batch").columns), new.drop("batch").columns, "left_anti")
        new.write.mode("append").parquet(out)

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def outcome_counts(stream_of_events: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of each kind in each window of time; a window is closed once the watermark passes it."""
    t = F.col(time).cast("timestamp")
    return stream_of_events.withColumn(time, t).withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
