"""Structured Streaming forms of the line, first-seen, expiry and trend operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_counts(events: DataFrame, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Events by hour; rows later than `late` behind the newest are dropped with their state."""
    t = events.withColumn(time, F.col(time).cast("timestamp"))
    return t.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "events")


def first_seen(matches: DataFrame, keys: list[str], time: str, within: str = "7 days") -> DataFrame:
    """Each key once, as long as its state is kept: `within` behind the newest row."""
    return matches.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def patch_logs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of patch-log files, one row a file: a file is one repository's log, and its
    order matters, so it is never split."""
    return spark.readStream.text(folder, wholetext=True)


def patch_lines_to(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes the added lines of every arriving log to `path`."""
    from ..sources.history import patch_lines

    def batch(df: DataFrame, number: int) -> None:
        named = df.select(F.sha2("value", 256).alias("repo"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))
        patch_lines(named).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def manifests_to(spark: SparkSession, folder: str, path: str, checkpoint: str):
    """Starts a query that writes the direct dependencies of every manifest saved in `folder`,
    one folder a project, to `path`."""
    from ..sources.lockfiles import manifest_scopes

    saved = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").text(folder, wholetext=True)
    named = saved.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("project_id"), F.lit("package.json").alias("path"), F.col("value").alias("content"))

    def batch(df: DataFrame, number: int) -> None:
        manifest_scopes(df).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def latest_values(updates: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """The last value time of each key; keys unseen for `ttl` behind the newest row expire."""
    return updates.withWatermark(time, ttl).groupBy(F.session_window(time, ttl).alias("w"), key).agg(F.max(time).alias("last_seen"), F.count("*").alias("updates")).select(key, "last_seen", "updates")


def expiring_values(updates: DataFrame, key: str, time: str, ttl_seconds: int) -> DataFrame:
    """A keyed state with expiry: (key, last_seen, updates, expired) of every key that a batch
    brings or that expires, which it does when the watermark passes its last row by
    `ttl_seconds`; a key seen again after that starts anew. For output mode `update`."""
    fields = "key string, last_seen timestamp, updates bigint, expired boolean"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], last, n, True)], columns=["key", "last_seen", "updates", "expired"])
            return
        for pdf in batches:
            newest = pdf[time].max().to_pydatetime()
            last, n = newest if last is None else max(last, newest), n + len(pdf)
        state.update((last, n))
        ends = int(pd.Timestamp(last).timestamp() * 1000) + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], last, n, False)], columns=["key", "last_seen", "updates", "expired"])

    marked = updates.where(F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias(time)).withWatermark(time, "0 seconds")
    return marked.groupBy("key").applyInPandasWithState(run, fields, "last timestamp, n bigint", "update", GroupStateTimeout.EventTimeTimeout)
