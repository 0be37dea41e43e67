"""Change events between consecutive full snapshots of a table, by gaps and islands.

The latest row of every (key, snapshot) is reduced to a 64-bit hash of its compared
columns before anything is shuffled. Runs of consecutive snapshots with an unchanged hash
are islands; each becomes one validity interval. Starts, ends and touching intervals are
the events. Two shuffles of narrow rows: one for the latest row (with map-side partial
aggregation, so a row repeated very often costs nothing) and one by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import null_safe_hash


def canonical_json(col: Column) -> Column:
    """JSON text without layout: keys sorted at every level, no blanks.

    Text that is no JSON, or repeats a key within an object, is left as it is.
    """
    return F.coalesce(F.to_json(F.try_parse_json(col)), col)


def canonical_list(col: Column) -> Column:
    """An array without its order; repeated elements still count."""
    return F.sort_array(col)


def latest_hashes(df: DataFrame, keys: Sequence[str], snapshot: str, order: str, compared: Sequence[Column]) -> DataFrame:
    """One row (keys, snap, h) per key and snapshot, from the row with the greatest `order`.

    Rows with a null in the last key or in `snapshot` are left out; a null `order` is older
    than any other; of several rows with the greatest `order` the one with the greatest
    hash holds, so a tie has one outcome whatever the partitioning.
    """
    narrow = df.where(F.col(keys[-1]).isNotNull() & F.col(snapshot).isNotNull()).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(snapshot).cast("int").alias("snap"),
        F.struct(F.col(order).alias("o"), null_safe_hash(*compared).alias("h")).alias("row"),
    )
    ks = [f"k{i}" for i in range(len(keys))]
    return narrow.groupBy(*ks, "snap").agg(F.max("row").alias("row")).select(*ks, "snap", F.col("row.h").alias("h"))


def validity_intervals(df: DataFrame, keys: Sequence[str], snapshot: str, order: str, compared: Sequence[Column]) -> DataFrame:
    """(k0.., first, last, h, before, after): each maximal run of consecutive snapshots in
    which a key's row did not change, with the end of the run before and the start of the
    one after (null where there is none)."""
    ks = [f"k{i}" for i in range(len(keys))]
    rows = latest_hashes(df, keys, snapshot, order, compared)
    by_key = Window.partitionBy(*ks).orderBy("snap")
    same = (F.lag("snap").over(by_key) == F.col("snap") - 1) & (F.lag("h").over(by_key) == F.col("h"))
    islands = rows.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("starts").over(by_key))
    # the hash partitioning by key satisfies the grouping by (key, island): no further shuffle
    runs = islands.groupBy(*ks, "island").agg(F.min("snap").alias("first"), F.max("snap").alias("last"), F.first("h").alias("h"))
    nearby = Window.partitionBy(*ks).orderBy("first")
    return runs.select(*ks, "first", "last", "h", F.lag("last").over(nearby).alias("before"), F.lead("first").over(nearby).alias("after"))


def snapshot_changes(df: DataFrame, keys: Sequence[str], snapshot: str, order: str, compared: Sequence[Column]) -> DataFrame:
    """(snapshot, keys.., change) with change `added`, `removed` or `changed`.

    Parameters: `keys` name the row's identity, `snapshot` an integer snapshot number,
    `order` what decides between several rows of a key in a snapshot, `compared` the
    columns (already canonical) whose difference is a change.

    Defined cases: an empty table gives no rows; rows without the last key are left out;
    other keys may be null and then form a group of their own; nothing is reported for the
    first snapshot present; a snapshot number missing from the whole table counts as empty.
    Columns that are not named play no part, whatever their names.
    """
    bounds = df.agg(F.min(snapshot).cast("int").alias("lo"), F.max(snapshot).cast("int").alias("hi")).first()
    lo, hi = (bounds.lo, bounds.hi) if bounds.lo is not None else (0, 0)
    runs = validity_intervals(df, keys, snapshot, order, compared)
    opened = F.when(
        F.col("first") > lo,
        F.struct(F.col("first").alias("s"), F.when(F.col("before") == F.col("first") - 1, "changed").otherwise("added").alias("c")),
    )
    closed = F.when(
        (F.col("last") < hi) & (F.col("after").isNull() | (F.col("after") > F.col("last") + 1)),
        F.struct((F.col("last") + 1).alias("s"), F.lit("removed").alias("c")),
    )
    events = runs.select(*[f"k{i}" for i in range(len(keys))], F.explode(F.array_compact(F.array(opened, closed))).alias("e"))
    return events.select(F.col("e.s").alias(snapshot), *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("e.c").alias("change"))
