"""Order-dependent and keyed operators: picking rows, filling forward, nearest and prefix joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per `keys`, the least by `order`; whole rows, by a partial aggregate rather
    than a window, so a key with very many rows is reduced before the shuffle. Ties go to
    the least remaining columns. Null keys form a group."""
    o = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(o).alias("_row"))
    return got.select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(df.columns)])


def keep_last(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """As `keep_first`, the greatest row; ties go to the greatest remaining columns."""
    o = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(o).alias("_row"))
    return got.select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(df.columns)])


def prefer(preferred: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `preferred`, and those of `other` whose key is not among them."""
    return preferred.unionByName(other.join(preferred.select(*keys).distinct(), list(keys), "left_anti"))


def fill_forward(df: DataFrame, partition: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nulls of `columns` replaced by the last value before them in order."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first `k` rows of each key. Spark keeps only k rows a key before the shuffle
    (window group limit), so a hot key does not gather in one task."""
    w, (rank,) = Window.partitionBy(*keys).orderBy(*order), free_names(df, "rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).drop(rank)


def ancestors(path: Column, mark: str = "/node_modules/") -> Column:
    """Every base above a path, the path itself first and '' last; levels end at `mark`."""
    bits = F.split(path, mark)
    cut = F.transform(F.sequence(F.size(bits), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(bits, F.lit(1), n), mark))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(cut, F.array(F.lit("")))))


def resolve_nearest(wants: DataFrame, places: DataFrame) -> DataFrame:
    """wants(scope, base, name) joined to the nearest place(scope, path) that provides it.

    `name` seen from `base` is provided by the deepest `<ancestor>/node_modules/<name>`:
    all candidate paths are an equality join, and the longest match per want wins.
    """
    w = wants.select("scope", "base", "name", F.explode(ancestors(F.col("base"))).alias("_up"))
    w = w.withColumn("path", F.when(F.col("_up") == "", F.concat(F.lit("node_modules/"), F.col("name"))).otherwise(F.concat_ws("/node_modules/", "_up", "name")))
    hit = w.join(places.select("scope", "path"), ["scope", "path"])
    return hit.groupBy("scope", "base", "name").agg(F.max_by("path", F.length("path")).alias("path"))


def prefix_rules(names: DataFrame, exact: list[tuple[str, str]], prefixes: list[tuple[str, str]], column: str = "name", out: str = "service") -> DataFrame:
    """`out`: what the exact rule for a name says, else the first prefix rule that fits.

    The rules are few and fixed, so they become one expression; no join at all."""
    rule = F.lit(None).cast("string")
    for p, s in reversed(prefixes):
        rule = F.when(F.col(column).startswith(p), F.lit(s)).otherwise(rule)
    if exact:
        table = F.create_map(*[F.lit(x) for kv in exact for x in kv])
        rule = F.coalesce(F.try_element_at(table, F.col(column)), rule)
    return names.withColumn(out, rule)


def row_numbers(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """0-based positions in a total order over the whole table, without one task sorting it.

    The table is cut by ranges and sorted within them; every row keeps its part and its place
    in it, and the result is written before the parts are counted, as ranges that are sampled
    a second time would be others. Rows of equal `order` get positions in any order.
    """
    at, part, base = free_names(df, "at", "part", "base")
    ids = F.monotonically_increasing_id()  # part << 33 | place
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", ids.alias(at)))
    of = F.shiftright(at, 33)
    counts = ranged.groupBy(of.alias(part)).agg(F.count("*").alias("c")).orderBy(part).collect()
    starts, run = [], 0
    for r in counts:
        starts.append((r[part], run))
        run += r["c"]
    start = df.sparkSession.createDataFrame(starts, f"{part} bigint, {base} bigint")
    numbered = ranged.withColumn(part, of).join(F.broadcast(start), part)  # one row a part
    return numbered.withColumn(name, F.col(at).bitwiseAND((1 << 33) - 1) + F.col(base)).drop(part, base, at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that are no columns of `df`, whatever those are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while (n := f"_{n}") in taken:
            pass
        out.append(n)
    return out


def snapshot_compare(old: DataFrame, new: DataFrame, key: str, arrays: Sequence[str]) -> DataFrame:
    """key with `<c>_added` and `<c>_removed` for each array column, of keys in either table."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in arrays])
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in arrays])
    none = F.array().cast("array<string>")
    cols = []
    for c in arrays:
        a, b = F.coalesce(f"_o_{c}", none), F.coalesce(f"_n_{c}", none)
        cols += [F.array_sort(F.array_except(b, a)).alias(f"{c}_added"), F.array_sort(F.array_except(a, b)).alias(f"{c}_removed")]
    return o.join(n, key, "full_outer").select(key, *cols)
