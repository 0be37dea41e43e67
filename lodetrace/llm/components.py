"""Pairwise matches consolidated into groups by union-find on a two-dimensional grid.

Vertices are hashed into B blocks; a pair (a, b) lies in the grid cell (block of a, block of
b). Every cell runs a union-find over its own pairs. Then the representatives a vertex got in
the cells of its row and column are exchanged: its parent is the smallest of them. Parents are
followed until they are stable (each step doubles how far they point), so that chains of any
length close in a logarithmic number of steps. Pairs whose ends still have different parents
are the pairs of the next round, with at most half as many vertices. Finally the rounds'
parent maps are composed, from the last to the first. Joins by parent would be skewed where one
group is huge, so parents are made distinct first and their answers salted.

B follows the number of pairs so that a cell holds about `cell_pairs` of them; a vertex with
a very large share of the pairs is spread over a whole row or column of cells.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Pairs per grid cell aimed at; bounds the memory of one task.
CELL_PAIRS = 50_000
#: Copies of the next round's map per join key, so that one huge group is spread out.
SALT = 16


def _union_cell(batch: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(pd.concat([batch["a"], batch["b"]], ignore_index=True), sort=True)
    n, half = len(names), len(batch)
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        x, y = find(x), find(y)
        if x != y:  # codes follow the order of the names: the smaller one stays on top
            up[max(x, y)] = min(x, y)
    return pd.DataFrame({"v": names, "r": names[[find(i) for i in range(n)]]})


def _block(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks))


def _followed(parents: DataFrame, up: DataFrame) -> DataFrame:
    """(v, m) with every m replaced by what up(m, top) says of it. The map is copied `SALT` times,
    so that the many members of one huge group are spread out."""
    copies = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    here = parents.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    return cut(here.join(copies, ["m", "salt"], "left").select("v", F.coalesce("top", "m").alias("m")))


def _stable(parents: DataFrame) -> DataFrame:
    """(v, m) with every m a vertex that is its own parent. Each parent is asked for once,
    however many vertices have it; only those that move are followed."""
    while True:
        above = parents.select(F.col("v").alias("m"), F.col("m").alias("top"))
        up = cut(parents.select("m").distinct().join(above, "m").where("top <> m"))
        if up.isEmpty():
            return parents
        parents = _followed(parents, up)


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(vertex, group): every vertex of a pair with the smallest vertex it is linked to.

    `pairs` holds two string columns; others are ignored. Pairs with a null end or two equal
    ends link nothing and are left out, repeated and reversed pairs count once, an empty
    table gives no rows. Nothing but counts reaches the driver.
    """
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    edges = cut(pairs.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
    rounds: list[DataFrame] = []
    while (n := edges.count()) > 0:
        blocks = max(1, math.ceil(math.sqrt(n / cell_pairs)))
        cell = edges.select("a", "b", _block(F.col("a"), blocks).alias("row"), _block(F.col("b"), blocks).alias("column"))
        reps = cell.groupBy("row", "column").applyInPandas(_union_cell, "v string, r string")
        if blocks == 1:
            rounds.append(cut(reps.withColumnRenamed("r", "m")))
            break
        reps = cut(reps)
        parents = _stable(cut(reps.groupBy("v").agg(F.min("r").alias("m"))))
        rounds.append(parents)
        ends = reps.join(parents, "v").select(F.col("m").alias("x"), F.col("r").alias("v")).distinct()
        far = ends.join(parents, "v").where("x <> m")
        edges = cut(far.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("group"))
    final = rounds.pop()
    while rounds:
        final = _followed(rounds.pop(), final.select(F.col("v").alias("m"), F.col("m").alias("top")))
    return final.select(F.col("v").alias("vertex"), F.col("m").alias("group"))
