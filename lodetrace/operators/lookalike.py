"""Names that look like well-known ones: a similarity join without comparing all pairs.

A well-known name of length L, cut into three parts, keeps one part unchanged (moved by at
most two places) in any name within two edits. Parts are joined by equality; only candidates
are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITS = 2


def _part(c: Column, length: Column, i: Column, moved: Column) -> Column:
    at = F.floor(i * length / (EDITS + 1)).cast("int")
    size = F.floor((i + 1) * length / (EDITS + 1)).cast("int") - at
    return F.substring(c, at + 1 + moved, size)


def lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, distance): the nearest popular name each distinct name may imitate.

    `names` has name, `popular` name and rank. Case does not count. A name that is itself
    popular imitates none; targets have at least five characters; two edits are allowed if
    the shorter of both has at least seven characters, else one; the least distance wins, then
    the least rank. Null names are left out.
    """
    pop = popular.where("name is not null").groupBy(F.lower("name").alias("target")).agg(F.min("rank").alias("rank")).withColumn("len", F.length("target"))
    mine = names.where("name is not null").select(F.lower("name").alias("low"), "name").distinct().join(pop.select(F.col("target").alias("low")), "low", "left_anti")
    three = F.sequence(F.lit(0), F.lit(EDITS))
    refs = pop.where(F.col("len") >= 5).withColumn("i", F.explode(three)).withColumn("piece", _part(F.col("target"), F.col("len"), F.col("i"), F.lit(0)))
    n = F.length("low")
    probes = (
        mine.withColumn("len", F.explode(F.sequence(F.greatest(n - EDITS, F.lit(1)), n + EDITS)))
        .withColumn("i", F.explode(three))
        .withColumn("moved", F.explode(F.sequence(F.lit(-EDITS), F.lit(EDITS))))
        .where(F.floor(F.col("i") * F.col("len") / (EDITS + 1)) + 1 + F.col("moved") >= 1)
        .withColumn("piece", _part(F.col("low"), F.col("len"), F.col("i"), F.col("moved")))
    )
    pairs = probes.join(refs, ["len", "i", "piece"]).select("name", "low", "target", "rank").distinct()
    d = F.levenshtein("low", "target")
    allowed = F.when(F.least(F.length("low"), F.length("target")) >= 7, 2).otherwise(1)
    best = pairs.withColumn("distance", d).where(F.col("distance") <= allowed).groupBy("name").agg(F.min(F.struct("distance", "rank", "target")).alias("b"))
    return best.select("name", "b.target", "b.distance")
