"""Problem 3: flat tables of the parts of registry documents and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shred import shred
from ..storage import table

REGISTRY_PATHS = {
    "versions": ("versions", "*"),
    "dist": ("versions", "*", "dist"),
    "attestations": ("versions", "*", "dist", "attestations"),
    "releases": ("releases", "*"),
    "files": ("releases", "*", "*"),
}
ADVISORY_PATHS = {
    "affected": ("affected", "*"),
    "ranges": ("affected", "*", "ranges", "*"),
    "events": ("affected", "*", "ranges", "*", "events", "*"),
}


def registry_parts(spark: SparkSession, root: str) -> DataFrame:
    """Flat rows of every registry payload; versions in an array are named by their `version`."""
    return shred(table(spark, root, "registry_docs"), "record_id", "payload", REGISTRY_PATHS, {"versions": "version"})


def advisory_parts(spark: SparkSession, root: str) -> DataFrame:
    """Flat rows of the `affected` column of every advisory delivery."""
    osv = table(spark, root, "osv_vulnerability").select("delivery_id", F.to_json(F.struct("affected"), {"ignoreNullFields": "false"}).alias("text"))
    return shred(osv, "delivery_id", "text", ADVISORY_PATHS)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """(origin, record_id, child, path) of every part that exists and is not null."""
    there = F.col("kind") != "null"
    reg = registry_parts(spark, root).where(there)
    name = F.col("path")[1]
    # a release given as one file object in place of a list is its own file number 0
    lone = (F.col("child") == "releases") & (F.col("kind") == "object")
    own = F.struct(F.col("child").alias("child"), F.when(F.col("child") == "files", F.concat_ws("/", name, F.col("place").cast("string"))).otherwise(name).alias("path"))
    file0 = F.when(lone, F.struct(F.lit("files").alias("child"), F.concat(name, F.lit("/0")).alias("path")))
    listed = (F.col("child") != "files") | (F.col("parent_kind") == "array")
    reg = reg.where(listed).select(
        F.lit("registry_docs").alias("origin"), F.col("record_id"), F.explode(F.array_compact(F.array(own, file0))).alias("r")
    )
    adv = advisory_parts(spark, root).where(there)
    p = F.col("path")
    adv = adv.select(
        F.lit("osv_vulnerability").alias("origin"),
        F.col("delivery_id").alias("record_id"),
        F.struct(
            F.col("child").alias("child"),
            F.when(F.col("child") == "affected", p[1]).when(F.col("child") == "ranges", F.concat_ws("/", p[1], p[3])).otherwise(F.concat_ws("/", p[1], p[3], p[5])).alias("path"),
        ).alias("r"),
    )
    return reg.unionByName(adv).select("origin", "record_id", "r.child", "r.path").distinct()


P3_SQL = """
WITH doc AS (SELECT DISTINCT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM registry_docs),
ok AS (SELECT * FROM doc WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
vobj AS (
  SELECT record_id, key AS v, value AS x FROM ok, json_each(j, '$.versions') WHERE json_type(j, '$.versions') = 'OBJECT'
  UNION ALL
  SELECT record_id, coalesce(CASE WHEN json_type(value) = 'OBJECT' THEN value->>'version' END, key) AS v, value AS x FROM ok, json_each(j, '$.versions') WHERE json_type(j, '$.versions') = 'ARRAY'),
ver AS (SELECT * FROM vobj WHERE json_type(x) <> 'NULL'),
dist AS (SELECT record_id, v, x->'dist' AS d FROM ver WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.dist') <> 'NULL'),
rel AS (SELECT record_id, key AS v, value AS x FROM ok, json_each(j, '$.releases') WHERE json_type(j, '$.releases') = 'OBJECT' AND json_type(value) <> 'NULL'),
fil AS (
  SELECT r.record_id, r.v || '/' || e.key AS p FROM rel r, json_each(r.x) e WHERE json_type(r.x) = 'ARRAY' AND json_type(e.value) <> 'NULL'
  UNION ALL SELECT record_id, v || '/0' FROM rel WHERE json_type(x) = 'OBJECT'),
aff AS (SELECT delivery_id, generate_subscripts(affected, 1) - 1 AS a, unnest(affected) AS x FROM osv_vulnerability),
ran AS (SELECT delivery_id, a, generate_subscripts(x.ranges, 1) - 1 AS r, unnest(x.ranges) AS y FROM aff WHERE x IS NOT NULL),
eve AS (SELECT delivery_id, a, r, generate_subscripts(y.events, 1) - 1 AS e, unnest(y.events) AS z FROM ran WHERE y IS NOT NULL)
SELECT DISTINCT * FROM (
  SELECT 'registry_docs' AS origin, record_id, 'versions' AS child, v AS path FROM ver
  UNION ALL SELECT 'registry_docs', record_id, 'dist', v FROM dist
  UNION ALL SELECT 'registry_docs', record_id, 'attestations', v FROM dist WHERE json_type(d) = 'OBJECT' AND json_type(d, '$.attestations') <> 'NULL'
  UNION ALL SELECT 'registry_docs', record_id, 'releases', v FROM rel
  UNION ALL SELECT 'registry_docs', record_id, 'files', p FROM fil
  UNION ALL SELECT 'osv_vulnerability', delivery_id, 'affected', a::VARCHAR FROM aff WHERE x IS NOT NULL
  UNION ALL SELECT 'osv_vulnerability', delivery_id, 'ranges', a || '/' || r FROM ran WHERE y IS NOT NULL
  UNION ALL SELECT 'osv_vulnerability', delivery_id, 'events', a || '/' || r || '/' || e FROM eve WHERE z IS NOT NULL)
"""
