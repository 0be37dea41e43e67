"""Problem 5: hierarchies of the packages of each project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import closure, forest
from ..storage import table


def package_links(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(grp, node) and (grp, src, dst): links recorded on either of their two ends."""
    t = table(spark, root, "dependency_nodes")
    nodes = t.select(F.col("project_id").alias("grp"), F.col("package_key").alias("node"))
    down = t.select(F.col("project_id").alias("grp"), F.col("package_key").alias("src"), F.explode("dependencies").alias("dst"))
    up = t.select(F.col("project_id").alias("grp"), F.explode("parents").alias("src"), F.col("package_key").alias("dst"))
    return nodes, down.unionByName(up)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, ancestor_key, descendant_key, distance) of every pair joined by links."""
    return closure(*package_links(spark, root)).select(
        F.col("grp").alias("project_id"), F.col("ancestor").alias("ancestor_key"), F.col("descendant").alias("descendant_key"), "distance"
    )


def p5_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Depth, root, parent, path, chain and cycle mark of every package of every project."""
    return forest(*package_links(spark, root)).select(
        F.col("grp").alias("project_id"), F.col("node").alias("package_key"), "depth", "root", "parent",
        F.array_join("path", " > ").alias("path"), "subtree", "on_cycle",
    )


_LINKS = """
nodes AS (SELECT DISTINCT project_id AS g, package_key AS k FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL),
raw AS (SELECT project_id AS g, package_key AS a, unnest(dependencies) AS b FROM dependency_nodes
        UNION SELECT project_id, unnest(parents), package_key FROM dependency_nodes),
links AS (SELECT g, a, b FROM raw JOIN nodes n1 USING (g) JOIN nodes n2 USING (g) WHERE n1.k = a AND n2.k = b)"""

P5_SQL = f"""
WITH RECURSIVE {_LINKS},
size AS (SELECT g, count(*) AS c FROM nodes GROUP BY g),
walk AS (
  SELECT g, a, b, 1 AS d FROM links
  UNION
  SELECT w.g, w.a, l.b, w.d + 1 FROM walk w JOIN links l ON l.g = w.g AND l.a = w.b JOIN size s ON s.g = w.g
  WHERE w.d < s.c)
SELECT g AS project_id, a AS ancestor_key, b AS descendant_key, min(d)::INTEGER AS distance FROM walk GROUP BY 1, 2, 3
"""

P5_HIERARCHY_SQL = f"""
WITH RECURSIVE {_LINKS},
size AS (SELECT g, count(*) AS c FROM nodes GROUP BY g),
walk AS (
  SELECT g, a, b FROM links
  UNION
  SELECT w.g, w.a, l.b FROM walk w JOIN links l ON l.g = w.g AND l.a = w.b),
roots AS (SELECT g, k FROM nodes n WHERE
  NOT EXISTS (SELECT 1 FROM walk u WHERE u.g = n.g AND u.b = n.k AND NOT EXISTS (SELECT 1 FROM walk v WHERE v.g = n.g AND v.a = n.k AND v.b = u.a))
  AND NOT EXISTS (SELECT 1 FROM walk u WHERE u.g = n.g AND u.b = n.k AND u.a < n.k AND EXISTS (SELECT 1 FROM walk v WHERE v.g = n.g AND v.a = n.k AND v.b = u.a))),
far AS (
  SELECT g, k, 0 AS d FROM roots
  UNION
  SELECT f.g, l.b, f.d + 1 FROM far f JOIN links l ON l.g = f.g AND l.a = f.k JOIN size s ON s.g = f.g WHERE f.d < s.c),
depths AS (SELECT g, k, min(d) AS depth FROM far GROUP BY g, k),
-- of all shortest ways from a root the one that comes first
ways AS (
  SELECT g, k, [k] AS path FROM roots
  UNION ALL
  SELECT l.g, l.b, min(list_append(w.path, l.b)) FROM ways w JOIN links l ON l.g = w.g AND l.a = w.k JOIN depths d ON d.g = l.g AND d.k = l.b WHERE d.depth = len(w.path) GROUP BY l.g, l.b),
below AS (SELECT g, unnest(path) AS k FROM ways)
SELECT w.g AS project_id, w.k AS package_key, (len(path) - 1)::INTEGER AS depth, path[1] AS root, path[len(path) - 1] AS parent, array_to_string(path, ' > ') AS path,
  (SELECT count(*) FROM below b WHERE b.g = w.g AND b.k = w.k)::INTEGER AS subtree, EXISTS (SELECT 1 FROM walk c WHERE c.g = w.g AND c.a = w.k AND c.b = w.k) AS on_cycle FROM ways w
"""
