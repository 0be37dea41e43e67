"""Problem 4: findings added, removed or changed between weekly snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import canonical_json, canonical_list, snapshot_changes
from ..storage import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_id, project_id, fingerprint, change) for each snapshot after the first."""
    plain = ["rule_id", "level", "category", "title", "message", "related_package", "remediation"]
    compared = [F.col(c) for c in plain] + [canonical_list(F.col("locations")), canonical_json(F.col("properties"))]
    return snapshot_changes(table(spark, root, "finding_snapshots"), ["project_id", "fingerprint"], "snapshot_id", "ingested_at", compared)


P4_SQL = """
WITH latest AS (
  SELECT DISTINCT ON (project_id, fingerprint, snapshot_id) snapshot_id, project_id, fingerprint,
    md5(concat_ws('|', coalesce(rule_id, chr(1)), coalesce(level, chr(1)), coalesce(category, chr(1)), coalesce(title, chr(1)),
      coalesce(message, chr(1)), coalesce(list_sort(locations)::VARCHAR, chr(1)), coalesce(related_package::VARCHAR, chr(1)),
      coalesce(remediation, chr(1)),
      coalesce(CASE WHEN json_valid(properties) THEN list_sort(list_transform(json_keys(properties), lambda k: k || '=' || json_extract(properties, '$."' || k || '"')::VARCHAR))::VARCHAR ELSE properties END, chr(1)))) AS h
  FROM finding_snapshots WHERE fingerprint IS NOT NULL AND snapshot_id IS NOT NULL
  ORDER BY project_id, fingerprint, snapshot_id, ingested_at DESC NULLS LAST),
bounds AS (SELECT min(snapshot_id) AS lo, max(snapshot_id) AS hi FROM finding_snapshots),
now AS (
  SELECT l.*, lag(snapshot_id) OVER w AS ps, lag(h) OVER w AS ph, lead(snapshot_id) OVER w AS ns
  FROM latest l WINDOW w AS (PARTITION BY project_id, fingerprint ORDER BY snapshot_id))
SELECT snapshot_id, project_id, fingerprint, CASE WHEN ps = snapshot_id - 1 THEN 'changed' ELSE 'added' END AS change
FROM now, bounds WHERE snapshot_id > lo AND (ps IS NULL OR ps < snapshot_id - 1 OR ph <> h)
UNION ALL
SELECT (snapshot_id + 1)::INTEGER, project_id, fingerprint, 'removed' FROM now, bounds WHERE snapshot_id < hi AND (ns IS NULL OR ns > snapshot_id + 1)
"""
