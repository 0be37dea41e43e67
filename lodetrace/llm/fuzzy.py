"""Freely typed values mapped to a reference list by a pigeonhole join, in SQL only.

A reference spelling of length L may be missed by k(L) edits. Cut into k + 1 segments, one
of them must stand unchanged in any value within k edits, moved by at most k places. So an
equality join on (length, segment number, substring) finds every candidate; built-in
levenshtein verifies it; an anti-join reports the rest. Values are made distinct first, so a
spelling that fills a third of all rows is compared once, and its rows are salted when the
result is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Copies of a value's result, so that the rows of one frequent value are spread out.
SALT = 16


def edits_sql(length: str) -> str:
    """k as a function of the reference spelling's length: short names must be exact."""
    return f"CASE WHEN {length} < 5 THEN 0 WHEN {length} < 6 THEN 1 ELSE 2 END"


PIGEONHOLE = """
WITH spelled AS (
  SELECT DISTINCT spelling, entry, CAST(length(spelling) AS INT) AS len, {k_spelling} AS k,
         regexp_replace(spelling, '[^0-9]', '') AS digits
  FROM {reference} WHERE spelling IS NOT NULL AND spelling <> ''),
parts AS (
  SELECT spelling, entry, len, k, digits, part,
         substring(spelling, CAST(floor(part * len / (k + 1)) AS INT) + 1,
                   CAST(floor((part + 1) * len / (k + 1)) - floor(part * len / (k + 1)) AS INT)) AS piece
  FROM spelled LATERAL VIEW explode(sequence(0, k)) p AS part),
typed AS (
  SELECT DISTINCT value, regexp_replace(value, '[^0-9]', '') AS digits FROM {typed} WHERE value IS NOT NULL AND value <> ''),
shapes AS (SELECT DISTINCT len, k FROM spelled),
windows AS (
  SELECT t.value, t.digits, len, part, moved,
         CAST(floor(part * len / (k + 1)) AS INT) + 1 + moved AS at,
         CAST(floor((part + 1) * len / (k + 1)) - floor(part * len / (k + 1)) AS INT) AS size
  FROM (SELECT value, digits, len, {k_len} AS k FROM typed LATERAL VIEW explode(sequence(greatest(1, CAST(length(value) AS INT) - 2), CAST(length(value) AS INT) + 2)) l AS len) t
  LATERAL VIEW explode(sequence(0, k)) p AS part
  LATERAL VIEW explode(sequence(-k, k)) m AS moved),
candidates AS (
  SELECT DISTINCT w.value, p.spelling, p.entry, p.k
  FROM windows w JOIN parts p ON p.len = w.len AND p.part = w.part AND p.piece = substring(w.value, w.at, w.size) AND p.digits = w.digits
  WHERE w.at >= 1),
verified AS (
  SELECT value, entry, min(levenshtein(value, spelling)) AS edits
  FROM candidates WHERE levenshtein(value, spelling) <= k GROUP BY value, entry),
best AS (SELECT value, min(struct(edits, entry)) AS b FROM verified GROUP BY value)
SELECT value, b.entry AS entry, b.edits AS edits FROM best
UNION ALL
SELECT t.value, 'unmatched', CAST(NULL AS INT) FROM typed t LEFT ANTI JOIN best USING (value)
"""


def map_values(spark: SparkSession, typed: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, entry, edits) for every distinct non-empty `typed.value`.

    `reference` has spelling and entry (several spellings may mean one entry). A match lies
    within k(length) edits and has the same digits in the same order, since one digit tells
    versions apart; the fewest edits win, a tie goes to the smaller entry; the rest comes
    out as `unmatched`. Null and empty values give no rows; other columns are ignored.
    """
    text = PIGEONHOLE.replace("{k_len}", edits_sql("len")).replace("{k_spelling}", edits_sql("length(spelling)"))
    return spark.sql(text, typed=typed, reference=reference)
