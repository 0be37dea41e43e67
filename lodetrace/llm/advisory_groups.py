"""Problem 2: identifiers of the same flaw under one group identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table
from .components import connected_groups

# Dashes and blanks that spellings of an identifier differ in.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00ad\ufe58\ufe63\uff0d"
BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+"
IDENTIFIER = r"^(CVE-[0-9]+-[0-9]+|GHSA(-[0-9A-Z]+)+|PYSEC-[0-9]+-[0-9]+|MAL-[0-9]+-[0-9]+)$"


def identifier(c: Column) -> Column:
    """The one spelling of a CVE, GHSA, PYSEC or MAL id; null for anything else."""
    s = F.upper(F.translate(F.regexp_replace(c, BLANKS, ""), DASHES, "-" * len(DASHES)))
    return F.when(s.rlike(IDENTIFIER), s)


def advisory_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(a, b): the id of every delivery with each of its aliases.

    The feed of exploited flaws is not read: an entry names one identifier, so it links nothing
    and makes no group of two or more."""
    osv = table(spark, root, "osv_vulnerability").select("id", F.explode("aliases").alias("alias"))
    return osv.select(identifier(F.col("id")).alias("a"), identifier(F.col("alias")).alias("b"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """(identifier, group_id) of every identifier in a group of two or more."""
    return connected_groups(advisory_pairs(spark, root)).select(F.col("vertex").alias("identifier"), F.col("group").alias("group_id"))


P2_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT upper(regexp_replace(regexp_replace(id, '\s+', '', 'g'), '[‐‑‒–—―−]', '-', 'g')) AS a,
         upper(regexp_replace(regexp_replace(x, '\s+', '', 'g'), '[‐‑‒–—―−]', '-', 'g')) AS b
  FROM (SELECT id, unnest(aliases) AS x FROM osv_vulnerability)),
links AS (SELECT DISTINCT a, b FROM raw WHERE a <> b
  AND regexp_matches(a, '^(CVE-[0-9]+-[0-9]+|GHSA(-[0-9A-Z]+)+|PYSEC-[0-9]+-[0-9]+|MAL-[0-9]+-[0-9]+)$')
  AND regexp_matches(b, '^(CVE-[0-9]+-[0-9]+|GHSA(-[0-9A-Z]+)+|PYSEC-[0-9]+-[0-9]+|MAL-[0-9]+-[0-9]+)$')),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT a AS identifier, least(a, min(b)) AS group_id FROM reach GROUP BY a
"""
