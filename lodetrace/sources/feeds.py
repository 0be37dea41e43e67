"""Advisory, exploited-flaw and breach feeds landed as files, and snapshots with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OSV_SCHEMA = (
    "id string, aliases array<string>, summary string, details string, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<map<string,string>>>>,versions:array<string>>>, "
    "severity array<struct<type:string,score:string>>, database_specific struct<severity:string,cwe_ids:array<string>,malicious:boolean>, published string, modified string, withdrawn string"
)


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """Advisories, one JSON document a file; malformed documents are left out."""
    return spark.read.schema(OSV_SCHEMA).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).where("id is not null")


def read_exploited(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id) of a catalogue of exploited flaws."""
    t = spark.read.schema("vulnerabilities array<struct<cveID:string>>").option("multiLine", "true").json(path)
    return t.select(F.explode("vulnerabilities.cveID").alias("cve_id")).where("cve_id is not null").distinct()


def read_breach_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, suffix, count) of files named by a five-digit prefix with SUFFIX:COUNT lines."""
    t = spark.read.text(path).select(F.upper(F.regexp_extract(F.input_file_name(), r"([0-9A-Fa-f]{5})[^/]*$", 1)).alias("prefix"), F.split("value", ":").alias("p"))
    return t.where(F.size("p") == 2).select("prefix", F.upper(F.trim(F.col("p")[0])).alias("suffix"), F.trim(F.col("p")[1]).try_cast("bigint").alias("count")).where("count is not null")


def unexpired(snapshot: DataFrame, now: Column) -> DataFrame:
    """Rows of a cached snapshot that hold: no `expires_at`, or one not before `now`."""
    return snapshot.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same keys, the latest
    `fetched_at` holding within `new`."""
    from ..operators.relational import keep_last, prefer

    return prefer(keep_last(new, keys, F.col("fetched_at")), old, keys)
