"""Packages joined with advisories: by ecosystem and name, then by version ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cvss import base_score, severity, severity_label
from ..functions.packages import pypi_name
from ..functions.versions import event_keys, event_spans, place, sort_key, within_keys
from ..storage import cut

#: Comparisons of package rows with spans that one task of `covered` makes, about.
TASK_PAIRS = 50_000_000


def affected_packages(osv: DataFrame) -> DataFrame:
    """(id, eco, name, ranges, versions) of every affected package of advisories that were
    not withdrawn; names normalised as the ecosystem does."""
    a = osv.where("withdrawn is null and id is not null").select("id", F.explode("affected").alias("a")).where("a is not null and a.package.name is not null")
    eco = F.lower("a.package.ecosystem")
    return a.select("id", eco.alias("eco"), F.when(eco == "pypi", pypi_name(F.col("a.package.name"))).otherwise(F.col("a.package.name")).alias("name"), F.col("a.ranges").alias("ranges"), F.col("a.versions").alias("versions"))


def vulnerable(packages: DataFrame, osv: DataFrame) -> DataFrame:
    """(ecosystem, name, version, id) of every package version an advisory covers: listed in
    its versions, or within one of its ranges (of types other than GIT).

    Package versions are made distinct before the join, so a popular package is matched
    once. Null names and versions match nothing.
    """
    p = packages.where("name is not null and version is not null").select("ecosystem", "name", "version").distinct()
    p = p.withColumn("_eco", F.lower("ecosystem")).withColumn("_name", F.when(F.col("_eco") == "pypi", pypi_name(F.col("name"))).otherwise(F.col("name")))
    # keys of versions and of range ends are made once a row, below the join
    p = p.withColumn("_key", sort_key(F.col("version"), F.col("_eco")))
    kept = F.filter("ranges", lambda r: r.isNotNull() & (F.coalesce(r["type"], F.lit("")) != "GIT"))
    a = affected_packages(osv).select("id", F.col("eco").alias("_eco"), F.col("name").alias("_name"), "versions", F.transform(kept, lambda r: event_keys(r["events"], F.col("eco"))).alias("_ranges"))
    listed = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))
    ranged = F.coalesce(F.exists("_ranges", lambda e: within_keys(F.col("_key"), e)), F.lit(False))
    return p.join(a, ["_eco", "_name"]).where(listed | ranged).select("ecosystem", "name", "version", "id").distinct()


def placed(packages: DataFrame) -> DataFrame:
    """`packages` with _eco, _name and _at, by which `covered` finds them; those without an
    ecosystem, name or version, which match nothing, are left out."""
    p = packages.where("ecosystem is not null and name is not null and version is not null").withColumn("_eco", F.lower("ecosystem"))
    return p.withColumn("_name", F.when(F.col("_eco") == "pypi", pypi_name(F.col("name"))).otherwise(F.col("name"))).withColumn("_at", place(F.col("version"), F.col("_eco")))


def covered_spans(osv: DataFrame) -> DataFrame:
    """(id, _eco, _name, _lo, _hi): the places of versions that an advisory lists or that lie in
    one of its ranges (of types other than GIT); spans of one advisory and package are disjoint."""
    none = F.array().cast("array<struct<lo:string,hi:string>>")
    kept = F.filter("ranges", lambda r: r.isNotNull() & (F.coalesce(r["type"], F.lit("")) != "GIT"))
    ranged = F.flatten(F.transform(kept, lambda r: event_spans(r["events"], F.col("eco"))))
    at = lambda v: place(v, F.col("eco"))
    listed = F.transform(F.filter("versions", lambda v: v.isNotNull()), lambda v: F.struct(at(v).alias("lo"), F.concat(at(v), F.lit("\0")).alias("hi")))
    a = affected_packages(osv).where("eco is not null").select("id", F.col("eco").alias("_eco"), F.col("name").alias("_name"), F.explode(F.concat(F.coalesce(ranged, none), F.coalesce(listed, none))).alias("s"))
    a = a.select("id", "_eco", "_name", F.col("s.lo").alias("_lo"), F.col("s.hi").alias("_hi"))
    w = Window.partitionBy("_eco", "_name", "id").orderBy("_lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("_new", F.when(F.col("_lo") <= ends, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return a.groupBy("_eco", "_name", "id", "_run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_run")


def covered(packages: DataFrame, osv: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Rows of `packages`, as `placed` gives them, with the id of each advisory that covers them,
    every pair once, without the columns of `placed`.

    There are as many pairs as packages times advisories of a name, far more than rows of the
    input, so pairs are made last and never shuffled: only packages and spans are. The pairs of a
    common name are dealt to many tasks as a grid of parts of its packages and of its spans.
    `packages` are read twice, so they should be written before.
    """
    p, spans, name = packages, cut(covered_spans(osv)), ["_eco", "_name"]
    names = cut(p.groupBy(*name).agg(F.count("*").alias("n")).join(spans.groupBy(*name).agg(F.count("*").alias("m")), name).withColumn("pairs", F.col("n").cast("double") * F.col("m")))
    total = names.agg(F.sum("pairs")).first()[0] or 0.0
    spark = p.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / task_pairs))
    most = max(1.0, total / (2 * tasks))  # so that at most 2 * tasks names are dealt out
    down = F.ceil(F.sqrt(F.col("pairs") / most * F.col("n") / F.col("m")))
    down = F.least(F.greatest(down, F.lit(1)), F.ceil(F.col("pairs") / most)).cast("int")
    large = names.where(F.col("pairs") > most).select(*name, down.alias("_down"), F.ceil(F.col("pairs") / most / down).cast("int").alias("_across"))
    large = F.broadcast(cut(large))

    def dealt(rows: DataFrame, own: str, other: str, by: str, copies: str) -> DataFrame:
        r = rows.join(large, name, "left")
        r = r.withColumn(own, F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in name]), F.col(by)), F.lit(0)).cast("int"))
        return r.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1))).drop("_down", "_across").repartition(tasks, *name, "_row", "_column")

    left, right = dealt(p, "_row", "_column", "_down", "_across"), dealt(spans, "_column", "_row", "_across", "_down")
    met = left.hint("merge").join(right, [*name, "_row", "_column"]).where("_lo <= _at and _at < _hi")
    return met.drop(*name, "_row", "_column", "_at", "_lo", "_hi")


def fixed_versions(osv: DataFrame) -> DataFrame:
    """(id, eco, name, fixed): distinct versions in which each package of an advisory is fixed."""
    a = affected_packages(osv)
    fixed = F.array_distinct(F.filter(F.flatten(F.transform("ranges", lambda r: F.coalesce(F.transform(r["events"], lambda e: F.try_element_at(e, F.lit("fixed"))), F.array().cast("array<string>")))), lambda v: v.isNotNull()))
    return a.select("id", "eco", "name", F.explode(fixed).alias("fixed")).distinct()


def rated(osv: DataFrame) -> DataFrame:
    """(delivery_id, id, score, vector, severity): the best score of each delivery; without
    a vector the written label decides."""
    v = osv.select("delivery_id", "id", F.col("database_specific.severity").alias("label"), F.posexplode_outer(F.transform("severity", lambda x: x["score"])).alias("at", "vector"))
    # one row a delivery: the greatest score, the first vector on a tie
    top = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("at")).alias("first"), "vector")))
    s = v.withColumn("score", base_score(F.col("vector"))).groupBy("delivery_id", "id", "label").agg(top.alias("b"))
    return s.select("delivery_id", "id", F.col("b.score").alias("score"), F.col("b.vector").alias("vector"), F.coalesce(severity(F.col("b.score")), severity_label(F.col("label"))).alias("severity"))


def exploited(osv: DataFrame, kev: DataFrame) -> DataFrame:
    """Deliveries any of whose identifiers is in the list of exploited flaws (semi join)."""
    norm = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    ids = osv.select("delivery_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("id"))).alias("x")).select("delivery_id", norm(F.col("x")).alias("cve"))
    known = kev.where("cve_id is not null").select(norm(F.col("cve_id")).alias("cve")).distinct()
    return osv.join(ids.join(known, "cve", "left_semi").select("delivery_id").distinct(), "delivery_id", "left_semi")


def breached(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """values(value) found in breach ranges(prefix, suffix, count) by the two-step hash: five
    hex digits choose the range, the rest must stand in it with a count above 0."""
    h = F.upper(F.sha1("value"))
    v = values.where("value is not null").select("value").distinct().withColumn("prefix", F.left(h, F.lit(5))).withColumn("suffix", F.substring(h, 6, 40))
    return v.join(ranges.where("count > 0"), ["prefix", "suffix"]).select("value", "count")
