"""Reports as JSON text: SARIF, SPDX and CycloneDX documents, one a project."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packages import purl

_LEVELS = {"error": "8.0", "warning": "4.0", "note": "1.0"}


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def sarif(findings: DataFrame, tool: str = "lodetrace") -> DataFrame:
    """(project_id, document): a SARIF 2.1.0 log of each project's findings.

    A rule is described by its first finding in the order of fingerprints. The results of a
    project make one document, so its findings meet in one task; projects are the unit.
    """
    f = findings.where("project_id is not null and rule_id is not null")
    sev = F.lit("1.0")
    for k, v in _LEVELS.items():
        sev = F.when(F.col("r.level") == k, F.lit(v)).otherwise(sev)
    rules = f.groupBy("project_id", "rule_id").agg(F.min(F.struct("fingerprint", "title", "level")).alias("r"))
    rules = rules.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("r.title").alias("text")).alias("shortDescription"), F.struct(sev.alias("security-severity")).alias("properties")))).alias("rules"))
    places = F.transform("locations", lambda x: F.struct(F.struct(F.struct(x["uri"].alias("uri")).alias("artifactLocation"), F.when(x["start_line"].isNotNull(), F.struct(x["start_line"].alias("startLine"))).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("fingerprint"), F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), places.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints")).alias("r"))
    results = f.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return results.join(rules, "project_id").select("project_id", _json(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")).alias("document"))


def components(nodes: DataFrame) -> DataFrame:
    """Packages of each project once, with their number, purl and scopes. Numbers follow the keys
    within a project, whose short rows meet in one task."""
    n = nodes.where("project_id is not null and package_key is not null").groupBy("project_id", "package_key").agg(
        F.min("ecosystem").alias("ecosystem"), F.min("name").alias("name"), F.min("version").alias("version"), F.coalesce(F.bool_or("direct"), F.lit(False)).alias("direct"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("scopes", F.array().cast("array<string>")))))).alias("scopes")
    )
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("package_key")) - 1
    return n.withColumn("ref", F.concat(F.lit("SPDXRef-Package-"), number.cast("string"))).withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version")))


def _children(nodes: DataFrame, packs: DataFrame, by: str) -> DataFrame:
    """(project_id, parent, children): links whose both ends are packages of the project."""
    links = nodes.select("project_id", "package_key", F.explode("dependencies").alias("child")).distinct()
    a, b = packs.select("project_id", "package_key", F.col(by).alias("parent")), packs.select("project_id", F.col("package_key").alias("child"), F.col(by).alias("ref"))
    return links.join(a, ["project_id", "package_key"]).join(b, ["project_id", "child"]).groupBy("project_id", "parent").agg(F.array_sort(F.collect_set("ref")).alias("children"))


def document_ids(nodes: DataFrame) -> DataFrame:
    """(project_id, document_id): half the SHA-256 of a project's sorted package keys, one a line.

    Keys come sorted to the task of their project and are fed to the digest one by one, so a
    project of any size needs no more memory than a batch. Null keys are left out.
    """
    keys = nodes.where("package_key is not null").select("project_id", "package_key").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for project, group in groupby(rows, lambda r: r[0]):
            digest, first = hashlib.sha256(), True
            for _, key in group:
                digest.update((key if first else "\n" + key).encode())
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([project], pa.string()), pa.array([digest.hexdigest()[:32]])], names=["project_id", "document_id"])

    return keys.repartition("project_id").sortWithinPartitions("project_id", "package_key").mapInArrow(run, "project_id string, document_id string")


def relationships(nodes: DataFrame) -> DataFrame:
    """(project_id, source, relation, target): the document describes the root, the root depends
    on direct packages, and packages on those of their dependencies that are in the project."""
    packs = nodes.where("project_id is not null and package_key is not null").groupBy("project_id", "package_key").agg(F.coalesce(F.bool_or("direct"), F.lit(False)).alias("direct"))
    row = lambda df, a, r, b: df.select("project_id", a.alias("source"), F.lit(r).alias("relation"), b.alias("target"))
    links = nodes.select("project_id", "package_key", F.explode("dependencies").alias("child")).distinct()
    there = links.join(packs.select("project_id", "package_key"), ["project_id", "package_key"], "left_semi").join(packs.select("project_id", F.col("package_key").alias("child")), ["project_id", "child"], "left_semi")
    return (
        row(packs.select("project_id").distinct(), F.lit("DOCUMENT"), "DESCRIBES", F.lit("ROOT"))
        .unionByName(row(packs.where("direct"), F.lit("ROOT"), "DEPENDS_ON", F.col("package_key")))
        .unionByName(row(there, F.col("package_key"), "DEPENDS_ON", F.col("child")))
    )


def spdx(nodes: DataFrame) -> DataFrame:
    """(project_id, document): an SPDX 2.3 document of each project's packages."""
    packs = components(nodes)
    listed = packs.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("ref").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))).alias("externalRefs")))).alias("packages"),
        F.array_sort(F.collect_list(F.when(F.col("direct"), F.struct(F.lit("SPDXRef-Root").alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), F.col("ref").alias("relatedSpdxElement"))))).alias("roots"),
        F.left(F.sha2(F.array_join(F.array_sort(F.collect_set("package_key")), "\n"), 256), F.lit(32)).alias("id"),
    )
    deps = _children(nodes, packs, "ref").select("project_id", F.explode("children").alias("c"), "parent").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("parent").alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), F.col("c").alias("relatedSpdxElement")))).alias("deps"))
    rel = F.concat(F.array(F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.lit("SPDXRef-Root").alias("relatedSpdxElement"))), "roots", F.coalesce("deps", F.array().cast("array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>")))
    return listed.join(deps, "project_id", "left").select("project_id", _json(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("project_id").alias("name"), F.concat(F.lit("urn:spdx:"), "id").alias("documentNamespace"), "packages", rel.alias("relationships")).alias("document"))


def cyclonedx(nodes: DataFrame) -> DataFrame:
    """(project_id, document): a CycloneDX 1.5 document of each project's packages."""
    packs = components(nodes)
    scope = F.when(F.array_contains("scopes", "production"), "required").otherwise("optional")
    parts = packs.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("purl").alias("bom-ref"), F.lit("library").alias("type"), "name", "version", scope.alias("scope"), "purl"))).alias("components"),
        F.array_sort(F.collect_list(F.when(F.col("direct"), F.col("purl")))).alias("direct"),
    )
    deps = _children(nodes, packs, "purl").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("parent").alias("ref"), F.col("children").alias("dependsOn")))).alias("deps"))
    all_deps = F.concat(F.array(F.struct(F.col("project_id").alias("ref"), F.col("direct").alias("dependsOn"))), F.coalesce("deps", F.array().cast("array<struct<ref:string,dependsOn:array<string>>>")))
    return parts.join(deps, "project_id", "left").select("project_id", _json(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), "components", all_deps.alias("dependencies")).alias("document"))


def bill_of_materials(nodes: DataFrame, form: str) -> DataFrame:
    """(project_id, document) in the form `spdx` or `cyclonedx`."""
    forms = {"spdx": spdx, "cyclonedx": cyclonedx}
    if form not in forms:
        raise ValueError(f"no such form: {form}")
    return forms[form](nodes)


def audit_json(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """(project_id, document): a project's summary with its findings by category and level, as
    JSON. Counts, not findings, are gathered, so a project of any size makes one short row."""
    by = findings.where("project_id is not null").groupBy("project_id", "category", "level").agg(F.count("*").alias("findings"))
    by = by.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("category", "level", "findings"))).alias("findings"))
    rows = summary.join(by, "project_id", "left")
    return rows.select("project_id", _json(F.col("project_id").alias("project"), F.struct(*[c for c in summary.columns if c != "project_id"]).alias("summary"), F.coalesce("findings", F.array().cast("array<struct<category:string,level:string,findings:bigint>>")).alias("findings")).alias("document"))


def badge(scores: DataFrame, label: str = "supply chain") -> DataFrame:
    """(project_id, document): a badge of scores(project_id, score, grade) as JSON."""
    s = F.col("score")
    colour = F.when(s >= 90, "brightgreen").when(s >= 80, "green").when(s >= 70, "yellowgreen").when(s >= 60, "orange").otherwise("red")
    message = F.concat(s.cast("string"), F.lit("/100 ("), "grade", F.lit(")"))
    return scores.select("project_id", _json(F.lit(1).alias("schemaVersion"), F.lit(label).alias("label"), message.alias("message"), colour.alias("color")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One line of JSON a project, as text files."""
    documents.select("document").write.mode("overwrite").text(path)


def append_history(scores: DataFrame, path: str) -> None:
    """Adds rows to an append-only history."""
    scores.write.mode("append").parquet(path)


def recent(history: DataFrame, k: int, order: str = "recorded_at") -> DataFrame:
    """The last `k` rows, oldest first."""
    return history.orderBy(F.desc(order)).limit(k).orderBy(order)
