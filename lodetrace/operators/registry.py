"""Registry documents (packuments and PyPI projects) as metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import INSTALL_HOOKS
from ..functions.packages import normal_name

def latest_documents(docs: DataFrame) -> DataFrame:
    """The last readable document of every (ecosystem, name): record_id, ecosystem (in small
    letters), name, and `key`, the name as the ecosystem compares it. Later means a later fetch, then a greater
    record_id. Rows without a name or payload, and unreadable ones, are left out."""
    d = docs.where("name is not null and ecosystem is not null and payload is not null").withColumn("key", normal_name(F.col("ecosystem"), F.col("name"))).withColumn("ecosystem", F.lower("ecosystem"))
    d = d.where(F.expr("schema_of_variant(try_parse_json(payload)) <> 'VOID'"))
    # only the number of the last one is shuffled, not the payloads
    last = d.groupBy("ecosystem", "key").agg(F.max(F.struct("fetched_at", "record_id")).record_id.alias("record_id"))
    return d.join(last, ["ecosystem", "key", "record_id"]).select("record_id", "ecosystem", "name", "key", "payload").dropDuplicates(["record_id"])


def packument_versions(docs: DataFrame) -> DataFrame:
    """(record_id, version, tarball, license, deprecated, provenance, hooks) of every version of
    every packument; hooks is the map of its install scripts. Repeated rows give one."""
    rows = docs.sparkSession.sql(
        """
        SELECT record_id, coalesce(v.key, try_variant_get(v.value, '$.version', 'string')) AS version, v.value AS x
        FROM (SELECT record_id, variant_get(try_parse_json(payload), '$.versions') AS vs FROM (SELECT DISTINCT record_id, payload FROM {docs})), LATERAL variant_explode(vs) v""",
        docs=docs,
    )
    get = lambda path, t="string": F.try_variant_get("x", path, t)
    licence = F.coalesce(get("$.license.type"), F.when(F.expr("schema_of_variant(variant_get(x, '$.license')) = 'STRING'"), get("$.license")), get("$.licenses[0].type"))
    hooks = F.map_filter(F.coalesce(get("$.scripts", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, c: k.isin(INSTALL_HOOKS) & c.isNotNull())
    there = lambda path: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(x, '{path}', 'variant')) NOT IN ('VOID')"), F.lit(False))
    return rows.where(F.expr("schema_of_variant(x) LIKE 'OBJECT%'")).select(
        "record_id", "version", get("$.dist.tarball").alias("tarball"), licence.alias("license"), there("$.deprecated").alias("deprecated"), there("$.dist.attestations").alias("provenance"), hooks.alias("hooks")
    )


def pypi_projects(docs: DataFrame) -> DataFrame:
    """(record_id, version, maintainers, created_at, published_at, repository, sdist) of every
    PyPI document: its current version, maintainers and authors that are not blank, the
    earliest upload of all releases, the first upload of the current one, the first address of
    Source, Homepage and home page, and the current version's source distribution."""
    rows = docs.sparkSession.sql(
        """
        SELECT record_id, j, try_variant_get(j, '$.info.version', 'string') AS version,
               try_variant_get(j, '$.releases', 'map<string,variant>') AS releases
        FROM (SELECT record_id, try_parse_json(payload) AS j FROM (SELECT DISTINCT record_id, payload FROM {docs})) WHERE variant_get(j, '$.info') IS NOT NULL""",
        docs=docs,
    )
    get = lambda path: F.try_variant_get("j", path, "string")
    files = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<struct<packagetype:string,url:string,upload_time_iso_8601:string>>"), F.array())
    every = F.flatten(F.transform(F.map_values("releases"), files))
    now = files(F.try_element_at("releases", F.col("version")))
    people = F.filter(F.array(get("$.info.maintainer"), get("$.info.author")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return rows.select(
        "record_id", "version", people.alias("maintainers"), F.array_min(F.transform(every, lambda f: f["upload_time_iso_8601"])).alias("created_at"), F.get(now, F.lit(0))["upload_time_iso_8601"].alias("published_at"),
        F.coalesce(get("$.info.project_urls.Source"), get("$.info.project_urls.Homepage"), get("$.info.home_page")).alias("repository"),
        F.get(F.filter(now, lambda f: f["packagetype"] == "sdist"), F.lit(0))["url"].alias("sdist"),
    )


def package_metadata(docs: DataFrame) -> DataFrame:
    """(ecosystem, key, latest, versions, repository, license) of the last document of each
    package: its current version, all versions it lists, and the current version's licence."""
    rows = docs.sparkSession.sql("SELECT ecosystem, key, try_parse_json(payload) AS j FROM {docs}", docs=latest_documents(docs))
    get = lambda path, t="string": F.try_variant_get("j", path, t)
    listed = get("$.versions", "map<string,variant>")
    r = rows.select("ecosystem", "key", "j", listed.alias("listed"), F.try_element_at(listed, get('$["dist-tags"].latest')).alias("now"))
    text = lambda v, path: F.when(F.expr(f"schema_of_variant(try_variant_get({v}, '{path}', 'variant')) = 'STRING'"), F.try_variant_get(v, path, "string"))
    return r.select(
        "ecosystem", "key", F.coalesce(get('$["dist-tags"].latest'), get("$.info.version")).alias("latest"), F.coalesce(F.map_keys("listed"), F.map_keys(get("$.releases", "map<string,variant>"))).alias("versions"),
        F.coalesce(get("$.repository.url"), text("j", "$.repository"), get("$.info.project_urls.Source"), get("$.info.project_urls.Homepage"), get("$.info.home_page")).alias("repository"),
        F.coalesce(F.try_variant_get("now", "$.license.type", "string"), text("now", "$.license"), F.try_variant_get("now", "$.licenses[0].type", "string"), text("j", "$.license"), text("j", "$.info.license")).alias("license"),
    )
