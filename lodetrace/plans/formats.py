"""Queries for functions over names, paths and texts, and for lockfile formats: lockfiles of all
formats are written from the test tables, one a package and its first dependency, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cvss, packages, text
from ..operators import graph, registry
from ..sources import lockfiles
from ..storage import table
from .reference import query

_KEY = "'^([^:]*):(.*)@([^@]*)$'"


@query("SELECT DISTINCT ecosystem || ':' || name || '@' || version AS key, CASE WHEN lower(ecosystem) = 'pypi' THEN 'PyPI' ELSE 'npm' END AS feed FROM dependency_nodes WHERE ecosystem IS NOT NULL AND name IS NOT NULL AND version IS NOT NULL")
def x_package_key(spark, root):
    """Package keys, and what advisories call their ecosystem."""
    t = table(spark, root, "dependency_nodes").where("ecosystem is not null and name is not null and version is not null")
    return t.select(packages.package_key(F.col("ecosystem"), F.col("name"), F.col("version")).alias("key"), packages.advisory_ecosystem(F.col("ecosystem")).alias("feed")).distinct()


@query("SELECT n_name, r_name, CASE WHEN levenshtein(n_name, r_name) > 6 THEN 7 ELSE levenshtein(n_name, r_name) END::INTEGER AS distance FROM nation JOIN region ON n_regionkey = r_regionkey")
def x_levenshtein(spark, root):
    """Distances of nations' and their regions' names, up to six."""
    n, r = table(spark, root, "nation"), table(spark, root, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", text.bounded_levenshtein(F.col("n_name"), F.col("r_name"), 6).alias("distance"))


@query("SELECT file_id, i - 1 AS at, 1 + length(left(content, i - 1)) - length(replace(left(content, i - 1), chr(10), '')) AS line FROM (SELECT file_id, content, unnest(range(1, length(content)))::INTEGER AS i FROM source_files WHERE content IS NOT NULL) WHERE substring(content, i, 1) = '=' AND regexp_matches(substring(content, i + 1, 1), '[a-z]')")
def x_match_positions(spark, root):
    """Where an equals sign stands before a small letter in source files, and in which line."""
    t = table(spark, root, "source_files").where("content is not null")
    m = t.select("file_id", "content", F.explode(text.match_positions(F.col("content"), "=[a-z]")).alias("m"))
    return m.select("file_id", F.col("m.offset").alias("at"), text.line_of(F.col("content"), F.col("m.offset")).alias("line"))


@query("""
WITH r AS (SELECT DISTINCT unnest(['^' || version, '~' || version, '>=' || version || ' <9', version || ' || 9']) AS range FROM dependency_nodes WHERE version IS NOT NULL)
SELECT range, CASE WHEN regexp_matches(trim(range), '\\s|\\|\\|') THEN '^7.0.0' ELSE regexp_extract(trim(range), '^([^0-9]*)', 1) || '7.0.0' END AS moved FROM r""")
def x_range(spark, root):
    """Ranges of manifests moved to a version, their operator kept."""
    v = F.col("version")
    r = table(spark, root, "dependency_nodes").where("version is not null").select(F.explode(F.array(F.concat(F.lit("^"), v), F.concat(F.lit("~"), v), F.concat(F.lit(">="), v, F.lit(" <9")), F.concat(v, F.lit(" || 9")))).alias("range")).distinct()
    return r.select("range", packages.bump_range(F.col("range"), F.lit("7.0.0")).alias("moved"))


IGNORED = ["**/*.js", "etc/*", "src/m?*.py"]


@query("SELECT file_id, regexp_extract(path, '([.][^./]*)$', 1) AS extension FROM source_files WHERE path IS NOT NULL AND NOT regexp_full_match(path, '(.*/)?[^/]*[.]js') AND NOT regexp_full_match(path, '.*[^/]*[.]js') AND NOT regexp_full_match(path, 'etc/[^/]*') AND NOT regexp_full_match(path, 'src/m.[^/]*[.]py')")
def f_ignored_files(spark, root):
    """Source files that no glob of an ignore list covers, with their extension."""
    t = table(spark, root, "source_files").where("path is not null")
    for g in IGNORED:
        t = t.where(~F.col("path").rlike(packages.glob_regex(g)))
    return t.select("file_id", packages.extension(F.col("path")).alias("extension"))


@query("""
WITH ok AS (SELECT DISTINCT record_id, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
u AS (SELECT record_id, value->>'$.dist.tarball' AS url FROM ok, json_each(j, '$.versions') WHERE json_type(value) = 'OBJECT')
SELECT DISTINCT record_id, x AS url, starts_with(lower(x), 'https://') AND lower(regexp_extract(x, '^[A-Za-z]+://([^/:]*)', 1)) = 'registry.pkgs.example' AS allowed FROM (SELECT record_id, unnest([url, replace(url, 'https', 'http'), replace(url, 'registry', 'other')]) AS x FROM u) WHERE x IS NOT NULL""")
def f_hosts(spark, root):
    """Addresses of archives, as they are and altered, and whether they may be fetched."""
    url = F.col("tarball")
    v = registry.packument_versions(table(spark, root, "registry_docs")).where("tarball is not null")
    u = v.select("record_id", F.explode(F.array(url, F.replace(url, F.lit("https"), F.lit("http")), F.replace(url, F.lit("registry"), F.lit("other")))).alias("url")).distinct()
    return u.select("record_id", "url", packages.host_allowed(F.col("url"), ["registry.pkgs.example"]).alias("allowed"))


@query(f"""
WITH k AS (SELECT DISTINCT regexp_extract(package_key, {_KEY}, 2) AS name, regexp_extract(package_key, {_KEY}, 3) AS version FROM dependency_nodes WHERE package_key LIKE 'npm:%')
SELECT name, version, name AS pnpm_name, version AS pnpm_version, name AS yarn_name, name || '@^' || version AS yarn_plain FROM k""")
def x_lock_keys(spark, root):
    """Names and versions read from the keys that pnpm and yarn lockfiles would use."""
    k = packages.key_parts(F.col("package_key"))
    t = table(spark, root, "dependency_nodes").where("package_key like 'npm:%'").select(k.alias("k")).distinct().select("k.name", "k.version")
    pnpm = packages.pnpm_key(F.concat(F.lit("/"), "name", F.lit("@"), "version", F.lit("(react@18.0.0)")))
    spec = F.concat(F.lit('"'), "name", F.lit("@npm:^"), "version", F.lit('"'))
    t = t.withColumn("p", pnpm)
    return t.select("name", "version", F.col("p.name").alias("pnpm_name"), F.col("p.version").alias("pnpm_version"), packages.yarn_spec_name(spec).alias("yarn_name"), packages.yarn_spec_plain(spec).alias("yarn_plain"))


_V2 = {m: list(t) for m, t in cvss.V2.items()}
_PICK = lambda m, i: "(" + "[" + ", ".join(f"'{v}'" for v in _V2[m]) + "]" + f")[1 + (delivery_id // {i}) % 3]"
_WEIGH = lambda m: "CASE " + m.lower() + " " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in cvss.V2[m].items()) + " END"


@query(f"""
WITH m AS (SELECT DISTINCT delivery_id, {", ".join(f"{_PICK(m, 3 ** i)} AS {m.lower()}" for i, m in enumerate(_V2))} FROM osv_vulnerability),
w AS (SELECT delivery_id, 10.41 * (1 - (1 - {_WEIGH('C')}) * (1 - {_WEIGH('I')}) * (1 - {_WEIGH('A')})) AS impact, 20 * {_WEIGH('AV')} * {_WEIGH('AC')} * {_WEIGH('Au')} AS reach FROM m)
SELECT delivery_id, '2.0' AS version, floor((0.6 * impact + 0.4 * reach - 1.5) * CASE WHEN impact = 0 THEN 0 ELSE 1.176 END * 10 + 0.5) / 10 AS score FROM w""")
def x_cvss2(spark, root):
    """Base scores of version 2 vectors made of each delivery's number."""
    d = F.col("delivery_id")
    parts = [F.concat(F.lit(f"{m}:"), F.element_at(F.array(*[F.lit(v) for v in _V2[m]]), (F.floor(d / 3**i) % 3 + 1).cast("int"))) for i, m in enumerate(_V2)]
    t = table(spark, root, "osv_vulnerability").select("delivery_id").distinct().withColumn("vector", F.concat_ws("/", *parts))
    return t.select("delivery_id", cvss.version(F.col("vector")).alias("version"), cvss.base_score(F.col("vector")).alias("score"))


FORMATS = ["v3", "v1", "pnpm", "yarn", "berry"]
_PAIR = f"""
one AS (SELECT project_id, package_key, list_sort(list(DISTINCT d)) AS deps FROM (SELECT project_id, package_key, unnest(coalesce(nullif(dependencies, []), [NULL])) AS d FROM dependency_nodes WHERE project_id IS NOT NULL AND regexp_matches(package_key, '^(npm|pypi):[A-Za-z@][^@]*@[0-9]')) GROUP BY 1, 2),
pair AS (SELECT project_id, package_key, regexp_extract(package_key, {_KEY}, 1) AS eco, regexp_extract(package_key, {_KEY}, 2) AS name, regexp_extract(package_key, {_KEY}, 3) AS version,
  list_filter(deps, lambda d: regexp_matches(d, '^(npm|pypi):[A-Za-z@][^@]*@[0-9]') AND split_part(d, ':', 1) = split_part(package_key, ':', 1) AND regexp_extract(d, {_KEY}, 2) <> regexp_extract(package_key, {_KEY}, 2))[1] AS dep FROM one),
p AS (SELECT *, regexp_extract(dep, {_KEY}, 2) AS dname, regexp_extract(dep, {_KEY}, 3) AS dversion FROM pair)"""
_PEP = lambda n: f"regexp_replace(lower({n}), '[-_.]+', '-', 'g')"


@query(f"""
WITH {_PAIR}
SELECT f || '|' || project_id || '|' || package_key AS project_id, name, version, coalesce(dep, '') AS dependencies FROM p, (VALUES {", ".join(f"('{f}')" for f in FORMATS)}) t(f) WHERE eco = 'npm'
UNION ALL SELECT f || '|' || project_id || '|' || package_key, dname, dversion, '' FROM p, (VALUES {", ".join(f"('{f}')" for f in FORMATS)}) t(f) WHERE eco = 'npm' AND dep IS NOT NULL
UNION ALL SELECT 'poetry|' || project_id || '|' || package_key, {_PEP('name')}, version, coalesce('pypi:' || {_PEP('dname')} || '@' || dversion, '') FROM p WHERE eco = 'pypi' AND (dep IS NULL OR {_PEP('name')} <> {_PEP('dname')})
UNION ALL SELECT 'poetry|' || project_id || '|' || package_key, {_PEP('dname')}, dversion, '' FROM p WHERE eco = 'pypi' AND dep IS NOT NULL AND {_PEP('name')} <> {_PEP('dname')}
UNION ALL SELECT 'pins|' || project_id || '|' || package_key, {_PEP('name')}, version, '' FROM p WHERE eco = 'pypi'""".replace("coalesce('pypi:' || regexp_replace(lower(dname)", "coalesce(CASE WHEN dep IS NOT NULL THEN 'pypi:' END || regexp_replace(lower(dname)"))
def s_lockfiles(spark, root):
    """Packages and links read from lockfiles of all formats."""
    fine = r"^(npm|pypi):[A-Za-z@][^@]*@[0-9]"
    m = graph.merge_nodes(table(spark, root, "dependency_nodes")).where(F.col("project_id").isNotNull() & F.col("package_key").rlike(fine)).withColumn("k", packages.key_parts(F.col("package_key")))
    first = F.get(F.filter("dependencies", lambda d: d.rlike(fine) & (packages.key_parts(d)["ecosystem"] == F.col("k.ecosystem")) & (packages.key_parts(d)["name"] != F.col("k.name"))), F.lit(0))
    p = m.select("project_id", "package_key", "k.*", packages.key_parts(first).alias("d")).select("project_id", "package_key", "ecosystem", "name", "version", F.col("d.name").alias("dn"), F.col("d.version").alias("dv"))

    def made(kind: str, file: str, alone: str, linked: str):
        """Files of one format; N, V, D and W stand for names and versions in the texts."""
        put = lambda t: F.replace(F.replace(F.replace(F.replace(F.lit(t), F.lit("<N>"), F.col("name")), F.lit("<V>"), F.col("version")), F.lit("<D>"), F.coalesce("dn", F.lit(""))), F.lit("<W>"), F.coalesce("dv", F.lit("")))
        return p.where(F.col("ecosystem") == ("pypi" if kind in ("poetry", "pins") else "npm")).select(F.concat_ws("|", F.lit(kind), "project_id", "package_key").alias("project_id"), F.lit(file).alias("path"), F.when(F.col("dn").isNull(), put(alone)).otherwise(put(linked)).alias("content"), "name", "dn")

    files = [
        made("v3", "package-lock.json", '{"packages":{"node_modules/<N>":{"version":"<V>"}}}', '{"packages":{"node_modules/<N>":{"version":"<V>","dependencies":{"<D>":"*"}},"node_modules/<D>":{"version":"<W>"}}}'),
        made("v1", "package-lock.json", '{"dependencies":{"<N>":{"version":"<V>"}}}', '{"dependencies":{"<N>":{"version":"<V>","requires":{"<D>":"*"}},"<D>":{"version":"<W>"}}}'),
        made("pnpm", "pnpm-lock.yaml", "packages:\n  '<N>@<V>': {}\n", "packages:\n  '<N>@<V>': {}\n  '<D>@<W>': {}\nsnapshots:\n  '<N>@<V>':\n    dependencies:\n      '<D>': '<W>'\n  '<D>@<W>': {}\n"),
        made("yarn", "yarn.lock", '"<N>@^<V>":\n  version "<V>"\n', '"<N>@^<V>":\n  version "<V>"\n  dependencies:\n    "<D>" "^<W>"\n\n"<D>@^<W>":\n  version "<W>"\n'),
        made("berry", "yarn.lock", '__metadata:\n  version: 6\n"<N>@npm:^<V>":\n  version: "<V>"\n', '__metadata:\n  version: 6\n"<N>@npm:^<V>":\n  version: "<V>"\n  dependencies:\n    "<D>": ^<W>\n"<D>@npm:^<W>":\n  version: "<W>"\n'),
        made("poetry", "poetry.lock", '[[package]]\nname = "<N>"\nversion = "<V>"\n', '[[package]]\nname = "<N>"\nversion = "<V>"\n[package.dependencies]\n"<D>" = ">=0"\n[[package]]\nname = "<D>"\nversion = "<W>"\n').where(F.col("dn").isNull() | (packages.pypi_name(F.col("name")) != packages.pypi_name(F.col("dn")))),
        made("pins", "requirements.txt", "<N>==<V>\n", "# pinned\n<N> == <V>  # here\n<D>>=1\n"),
    ]
    every = files[0]
    for f in files[1:]:
        every = every.unionByName(f)
    return lockfiles.inventory(every.select("project_id", "path", "content")).select("project_id", "name", "version", F.array_join("dependencies", " ").alias("dependencies"))
