"""Queries of an audit over the test tables: vulnerabilities, updates, credentials, unused and
reachable packages, licences, suspicious packages, bills of materials, and all findings as one
table; each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors, packages, secret_rules, versions
from ..operators import advisories, findings, graph, registry
from ..operators.hierarchy import clean_links
from ..sources import history
from ..sources.reference_lists import CREDENTIAL_SERVICES, NPM_POPULAR, PACKAGE_SERVICES, PREFIX_SERVICES, PYPI_POPULAR, popular_names, popular_union
from ..storage import cut, table
from . import reference
from .dependencies import _LINKS, package_links
from .reference import _CVSS, _LEXED, _SEMANTIC, _vk, query

#: Passwords of public breach lists, with made-up counts, that stand in for landed range files.
BREACHED = {"123456": 900, "password": 800, "qwerty": 700, "changeme": 60, "letmein": 55, "true": 9, "bearer": 8, "bcrypt": 7, "prod/db/main": 4, "hunter2": 3}


def breach_ranges(spark: SparkSession) -> DataFrame:
    """(prefix, suffix, count) as range files hold them."""
    rows = [(h[:5], h[5:], n) for w, n in BREACHED.items() for h in [hashlib.sha1(w.encode()).hexdigest().upper()]]
    return spark.createDataFrame(rows, "prefix string, suffix string, count bigint")


def _nodes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "dependency_nodes")


def _vulnerabilities(spark: SparkSession, root: str) -> DataFrame:
    return findings.vulnerabilities(_nodes(spark, root), table(spark, root, "osv_vulnerability"), table(spark, root, "kev_feed"))


def _imports(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "source_files").where("content is not null").select(F.explode(detectors.imported(F.col("content"))).alias("specifier"))
    return t.select(packages.specifier_package(F.col("specifier")).alias("package")).where("package is not null").distinct()


def _secrets(spark: SparkSession, root: str) -> DataFrame:
    return findings.secret_scan(table(spark, root, "file_secret_matches"), breach_ranges(spark))


# --- SQL shared by several queries ----------------------------------------------------------

_NORM = lambda e, n: f"CASE WHEN lower({e}) = 'pypi' THEN regexp_replace(lower({n}), '[-_.]+', '-', 'g') ELSE {n} END"
_PURL = lambda e, n, v: f"CASE WHEN {e} = 'pypi' THEN 'pkg:pypi/' || regexp_replace(lower({n}), '[-_.]+', '-', 'g') ELSE 'pkg:npm/' || replace({n}, '@', '%40') END || '@' || {v}"
_VULN = f"""
last AS (SELECT * FROM osv_vulnerability WHERE delivery_id IN (SELECT arg_max(delivery_id, (coalesce(epoch_us(fetched_at), -1), delivery_id)) FROM osv_vulnerability WHERE id IS NOT NULL GROUP BY id)),
hits AS ({reference.SQL['j_vulnerable'].replace('osv_vulnerability', 'last')}),
rate AS (WITH {_CVSS.replace('osv_vulnerability', 'last')} SELECT delivery_id, score, severity FROM rated),
known AS (SELECT DISTINCT o.id FROM (SELECT id, unnest(list_append(coalesce(aliases, []), id)) AS x FROM last) o JOIN kev_feed k ON upper(regexp_replace(k.cve_id, '\\s+', '', 'g')) = upper(regexp_replace(o.x, '\\s+', '', 'g'))),
about AS (SELECT l.id, l.summary, coalesce(list_filter(aliases, lambda a: starts_with(a, 'CVE-'))[1], l.id) AS cve, r.score, r.severity AS sev, k.id IS NOT NULL AS exploited,
  starts_with(l.id, 'MAL-') OR coalesce(len(list_filter(aliases, lambda a: starts_with(a, 'MAL-'))), 0) > 0 OR coalesce(database_specific.malicious, false) AS malicious
  FROM last l JOIN rate r USING (delivery_id) LEFT JOIN known k ON k.id = l.id),
fx AS ({reference.SQL['j_fixed_versions'].replace('osv_vulnerability', 'last')}),
fixes AS (SELECT id, eco, name, list_sort(list(fixed)) AS fixed FROM fx WHERE fixed <> '' GROUP BY ALL),
vuln AS (SELECT h.ecosystem, h.name, h.version, h.id, a.cve, a.summary, a.score, CASE WHEN a.malicious THEN 'critical' ELSE a.sev END AS severity, a.exploited, a.malicious, coalesce(f.fixed, []) AS fixed,
  CASE WHEN a.exploited OR a.malicious OR a.sev IN ('critical', 'high') THEN 'error' WHEN a.sev = 'medium' THEN 'warning' ELSE 'note' END AS level
  FROM hits h JOIN about a USING (id) LEFT JOIN fixes f ON f.id = h.id AND f.eco = lower(h.ecosystem) AND f.name = {_NORM('h.ecosystem', 'h.name')}),
vulns AS (SELECT *, CASE WHEN lower(ecosystem) = 'npm' AND len(list_filter(fixed, lambda x: NOT regexp_matches(x, '{_SEMANTIC}'))) = 0 THEN (SELECT arg_min(x, ({_vk('x', "'npm'")}, x)) FROM (SELECT unnest(fixed) AS x)) ELSE fixed[1] END AS lowest_fixed FROM vuln)"""
_META = f"""
docs AS (SELECT DISTINCT record_id, lower(ecosystem) AS ecosystem, {_NORM('ecosystem', 'name')} AS key, fetched_at, payload::JSON AS j FROM registry_docs WHERE name IS NOT NULL AND ecosystem IS NOT NULL AND json_valid(payload) AND json_type(payload) <> 'NULL'),
lastdoc AS (SELECT DISTINCT ON (record_id) * FROM docs WHERE (ecosystem, key, record_id) IN (SELECT (ecosystem, key, arg_max(record_id, (coalesce(epoch_us(fetched_at), -1), record_id))) FROM docs GROUP BY ecosystem, key)),
now AS (SELECT *, json_extract(j, '/versions/' || replace(j->>'$."dist-tags".latest', '/', '~1')) AS n FROM lastdoc),
meta AS (SELECT ecosystem, key, coalesce(j->>'$."dist-tags".latest', j->>'$.info.version') AS latest,
  CASE WHEN json_type(j, '$.versions') = 'OBJECT' THEN json_keys(j, '$.versions') WHEN json_type(j, '$.releases') = 'OBJECT' THEN json_keys(j, '$.releases') END AS listed,
  coalesce(j->>'$.repository.url', CASE WHEN json_type(j, '$.repository') = 'VARCHAR' THEN j->>'$.repository' END, j->>'$.info.project_urls.Source', j->>'$.info.project_urls.Homepage', j->>'$.info.home_page') AS repo,
  coalesce(n->>'$.license.type', CASE WHEN json_type(n, '$.license') = 'VARCHAR' THEN n->>'$.license' END, n->>'$.licenses[0].type', CASE WHEN json_type(j, '$.license') = 'VARCHAR' THEN j->>'$.license' END, CASE WHEN json_type(j, '$.info.license') = 'VARCHAR' THEN j->>'$.info.license' END) AS license
  FROM now)"""
_RANGES = "ranges AS (SELECT sha1(w) AS h, n FROM (VALUES " + ", ".join(f"('{w}', {n})" for w, n in BREACHED.items()) + ") t(w, n))"
_SECRETS = f"""
{_RANGES},
tree AS (SELECT * FROM file_secret_matches WHERE "commit" IS NULL QUALIFY row_number() OVER (PARTITION BY pattern_id, value, file ORDER BY matched_at DESC NULLS LAST, match_id DESC) = 1),
past AS (SELECT * FROM file_secret_matches WHERE "commit" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pattern_id, value, file ORDER BY matched_at NULLS FIRST, match_id) = 1),
one AS (SELECT *, false AS in_history FROM tree UNION ALL
  SELECT *, true FROM past p WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.pattern_id IS NOT DISTINCT FROM p.pattern_id AND t.value IS NOT DISTINCT FROM p.value AND t.file IS NOT DISTINCT FROM p.file)),
secrets AS (SELECT o.match_id, o.kind, o.description, o.preview, o.file, o.line, o."commit", o.in_history, CASE WHEN o.password THEN r.n IS NOT NULL END AS breached, CASE WHEN o.password THEN r.n END AS breach_count FROM one o LEFT JOIN ranges r ON r.h = sha1(o.value))"""
_UNUSED = f"""
{_LEXED},
packs AS (SELECT DISTINCT regexp_extract(specifier, '^(@[^/]+/[^/]+|[^@/][^/]*)', 1) AS package FROM mods WHERE specifier NOT LIKE '.%' AND specifier NOT LIKE '/%' AND specifier NOT LIKE 'node:%'),
unused AS (SELECT DISTINCT project_id, name FROM dependency_nodes WHERE direct AND ecosystem = 'npm' AND name IS NOT NULL AND list_contains(scopes, 'production') AND name NOT LIKE '@types/%' AND name NOT IN (SELECT package FROM packs))"""
_LICENCES = """
licences AS (SELECT u.name, CASE WHEN trim(coalesce(m.license, '')) = '' THEN 'UNKNOWN' ELSE m.license END AS license FROM (SELECT DISTINCT name FROM dependency_nodes WHERE ecosystem = 'npm' AND name IS NOT NULL) u JOIN meta m ON m.ecosystem = 'npm' AND m.key = u.name)"""
_DOES = "array_to_string(list_filter([" + ", ".join("CASE WHEN regexp_matches(command, '{}') THEN '{}' END".format(p.replace("'", "''"), n.replace("'", "''")) for n, p in detectors.SCRIPT_RULES) + "], lambda x: x IS NOT NULL), '; ')"
_HOOKS = ", ".join(f"'{h}'" for h in detectors.INSTALL_HOOKS)
_POPULAR = "pop AS (SELECT w AS target, min(r) AS rank FROM (VALUES " + ", ".join(f"('{w}', {i})" for i, w in enumerate([*NPM_POPULAR, *PYPI_POPULAR])) + ") t(w, r) GROUP BY w)"
_SIGNALS = f"""
{_POPULAR},
names AS (SELECT DISTINCT ecosystem, name FROM (SELECT ecosystem, name FROM dependency_nodes UNION ALL SELECT ecosystem, name FROM registry_docs) WHERE ecosystem IS NOT NULL AND name IS NOT NULL),
near AS (SELECT name, target, levenshtein(lower(name), target) AS d, rank FROM (SELECT DISTINCT name FROM names WHERE lower(name) NOT IN (SELECT target FROM pop)) n, pop WHERE length(target) >= 5 AND abs(length(name) - length(target)) <= 2
  AND levenshtein(lower(name), target) <= CASE WHEN least(length(name), length(target)) >= 7 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, rank, target) = 1),
hooks AS (SELECT d.key AS name, e.key AS hook, e.value->>'$' AS command FROM now d, json_each(d.n, '$.scripts') e WHERE d.ecosystem = 'npm' AND json_type(d.n, '$.scripts') = 'OBJECT' AND e.key IN ({_HOOKS}) AND e.value->>'$' IS NOT NULL),
run AS (SELECT n.ecosystem, n.name, hook, {_DOES} AS does FROM names n JOIN hooks h ON h.name = n.name WHERE n.ecosystem = 'npm'),
scripts AS (SELECT regexp_matches(name, '\\p{{Latin}}')::INTEGER + regexp_matches(name, '\\p{{Cyrillic}}')::INTEGER + regexp_matches(name, '\\p{{Greek}}')::INTEGER + regexp_matches(name, '\\p{{Armenian}}')::INTEGER + regexp_matches(name, '\\p{{Hebrew}}')::INTEGER + regexp_matches(name, '\\p{{Arabic}}')::INTEGER AS c, ecosystem, name FROM names),
signals AS (
  SELECT n.ecosystem, n.name, 'typosquat' AS signal, 'error' AS level, 'Edit distance ' || d || ' from ' || target AS detail FROM names n JOIN near USING (name)
  UNION ALL SELECT ecosystem, name, 'homoglyph', 'error', CASE WHEN c > 1 THEN 'mixed-scripts' ELSE 'non-ascii' END FROM scripts WHERE c > 1 OR regexp_matches(name, '[^\\x00-\\x7F]')
  UNION ALL SELECT ecosystem, name, 'install-script', 'error', 'Install script (' || hook || ') ' || does FROM run WHERE does <> ''
  UNION ALL SELECT ecosystem, name, 'install-script-present', 'note', 'Runs install scripts (' || string_agg(DISTINCT hook, ', ' ORDER BY hook) || ')' FROM run GROUP BY ecosystem, name HAVING max(does) = '')"""


# --- vulnerabilities and updates ------------------------------------------------------------


@query(f"""WITH {_VULN} SELECT ecosystem, name, version, id, cve, severity, exploited, malicious, level, array_to_string(fixed, ' ') AS fixed, lowest_fixed,
  row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'none' THEN 4 ELSE 5 END, ecosystem || ':' || name || '@' || version, id) - 1 AS place FROM vulns""")
def d_vulnerabilities(spark, root):
    """Package versions with the advisories that cover them, rated and with fixed versions, in
    report order: the worst first, then by package."""
    v = findings.in_severity_order(_vulnerabilities(spark, root))
    return v.select("ecosystem", "name", "version", "id", "cve", "severity", "exploited", "malicious", "level", F.array_join("fixed", " ").alias("fixed"), "lowest_fixed", "place")


@query(f"""WITH {_VULN} SELECT s.severity, count(v.id) AS vulnerabilities, count_if(coalesce(v.exploited, false)) AS exploited FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('none'), ('unknown')) s(severity) LEFT JOIN vulns v USING (severity) GROUP BY s.severity""")
def a_vulnerabilities(spark, root):
    """Vulnerabilities by severity and how many of them are known to be exploited."""
    return findings.vulnerability_summary(_vulnerabilities(spark, root))


_PRE = f"CASE WHEN lower(ecosystem) = 'npm' AND regexp_matches(x, '{_SEMANTIC}') THEN regexp_extract(x, '{_SEMANTIC}', 4) <> '' ELSE regexp_matches(regexp_replace(x, '^v', ''), '[A-Za-z]') END"
_NTH = lambda v, i: f"coalesce(list_filter(list_transform(regexp_split_to_array({v}, '[.+_-]'), lambda p: regexp_extract(p, '^v?([0-9]+)', 1)), lambda p: p <> '')[{i}]::BIGINT, 0)"
_PLAN = f"""
{_VULN}, {_META},
direct AS (SELECT DISTINCT ecosystem, name, version FROM dependency_nodes WHERE direct AND ecosystem IS NOT NULL AND name IS NOT NULL AND version IS NOT NULL),
firsts AS (SELECT ecosystem, name, version, id, (SELECT arg_min(x, ({_vk('x', 'ecosystem')}, x)) FROM (SELECT unnest(fixed) AS x) WHERE {_vk('x', 'ecosystem')} > {_vk('version', 'ecosystem')}) AS f FROM vulns),
asked AS (SELECT ecosystem, name, version, arg_max(f, ({_vk('f', 'ecosystem')}, f)) AS b, list_sort(list(DISTINCT id)) AS fixes FROM firsts WHERE f IS NOT NULL GROUP BY ecosystem, name, version),
joined AS (SELECT d.ecosystem, d.name, d.version, m.latest, m.listed, m.repo, a.b, coalesce(a.fixes, []) AS fixes FROM direct d JOIN meta m ON lower(m.ecosystem) = lower(d.ecosystem) AND m.key = {_NORM('d.ecosystem', 'd.name')} LEFT JOIN asked a ON a.ecosystem = d.ecosystem AND a.name = d.name AND a.version = d.version),
aimed AS (SELECT *, CASE WHEN b IS NOT NULL THEN coalesce((SELECT arg_min(x, ({_vk('x', 'ecosystem')}, x)) FROM (SELECT unnest(listed) AS x) WHERE NOT {_PRE} AND {_vk('x', 'ecosystem')} >= {_vk('b', 'ecosystem')}), b) WHEN {_vk('latest', 'ecosystem')} > {_vk('version', 'ecosystem')} THEN latest END AS target FROM joined),
plan AS (SELECT ecosystem, name, version, target, fixes, CASE WHEN {_NTH('version', 1)} <> {_NTH('target', 1)} THEN 'major' WHEN {_NTH('version', 2)} <> {_NTH('target', 2)} THEN 'minor' ELSE 'patch' END AS bump,
  regexp_replace(regexp_replace(regexp_replace(repo, '^git\\+', ''), '\\.git$', ''), '^git://', 'https://') || CASE WHEN contains(repo, 'github.com') THEN '/releases' ELSE '' END AS changelog
  FROM aimed WHERE {_vk('target', 'ecosystem')} > {_vk('version', 'ecosystem')})"""


@query(f"""WITH {_PLAN} SELECT ecosystem, name, version, target, bump, array_to_string(fixes, ' ') AS fixes, changelog,
  CASE bump WHEN 'major' THEN 'Major update, likely breaking; review before applying.' WHEN 'minor' THEN 'Minor update.' ELSE 'Patch update, no breaking changes.' END ||
  CASE WHEN len(fixes) > 0 THEN ' Resolves ' || array_to_string(fixes, ', ') || '.' WHEN bump = 'minor' THEN ' Keeps the dependency current.' ELSE '' END AS reason,
  row_number() OVER (ORDER BY len(fixes) = 0, CASE bump WHEN 'patch' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END, name, ecosystem, version) - 1 AS place FROM plan""")
def d_update_plan(spark, root):
    """What each direct package should move to, and why; what mends flaws first, then the
    smallest step."""
    direct = _nodes(spark, root).where("direct")
    p = findings.in_plan_order(findings.update_plan(direct, table(spark, root, "registry_docs"), findings.vulnerabilities(direct, table(spark, root, "osv_vulnerability"), table(spark, root, "kev_feed"))))
    return p.withColumn("fixes", F.array_join("fixes", " "))


# --- reachability and use -------------------------------------------------------------------


@query(f"WITH {_UNUSED} SELECT * FROM unused")
def d_unused_packages(spark, root):
    """Direct production packages that no source file imports."""
    return findings.unused_packages(_nodes(spark, root), _imports(spark, root))


def _reached(spark: SparkSession, root: str) -> DataFrame:
    """(grp, node) of every package that imported packages lead to."""
    _, links = clean_links(*package_links(spark, root))
    named = _nodes(spark, root).where("name is not null").select(F.col("project_id").alias("grp"), F.col("package_key").alias("node"), F.col("name").alias("package"))
    return graph.levels(named.join(_imports(spark, root), "package", "left_semi"), links).select("grp", "node").distinct()


_REACHED = f"""{_LINKS.strip()}, {_UNUSED.strip()},
seeds AS (SELECT DISTINCT project_id AS g, package_key AS k FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL AND name IN (SELECT package FROM packs)),
reached AS (SELECT g, k FROM seeds UNION SELECT r.g, l.b FROM reached r JOIN links l ON l.g = r.g AND l.a = r.k)"""


@query(f"WITH RECURSIVE {_REACHED} SELECT g AS project_id, k AS package_key FROM reached")
def g_reachable(spark, root):
    """Packages of each project that its imported packages lead to."""
    return _reached(spark, root).select(F.col("grp").alias("project_id"), F.col("node").alias("package_key"))


@query(f"""WITH RECURSIVE {_REACHED}, {_VULN},
met AS (SELECT DISTINCT project_id, package_key, id FROM (SELECT DISTINCT project_id, package_key, ecosystem, name, version FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL) n JOIN vulns v USING (ecosystem, name, version))
SELECT project_id, package_key, id, CASE WHEN project_id IN (SELECT g FROM reached) THEN (project_id, package_key) IN (SELECT (g, k) FROM reached) END AS reachable FROM met""")
def j_reachable_vulnerabilities(spark, root):
    """Vulnerable packages of each project, and whether its imports lead to them; null where
    nothing of the project is imported, as then nothing can be said."""
    n = _nodes(spark, root).where("project_id is not null and package_key is not null").select("project_id", "package_key", "ecosystem", "name", "version")
    n = advisories.placed(n).groupBy("project_id", "package_key").agg(F.collect_set(F.struct("_eco", "_name", "_at")).alias("p"))
    r = cut(_reached(spark, root).select(F.col("grp").alias("project_id"), F.col("node").alias("package_key")))
    n = n.join(r.withColumn("hit", F.lit(True)), ["project_id", "package_key"], "left").join(r.select("project_id").distinct().withColumn("any", F.lit(True)), "project_id", "left")
    n = n.select("project_id", "package_key", F.when(F.col("any"), F.coalesce("hit", F.lit(False))).alias("reachable"), (F.size("p") > 1).alias("several"), F.explode("p").alias("p"))
    n = cut(n.select("project_id", "package_key", "reachable", "several", "p.*"))
    last = findings.latest_advisories(table(spark, root, "osv_vulnerability"))
    out = advisories.covered(n.where("not several").drop("several"), last)
    if not (several := n.where("several").drop("several")).isEmpty():  # only a key with several versions or names can meet an advisory twice
        out = out.unionByName(advisories.covered(several, last).distinct())
    return out.select("project_id", "package_key", "id", "reachable")


# --- credentials ----------------------------------------------------------------------------


@query(f"""WITH {_SECRETS} SELECT match_id, kind, file, line, "commit", in_history, breached, breach_count, row_number() OVER (ORDER BY in_history, file NULLS FIRST, coalesce(line, 0), match_id) - 1 AS place FROM secrets""")
def d_secret_scan(spark, root):
    """Each credential of the scanner once, in report order, with what breach lists say of it."""
    s = findings.in_report_order(_secrets(spark, root))
    return s.select("match_id", "kind", "file", "line", "commit", "in_history", "breached", "breach_count", "place")


@query(f"WITH {_SECRETS} SELECT count(*) AS total, count_if(NOT in_history) AS in_tree, count_if(in_history) AS history_only, count_if(coalesce(breached, false)) AS breached FROM secrets")
def a_secrets(spark, root):
    """How many credentials there are, in the tree, only in history, and breached."""
    return findings.secret_summary(_secrets(spark, root))


@query(f"WITH {_SECRETS} SELECT s.service, count(*) AS leaked FROM secrets JOIN (VALUES " + ", ".join(f"('{k}', '{s}')" for k, s in CREDENTIAL_SERVICES.items()) + ") s(kind, service) USING (kind) GROUP BY s.service")
def a_leaked_by_service(spark, root):
    """Credentials by the service they open."""
    return findings.leaked_by_service(_secrets(spark, root))


_q = lambda x: x.replace("'", "''")
_RULED = f"""
lines AS (SELECT file_id, unnest(l) AS line, generate_subscripts(l, 1)::INTEGER AS n FROM (SELECT file_id, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS l FROM source_files WHERE content IS NOT NULL AND NOT contains(content, chr(0)))),
hit AS ({" UNION ALL ".join(f"SELECT file_id, n, '{r.id}' AS rule, {r.least_entropy} AS least, {r.password or r.id == 'generic-secret'} AS loose, unnest(regexp_extract_all(line, '{_q(r.pattern)}', 1)) AS value FROM lines" for r in secret_rules.RULES)}),
once AS (SELECT file_id, n, rule, least, loose, value, count(*) AS occurrences FROM hit WHERE value <> '' GROUP BY ALL),
chars AS (SELECT value, ch, count(*)::DOUBLE AS c FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM (SELECT DISTINCT value FROM once)) GROUP BY ALL),
bits AS (SELECT value, -sum(c / length(value) * log2(c / length(value))) AS e FROM chars GROUP BY value)"""


@query(f"""WITH {_RULED} SELECT file_id, n AS line, rule, value, occurrences FROM once JOIN bits USING (value)
WHERE e >= least AND NOT (loose AND regexp_matches(value, '{_q(secret_rules.PLACEHOLDER)}')) AND value NOT IN ({", ".join(f"'{d}'" for d in secret_rules.DOCUMENTED)})""")
def d_secret_rules(spark, root):
    """Credentials in source files by rule."""
    return secret_rules.scan_content(table(spark, root, "source_files"), "file_id", "content").select("file_id", "line", "rule", "value", "occurrences")


@query(f"WITH {_RANGES} SELECT DISTINCT value, n AS count FROM file_secret_matches JOIN ranges ON h = sha1(value)")
def j_breached(spark, root):
    """Values that breach ranges hold."""
    from ..operators.advisories import breached

    return breached(table(spark, root, "file_secret_matches").select("value"), breach_ranges(spark))


# --- packages -------------------------------------------------------------------------------


@query(f"WITH {_META}, {_LICENCES} SELECT license, count(*) AS packages, row_number() OVER (ORDER BY count(*) DESC, license) - 1 AS place FROM licences GROUP BY license")
def a_licences(spark, root):
    """Packages in use by licence, the commonest first."""
    return findings.licence_counts(findings.package_licences(_nodes(spark, root), table(spark, root, "registry_docs")))


_SERVICE_SQL = "CASE name " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in PACKAGE_SERVICES.items()) + " ELSE CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN '{s}'" for p, s in PREFIX_SERVICES) + " END END"


@query(f"WITH {_POPULAR} SELECT name, {_SERVICE_SQL} AS service FROM (SELECT target AS name FROM pop UNION SELECT name FROM dependency_nodes UNION SELECT DISTINCT '@aws-sdk/' || name FROM registry_docs) WHERE name IS NOT NULL")
def j_services(spark, root):
    """The service each package is a client of: names of the well-known list, of the projects,
    and of a scope that a prefix rule covers."""
    scoped = table(spark, root, "registry_docs").select(F.concat(F.lit("@aws-sdk/"), "name").alias("name"))
    names = popular_union(spark).select("name").unionByName(_nodes(spark, root).select("name")).unionByName(scoped).where("name is not null").distinct()
    return names.withColumn("service", findings.service_of(F.col("name")))


@query("SELECT w AS name, min(r)::INTEGER AS rank FROM (VALUES " + ", ".join(f"('{w}', {i})" for i, w in enumerate([*NPM_POPULAR, *PYPI_POPULAR])) + ") t(w, r) GROUP BY w")
def u_popular_names(spark, root):
    """Well-known names of all ecosystems, each once (union distinct)."""
    a, b = (popular_names(spark).where(F.col("ecosystem") == e).select("name", "rank") for e in ("npm", "pypi"))
    return a.unionByName(b).groupBy("name").agg(F.min("rank").alias("rank"))


def _signal_rows(spark: SparkSession, root: str) -> DataFrame:
    names = _nodes(spark, root).select("ecosystem", "name").unionByName(table(spark, root, "registry_docs").select("ecosystem", "name"))
    return findings.package_signals(names, table(spark, root, "registry_docs"), popular_union(spark))


@query(f"WITH {_META}, {_SIGNALS} SELECT ecosystem, name, CASE WHEN bool_or(level = 'error') THEN 'flagged' WHEN bool_or(level = 'warning') THEN 'caution' ELSE 'clear' END AS verdict, string_agg(DISTINCT signal, ' ' ORDER BY signal) AS signals FROM signals GROUP BY ecosystem, name")
def d_assessments(spark, root):
    """Packages with suspicious signals and the verdict their worst signal gives."""
    return findings.verdicts(_signal_rows(spark, root)).withColumn("signals", F.array_join("signals", " "))


_DIFF = f"""
ok AS (SELECT DISTINCT record_id, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
v AS (SELECT record_id, value AS x, coalesce(CASE WHEN json_type(j, '$.versions') = 'OBJECT' THEN key END, value->>'version') AS version FROM ok, json_each(j, '$.versions') WHERE json_type(value) = 'OBJECT'),
h AS (SELECT record_id, version, e.key AS hook, e.value->>'$' AS command FROM v, json_each(x, '$.scripts') e WHERE json_type(x, '$.scripts') = 'OBJECT' AND e.key IN ({_HOOKS}) AND e.value->>'$' IS NOT NULL),
hd AS (SELECT record_id, version, hook, command, {_DOES} <> '' AS bad FROM h),
p AS (SELECT record_id, version, coalesce(json_type(x, '$.dist.attestations') <> 'NULL', false) AS prov FROM v WHERE version IS NOT NULL),
s AS (SELECT record_id, lag(version) OVER w AS a, version AS b, lag(prov) OVER w AND NOT prov AS lost FROM p WINDOW w AS (PARTITION BY record_id ORDER BY {_vk('version', "'npm'")} NULLS FIRST, version)),
c AS (SELECT s.record_id, s.a, s.b, any_value(lost) AS lost, string_agg(DISTINCT CASE WHEN t.hook IS NOT NULL AND f.command IS DISTINCT FROM t.command THEN t.hook END, ' ' ORDER BY CASE WHEN t.hook IS NOT NULL AND f.command IS DISTINCT FROM t.command THEN t.hook END) AS changed,
  string_agg(DISTINCT CASE WHEN t.bad AND NOT coalesce(f.bad, false) THEN t.hook END, ' ' ORDER BY CASE WHEN t.bad AND NOT coalesce(f.bad, false) THEN t.hook END) AS dangerous
  FROM s LEFT JOIN hd t ON t.record_id = s.record_id AND t.version = s.b LEFT JOIN hd f ON f.record_id = s.record_id AND f.version = s.a AND f.hook = t.hook WHERE s.a IS NOT NULL GROUP BY s.record_id, s.a, s.b)"""


@query(f"""WITH {_DIFF} SELECT record_id, a AS old, b AS new, coalesce(changed, '') AS scripts_changed, coalesce(dangerous, '') AS dangerous, lost AS provenance_lost, CASE WHEN dangerous IS NOT NULL THEN 'flagged' ELSE 'caution' END AS verdict
FROM c WHERE dangerous IS NOT NULL OR changed IS NOT NULL OR lost""")
def d_version_changes(spark, root):
    """Neighbouring versions of packuments that differ in what runs at install or in provenance."""
    v = registry.packument_versions(table(spark, root, "registry_docs"))
    out = findings.version_changes(v, versions.sort_key(F.col("version"), F.lit("npm")))
    return out.select("record_id", F.col("from").alias("old"), F.col("to").alias("new"), F.array_join("scripts_changed", " ").alias("scripts_changed"), F.array_join("dangerous", " ").alias("dangerous"), "provenance_lost", "verdict")


@query(f"""
WITH ok AS (SELECT DISTINCT record_id, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
v AS (SELECT record_id, value AS x, coalesce(CASE WHEN json_type(j, '$.versions') = 'OBJECT' THEN key END, value->>'version') AS version FROM ok, json_each(j, '$.versions') WHERE json_type(value) = 'OBJECT')
SELECT record_id, version, x->>'$.dist.tarball' AS tarball, coalesce(x->>'$.license.type', CASE WHEN json_type(x, '$.license') = 'VARCHAR' THEN x->>'$.license' END, x->>'$.licenses[0].type') AS license,
  coalesce(json_type(x, '$.deprecated') <> 'NULL', false) AS deprecated, coalesce(json_type(x, '$.dist.attestations') <> 'NULL', false) AS provenance,
  coalesce((SELECT string_agg(e.key, ' ' ORDER BY e.key) FROM json_each(x, '$.scripts') e WHERE e.key IN ({_HOOKS}) AND e.value->>'$' IS NOT NULL), '') AS hooks FROM v""")
def s_packument_versions(spark, root):
    """Every version of every packument: archive, licence, deprecation, provenance, hooks."""
    v = registry.packument_versions(table(spark, root, "registry_docs"))
    return v.select("record_id", "version", "tarball", "license", "deprecated", "provenance", F.array_join(F.array_sort(F.map_keys("hooks")), " ").alias("hooks"))


@query("""
WITH ok AS (SELECT DISTINCT record_id, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
p AS (SELECT record_id, j, j->>'$.info.version' AS version FROM ok WHERE json_type(j, '$.info') IS NOT NULL),
f AS (SELECT record_id, r.key AS release, (e.key)::INTEGER AS n, e.value AS x FROM p, json_each(j, '$.releases') r, json_each(r.value) e WHERE json_type(j, '$.releases') = 'OBJECT' AND json_type(r.value) = 'ARRAY')
SELECT record_id, version, array_to_string(list_filter([j->>'$.info.maintainer', j->>'$.info.author'], lambda x: trim(coalesce(x, '')) <> ''), ' ') AS maintainers,
  (SELECT min(x->>'$.upload_time_iso_8601') FROM f WHERE f.record_id = p.record_id) AS created_at, (SELECT x->>'$.upload_time_iso_8601' FROM f WHERE f.record_id = p.record_id AND f.release = p.version AND n = 0) AS published_at,
  coalesce(j->>'$.info.project_urls.Source', j->>'$.info.project_urls.Homepage', j->>'$.info.home_page') AS repository,
  (SELECT arg_min(x->>'$.url', n) FROM f WHERE f.record_id = p.record_id AND f.release = p.version AND x->>'$.packagetype' = 'sdist') AS sdist FROM p""")
def s_pypi_projects(spark, root):
    """Every PyPI document: its version, people, earliest and current upload, addresses."""
    return registry.pypi_projects(table(spark, root, "registry_docs")).withColumn("maintainers", F.array_join("maintainers", " "))


# --- bills of materials, patch logs -----------------------------------------------------------


@query(f"""
SELECT project_id, package_key, {_PURL('ecosystem', 'name', 'version')} AS bom_ref, CASE WHEN prod THEN 'required' ELSE 'optional' END AS scope FROM (
  SELECT project_id, package_key, min(ecosystem) AS ecosystem, min(name) AS name, min(version) AS version, coalesce(bool_or(list_contains(scopes, 'production')), false) AS prod FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL GROUP BY 1, 2)""")
def k_components(spark, root):
    """The components of each project's bill of materials."""
    from .reports import components

    return components(_nodes(spark, root)).select("project_id", "package_key", F.col("purl").alias("bom_ref"), F.when(F.array_contains("scopes", "production"), "required").otherwise("optional").alias("scope"))


@query("""
WITH n AS (SELECT project_id, package_key, coalesce(bool_or(direct), false) AS direct FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL GROUP BY 1, 2),
l AS (SELECT DISTINCT project_id, package_key, unnest(dependencies) AS child FROM dependency_nodes)
SELECT DISTINCT project_id, 'DOCUMENT' AS source, 'DESCRIBES' AS relation, 'ROOT' AS target FROM n
UNION ALL SELECT project_id, 'ROOT', 'DEPENDS_ON', package_key FROM n WHERE direct
UNION ALL SELECT l.project_id, l.package_key, 'DEPENDS_ON', l.child FROM l JOIN n a ON a.project_id = l.project_id AND a.package_key = l.package_key JOIN n b ON b.project_id = l.project_id AND b.package_key = l.child""")
def k_relationships(spark, root):
    """The relationships of each project's bill of materials."""
    from .reports import relationships

    return relationships(_nodes(spark, root))


@query("""
SELECT file_id, "commit", path AS file, n::INTEGER AS line_no, line AS text FROM (
  SELECT file_id, "commit", path, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT file_id, "commit", path, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS l FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL AND "commit" IS NOT NULL))""")
def w_patch_lines(spark, root):
    """Lines that commits add, read back from a patch log of the committed files, one log a file."""
    f = table(spark, root, "source_files").where("content is not null and path is not null and commit is not null")
    added = F.transform(F.split("content", "\r\n|\n|\r"), lambda x: F.concat(F.lit("+"), x))
    head = F.array(F.concat(F.lit("commit "), "commit"), F.concat(F.lit("+++ b/"), "path"), F.concat(F.lit("@@ -0,0 +1,"), F.size(added).cast("string"), F.lit(" @@")))
    log = f.select(F.col("file_id").cast("string").alias("repo"), F.posexplode(F.concat(head, added)).alias("seq", "line"))
    return history.patch_lines(log).select(F.col("repo").cast("bigint").alias("file_id"), "commit", "file", "line_no", "text")


# --- all findings -----------------------------------------------------------------------------


def finding_rows(spark: SparkSession, root: str) -> DataFrame:
    """The findings of all detectors in one schema, in the order of their streams."""
    docs = table(spark, root, "registry_docs")
    return findings.union_findings(
        findings.vulnerability_findings(_vulnerabilities(spark, root)), findings.signal_findings(_signal_rows(spark, root)), findings.secret_findings(_secrets(spark, root)),
        findings.unused_findings(findings.unused_packages(_nodes(spark, root), _imports(spark, root))), findings.licence_findings(findings.package_licences(_nodes(spark, root), docs)),
    )


@query(f"""
WITH {_VULN}, {_META}, {_SIGNALS}, {_SECRETS}, {_UNUSED}, {_LICENCES}
SELECT 1 AS stream, NULL::VARCHAR AS project_id, CASE WHEN malicious THEN 'lodetrace/malicious-package' ELSE 'lodetrace/' || cve END AS rule_id, CASE WHEN malicious THEN 'error' ELSE level END AS level, CASE WHEN malicious THEN 'malicious' ELSE 'vulnerability' END AS category,
  CASE WHEN malicious THEN 'Known malicious package: ' || name || '@' || version ELSE cve || ' in ' || name || '@' || version END AS title,
  CASE WHEN malicious THEN coalesce(summary, 'This package is flagged as malware') || ' (' || id || ').' ELSE coalesce(summary, cve) || CASE WHEN exploited THEN ' [known to be exploited]' ELSE '' END || '. Severity: ' || severity || coalesce(' (CVSS ' || score || ')', '') || '.' END AS message,
  {_PURL('ecosystem', 'name', 'version')} AS uri, NULL::INTEGER AS start_line, CASE WHEN malicious THEN 'malicious' ELSE cve END || '::' || ecosystem || ':' || name || '@' || version AS fingerprint, ecosystem, name, version,
  CASE WHEN malicious THEN 'Remove ' || name || ' immediately; it is known malware.' WHEN lowest_fixed IS NULL THEN 'No fixed version is available yet.' ELSE 'Upgrade ' || name || ' to ' || lowest_fixed || ' or later.' END AS remediation FROM vulns
UNION ALL SELECT 2, NULL, 'lodetrace/' || signal, level, 'malicious', signal || ': ' || name, detail, {_PURL('ecosystem', 'name', "''")}, NULL, 'lodetrace/' || signal || '::' || ecosystem || ':' || name, ecosystem, name, NULL, NULL FROM signals
UNION ALL SELECT 3, NULL, 'lodetrace/secret-' || kind, 'error', 'secret', description || ' in ' || file || CASE WHEN in_history THEN ' (history)' ELSE '' END,
  description || ' detected.' || CASE WHEN breached THEN ' It appears in ' || breach_count || ' public breaches.' ELSE '' END || CASE WHEN in_history THEN ' It stays recoverable from history and must be rotated.' ELSE ' Rotate it and remove it from the code.' END,
  file, line, concat_ws(':', kind, preview, file, coalesce("commit", 'worktree')), NULL, NULL, NULL, 'Rotate the credential; rewrite history to remove it.' FROM secrets
UNION ALL SELECT 4, project_id, 'lodetrace/unused-dependency', 'note', 'unused-dependency', 'Unused dependency: ' || name, name || ' is declared but never imported.', 'package.json', NULL, 'unused:' || name, 'npm', name, NULL, 'Remove ' || name || ' if nothing needs it.' FROM unused
UNION ALL SELECT 5, NULL, 'lodetrace/license-unknown', 'note', 'license', name || ': no declared license', name || ' is used but declares no license.', 'node_modules/' || name || '/package.json', NULL, 'lodetrace/license-unknown:' || name, 'npm', name, NULL, 'Review the license or replace the dependency.' FROM licences WHERE license = 'UNKNOWN'""")
def u_finding_rows(spark, root):
    """All findings of an audit as one table (union all)."""
    return finding_rows(spark, root)
