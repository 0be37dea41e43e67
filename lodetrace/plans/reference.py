"""Queries over the test tables for the operators of the supply-chain engine, with their SQL.

Every query reads its whole tables. The SQL states the same result for DuckDB; `_vk` is the
sort key of a version as text there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cvss, detectors, packages, text, versions
from ..operators import advisories, graph, lookalike, relational
from ..storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SEMANTIC = "^v?(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?([+][0-9A-Za-z.-]+)?$"


def _vk(v: str, eco: str) -> str:
    """Sort key of a version as text: its numbers in 12 digits each, without zeros at the end;
    a blank before a release mark or identifiers, so that fewer numbers come first."""
    nums = lambda x: f"regexp_replace(array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array({x}, '[.+_-]'), lambda p: regexp_extract(p, '^v?([0-9]+)', 1)), lambda p: p <> ''), lambda p: lpad(p, 12, '0')), ''), '(000000000000)+$', '')"
    pre = f"regexp_extract({v}, '{_SEMANTIC}', 4)"
    ids = f"array_to_string(list_transform(string_split(substring({pre}, 2), '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '0' || lpad(p, 12, '0') ELSE '1' || p END), ' ')"
    core = f"regexp_extract({v}, '^[^-+]*')"
    return (
        f"(CASE WHEN NOT regexp_matches({v}, '[0-9]') THEN NULL WHEN lower({eco}) = 'npm' AND regexp_matches({v}, '{_SEMANTIC}') THEN {nums(core)} || CASE WHEN {pre} = '' THEN ' 1' ELSE ' 0' || {ids} END "
        f"ELSE {nums(v)} || CASE WHEN regexp_matches({v}, '[A-Za-z]') THEN ' 0' ELSE ' 1' END END)"
    )


# --- functions ----------------------------------------------------------------------------


@query("""
SELECT DISTINCT package_key, regexp_extract(package_key, '^([^:]*):(.*)@([^@]*)$', 2) AS name,
  CASE WHEN package_key LIKE 'pypi:%' THEN 'pkg:pypi/' || regexp_replace(lower(regexp_extract(package_key, '^([^:]*):(.*)@([^@]*)$', 2)), '[-_.]+', '-', 'g')
       ELSE 'pkg:npm/' || replace(regexp_extract(package_key, '^([^:]*):(.*)@([^@]*)$', 2), '@', '%40') END || '@' || regexp_extract(package_key, '^([^:]*):(.*)@([^@]*)$', 3) AS purl
FROM dependency_nodes WHERE package_key IS NOT NULL""")
def x_purl(spark, root):
    """Package URLs of all package keys (names hold no character besides @ and / to encode)."""
    k = packages.key_parts(F.col("package_key"))
    t = table(spark, root, "dependency_nodes").where("package_key is not null").select("package_key").distinct().withColumn("k", k)
    return t.select("package_key", F.col("k.name").alias("name"), packages.purl(F.col("k.ecosystem"), F.col("k.name"), F.col("k.version")).alias("purl"))


@query("SELECT DISTINCT name, regexp_replace(lower(name), '[-_.]+', '-', 'g') AS normal FROM dependency_nodes WHERE name IS NOT NULL")
def x_pep503(spark, root):
    return table(spark, root, "dependency_nodes").where("name is not null").select("name", packages.pypi_name(F.col("name")).alias("normal")).distinct()


@query("""
WITH v AS (SELECT DISTINCT match_id, value FROM file_secret_matches WHERE value IS NOT NULL AND value <> ''),
c AS (SELECT match_id, value, ch, count(*)::DOUBLE AS n FROM (SELECT match_id, value, unnest(string_split(value, '')) AS ch FROM v) GROUP BY ALL)
SELECT match_id, round(-sum(n / length(value) * log2(n / length(value))), 4) + 0 AS entropy FROM c GROUP BY match_id, value""")
def x_entropy(spark, root):
    """Entropy of each matched value."""
    t = table(spark, root, "file_secret_matches").where("value is not null and value <> ''").select("match_id", "value").distinct()
    return t.select("match_id", (F.round(text.entropy(F.col("value")), 4) + 0.0).alias("entropy"))


@query("""
WITH l AS (SELECT file_id, unnest(regexp_split_to_array(content, '\\r\\n|\\n|\\r')) AS line FROM source_files WHERE content IS NOT NULL),
t AS (SELECT DISTINCT file_id, tok FROM (SELECT file_id, unnest(regexp_split_to_array(line, '[\\s"''`()\\[\\]{}<>,;]+')) AS tok FROM l) WHERE length(tok) >= 40),
c AS (SELECT file_id, tok, ch, count(*)::DOUBLE AS n FROM (SELECT file_id, tok, unnest(string_split(tok, '')) AS ch FROM t) GROUP BY ALL),
e AS (SELECT file_id, tok, round(-sum(n / length(tok) * log2(n / length(tok))), 6) AS entropy FROM c GROUP BY file_id, tok)
SELECT file_id, tok AS token, round(entropy, 3) AS entropy FROM e WHERE entropy >= 5.2
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY entropy DESC, tok) <= 10""")
def x_high_entropy_tokens(spark, root):
    """The ten long tokens of highest entropy of each file."""
    lines = table(spark, root, "source_files").where("content is not null").select("file_id", F.explode(F.split("content", r"\r\n|\n|\r")).alias("line"))
    toks = lines.where(F.length("line") >= 40).select("file_id", F.explode(text.tokens_over(F.col("line"), 40, 5.1)).alias("token")).distinct()
    toks = toks.withColumn("entropy", F.round(text.entropy(F.col("token")), 6)).where("entropy >= 5.2")
    return relational.top_k(toks, ["file_id"], 10, F.desc("entropy"), F.col("token")).select("file_id", "token", F.round("entropy", 3).alias("entropy"))


@query("""
SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS beyond_ascii,
  regexp_matches(text, '\\p{Latin}')::INTEGER + regexp_matches(text, '\\p{Cyrillic}')::INTEGER + regexp_matches(text, '\\p{Greek}')::INTEGER + regexp_matches(text, '\\p{Armenian}')::INTEGER + regexp_matches(text, '\\p{Hebrew}')::INTEGER + regexp_matches(text, '\\p{Arabic}')::INTEGER AS scripts
FROM documents WHERE text IS NOT NULL""")
def x_scripts(spark, root):
    """How many of the six scripts each document is written in, and whether it leaves ASCII."""
    t = table(spark, root, "documents").where("text is not null")
    return t.select("doc_id", F.col("text").rlike(r"[^\x00-\x7F]").alias("beyond_ascii"), F.size(text.scripts(F.col("text"))).alias("scripts"))


@query("""
SELECT DISTINCT match_id, CASE WHEN length(value) <= 4 THEN repeat('*', length(value))
  ELSE left(value, least(4, length(value) // 3)::INTEGER) || repeat('*', least(16, length(value) - least(4, length(value) // 3))::INTEGER) END AS masked
FROM file_secret_matches WHERE value IS NOT NULL""")
def x_mask(spark, root):
    return table(spark, root, "file_secret_matches").where("value is not null").select("match_id", packages.mask(F.col("value")).alias("masked")).distinct()


_METRIC = lambda m: f"regexp_extract(vec, '/{m}:([A-Z])', 1)"
_W = lambda m, t: "CASE " + _METRIC(m) + "".join(f" WHEN '{k}' THEN {w}::DOUBLE" for k, w in t.items()) + " END"
_CVSS = f"""
vec AS (SELECT delivery_id, u.ord, u.s.score AS vec FROM (SELECT delivery_id, unnest(list_zip(severity, range(1, len(severity) + 1))) AS z FROM osv_vulnerability) q, LATERAL (SELECT z[1] AS s, z[2] AS ord) u),
w AS (SELECT delivery_id, ord, vec, {_W('AV', cvss.V3['AV'])} AS av, {_W('AC', cvss.V3['AC'])} AS ac, {_W('UI', cvss.V3['UI'])} AS ui, {_METRIC('S')} AS s,
  CASE WHEN {_METRIC('S')} = 'C' THEN {_W('PR', cvss.V3_PRIVILEGES['C'])} ELSE {_W('PR', cvss.V3_PRIVILEGES['U'])} END AS pr,
  1 - (1 - {_W('C', cvss.V3['C'])}) * (1 - {_W('I', cvss.V3['I'])}) * (1 - {_W('A', cvss.V3['A'])}) AS iss
  FROM vec WHERE vec LIKE 'CVSS:3%'),
i AS (SELECT *, CASE WHEN s = 'C' THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15.0) ELSE 6.42 * iss END AS impact, 8.22 * av * ac * pr * ui AS reach FROM w),
r AS (SELECT *, floor(least(CASE WHEN s = 'C' THEN 1.08 * (impact + reach) ELSE impact + reach END, 10.0) * 100000 + 0.5) AS h FROM i),
scored AS (SELECT delivery_id, ord, vec, CASE WHEN impact IS NULL OR reach IS NULL THEN NULL WHEN impact <= 0 THEN 0.0::DOUBLE
  WHEN h::BIGINT % 10000 = 0 THEN h / 100000.0 ELSE (floor(h / 10000) + 1) / 10.0 END AS score FROM r),
best AS (SELECT delivery_id, max(score) AS score FROM scored GROUP BY delivery_id),
rated AS (SELECT o.delivery_id, b.score, coalesce(CASE WHEN b.score >= 9 THEN 'critical' WHEN b.score >= 7 THEN 'high' WHEN b.score >= 4 THEN 'medium' WHEN b.score > 0 THEN 'low' WHEN b.score = 0 THEN 'none' END,
  CASE upper(o.database_specific.severity) WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low' WHEN 'MODERATE' THEN 'medium' WHEN 'MEDIUM' THEN 'medium' ELSE 'unknown' END) AS severity
  FROM osv_vulnerability o LEFT JOIN best b USING (delivery_id))"""


@query(f"WITH {_CVSS} SELECT delivery_id, score, severity FROM rated")
def x_cvss(spark, root):
    """Base score and severity of each delivery, from its best vector or else its label."""
    return advisories.rated(table(spark, root, "osv_vulnerability")).select("delivery_id", "score", "severity")


@query(f"WITH {_CVSS} SELECT s.severity, count(r.delivery_id) AS deliveries FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('none'), ('unknown')) s(severity) LEFT JOIN rated r USING (severity) GROUP BY s.severity")
def a_severity(spark, root):
    """Deliveries by severity, all six buckets whether empty or not."""
    rated = advisories.rated(table(spark, root, "osv_vulnerability")).groupBy("severity").agg(F.count("*").alias("n"))
    buckets = spark.createDataFrame([(s,) for s in ("critical", "high", "medium", "low", "none", "unknown")], "severity string")
    return buckets.join(rated, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("deliveries"))


@query(f"""
WITH v AS (SELECT DISTINCT ecosystem, name, version, {_vk('version', 'ecosystem')} AS k FROM dependency_nodes WHERE ecosystem IS NOT NULL AND name IS NOT NULL AND version IS NOT NULL)
SELECT ecosystem, name, arg_min(version, (k, version)) FILTER (k IS NOT NULL) AS lowest, arg_max(version, (k, version)) FILTER (k IS NOT NULL) AS highest, count(*) AS versions FROM v GROUP BY ecosystem, name""")
def x_version_order(spark, root):
    """Lowest and highest version of each package, pre-releases before releases."""
    t = table(spark, root, "dependency_nodes").where("ecosystem is not null and name is not null and version is not null").select("ecosystem", "name", "version").distinct()
    k = versions.sort_key(F.col("version"), F.col("ecosystem"))
    key = F.when(k.isNotNull(), F.struct(k.alias("k"), F.col("version").alias("v")))
    return t.groupBy("ecosystem", "name").agg(F.min(key).v.alias("lowest"), F.max(key).v.alias("highest"), F.count("*").alias("versions"))


@query(f"""
SELECT DISTINCT ecosystem, name, version, CASE WHEN ecosystem = 'npm' AND regexp_matches(version, '{_SEMANTIC}') THEN regexp_extract(version, '{_SEMANTIC}', 4) <> '' ELSE regexp_matches(regexp_replace(version, '^v', ''), '[A-Za-z]') END AS prerelease
FROM dependency_nodes WHERE version IS NOT NULL""")
def x_prerelease(spark, root):
    """Which versions are pre-releases."""
    t = table(spark, root, "dependency_nodes").where("version is not null")
    return t.select("ecosystem", "name", "version", F.coalesce(versions.is_prerelease(F.col("version"), F.col("ecosystem")), F.lit(False)).alias("prerelease")).distinct()


# a token for DuckDB: comments, strings, templates, names, numbers, single characters
_TOKEN = r"""//[^\n\r]*|/\*(?:[^*]|\*+[^*/])*\*+/|"(?:[^"\\\n\r]|\\[\s\S])*"|'(?:[^'\\\n\r]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|[A-Za-z_$][\w$]*|[0-9][\w.]*|[^\s\w]""".replace("'", "''")
_LEXED = f"""
toks AS (SELECT file_id, list_filter(regexp_extract_all(content, '{_TOKEN}'), lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*')) AS t FROM source_files WHERE content IS NOT NULL),
lex AS (SELECT file_id, ';' || chr(1) || array_to_string(t, chr(1)) || chr(1) AS x FROM toks
  WHERE len(list_filter(t, lambda c: c = '(')) = len(list_filter(t, lambda c: c = ')')) AND len(list_filter(t, lambda c: c = '[')) = len(list_filter(t, lambda c: c = ']')) AND len(list_filter(t, lambda c: c = '{{')) = len(list_filter(t, lambda c: c = '}}'))),
mods AS (SELECT DISTINCT file_id, x AS specifier FROM (
  SELECT file_id, unnest(regexp_extract_all(x, '\\x01import\\x01["'']([^"''\\\\\\x01]+)["'']\\x01', 1)) AS x FROM lex
  UNION ALL SELECT file_id, unnest(regexp_extract_all(x, '\\x01(?:import|export)\\x01(?:[^;"''`=()\\x01]+\\x01)*?from\\x01["'']([^"''\\\\\\x01]+)["'']\\x01', 1)) FROM lex
  UNION ALL SELECT file_id, unnest(regexp_extract_all(x, '(?:[^.]\\x01require|\\x01import)\\x01\\(\\x01["'']([^"''\\\\\\x01]+)["'']\\x01', 1)) FROM lex))"""


@query(f"""
WITH {_LEXED}
SELECT file_id, specifier, regexp_extract(specifier, '^(@[^/]+/[^/]+|[^@/][^/]*)', 1) AS package FROM mods
WHERE specifier NOT LIKE '.%' AND specifier NOT LIKE '/%' AND specifier NOT LIKE 'node:%'""")
def d_imports(spark, root):
    """Packages that source files import."""
    t = table(spark, root, "source_files").where("content is not null").select("file_id", F.explode(detectors.imported(F.col("content"))).alias("specifier"))
    return t.withColumn("package", packages.specifier_package(F.col("specifier"))).where("package is not null").distinct()


@query(f"""
WITH {_LEXED}
SELECT file_id, 'child-process' AS signal FROM mods WHERE specifier IN ('child_process', 'node:child_process', 'vm', 'node:vm')
UNION SELECT file_id, 'network' FROM mods WHERE specifier IN ('http', 'https', 'net', 'dgram', 'dns', 'tls', 'node:http', 'node:https', 'node:net', 'node:dns')
UNION SELECT file_id, 'network' FROM lex WHERE regexp_matches(x, '[^.]\\x01fetch\\x01\\(')
UNION SELECT file_id, 'dynamic-eval' FROM lex WHERE regexp_matches(x, '[^.]\\x01eval\\x01\\(|\\x01new\\x01Function\\x01')
UNION SELECT file_id, 'env-access' FROM lex WHERE regexp_matches(x, '[^.]\\x01process\\x01(\\.\\x01env|\\[\\x01["'']env["'']\\x01\\])\\x01')
UNION SELECT file_id, 'obfuscation' FROM lex WHERE regexp_matches(x, '[^.]\\x01Buffer\\x01\\.\\x01from\\x01\\(\\x01([^;\\x01]+\\x01)*?["'']base64["'']\\x01')""")
def d_code_signals(spark, root):
    """What source files can do: start processes, evaluate, reach the network or environment."""
    return table(spark, root, "source_files").where("content is not null").select("file_id", F.explode(detectors.code_signals(F.col("content"))).alias("signal"))


def _scripts_sql() -> str:
    cols = ", ".join("CASE WHEN regexp_matches(command, '{}') THEN '{}' END".format(p.replace("'", "''"), n) for n, p in detectors.SCRIPT_RULES)
    hooks = ", ".join(f"'{h}'" for h in detectors.INSTALL_HOOKS)
    return f"""
WITH ok AS (SELECT DISTINCT record_id, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
v AS (SELECT record_id, value AS x, coalesce(CASE WHEN json_type(j, '$.versions') = 'OBJECT' THEN key END, value->>'version') AS version FROM ok, json_each(j, '$.versions')),
s AS (SELECT DISTINCT record_id, version, e.key AS hook, e.value->>'$' AS command FROM v, json_each(x, '$.scripts') e WHERE json_type(x, '$.scripts') = 'OBJECT')
SELECT record_id, version, hook, array_to_string(list_filter([{cols}], lambda x: x IS NOT NULL), ',') AS does FROM s WHERE hook IN ({hooks}) AND command IS NOT NULL"""


@query(_scripts_sql())
def d_install_scripts(spark, root):
    """Install hooks of packument versions with what their commands do."""
    s = spark.sql("""
      SELECT DISTINCT record_id, coalesce(v.key, try_variant_get(v.value, '$.version', 'string')) AS version, s.key AS hook, try_variant_get(s.value, '$', 'string') AS command
      FROM (SELECT record_id, variant_get(try_parse_json(payload), '$.versions') AS vs FROM {docs}), LATERAL variant_explode(vs) v, LATERAL variant_explode(variant_get(v.value, '$.scripts')) s""", docs=table(spark, root, "registry_docs"))
    return s.where(F.col("hook").isin(detectors.INSTALL_HOOKS) & F.col("command").isNotNull()).select("record_id", "version", "hook", F.array_join(detectors.script_labels(F.col("command")), ",").alias("does"))


# --- aggregates, windows, order -----------------------------------------------------------


@query("""
WITH n AS (SELECT project_id, package_key, coalesce(bool_or(direct), false) AS direct, min(depth) AS depth FROM dependency_nodes GROUP BY 1, 2),
s AS (SELECT project_id, package_key, list_sort(list(DISTINCT x)) AS l FROM (SELECT project_id, package_key, unnest(scopes) AS x FROM dependency_nodes) WHERE x IS NOT NULL GROUP BY 1, 2),
d AS (SELECT project_id, package_key, list_sort(list(DISTINCT x)) AS l FROM (SELECT project_id, package_key, unnest(dependencies) AS x FROM dependency_nodes) WHERE x IS NOT NULL GROUP BY 1, 2),
p AS (SELECT project_id, package_key, list_sort(list(DISTINCT x)) AS l FROM (SELECT project_id, package_key, unnest(parents) AS x FROM dependency_nodes) WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT n.project_id, n.package_key, n.direct, n.depth, coalesce(array_to_string(s.l, ' '), '') AS scopes, coalesce(array_to_string(d.l, ' '), '') AS dependencies, coalesce(array_to_string(p.l, ' '), '') AS parents
FROM n LEFT JOIN s USING (project_id, package_key) LEFT JOIN d USING (project_id, package_key) LEFT JOIN p USING (project_id, package_key)""")
def a_merge_nodes(spark, root):
    """Rows of one package of a project as one."""
    m = graph.merge_nodes(table(spark, root, "dependency_nodes"))
    return m.select("project_id", "package_key", "direct", "depth", *[F.array_join(c, " ").alias(c) for c in ("scopes", "dependencies", "parents")])


@query("""
WITH n AS (SELECT project_id, package_key, coalesce(bool_or(direct), false) AS direct, min(depth) AS depth, count(*) AS c FROM dependency_nodes GROUP BY 1, 2)
SELECT project_id, count(*) AS total, count_if(direct) AS direct, count_if(NOT direct) AS transitive, max(depth) AS max_depth,
  (SELECT count(DISTINCT package_key) FROM dependency_nodes d WHERE d.project_id IS NOT DISTINCT FROM n.project_id AND ecosystem = 'npm') AS npm FROM n GROUP BY project_id""")
def a_summary(spark, root):
    """Sizes and depths of the projects' graphs."""
    s = graph.summary(table(spark, root, "dependency_nodes"))
    return s.select("project_id", "total", "direct", "transitive", "max_depth", F.coalesce(F.try_element_at("by_ecosystem", F.lit("npm")), F.lit(0)).alias("npm"))


@query("""
SELECT id, arg_max(delivery_id, (coalesce(epoch_us(fetched_at), -1), delivery_id)) AS delivery_id, count(*) AS deliveries FROM osv_vulnerability GROUP BY id""")
def w_latest_delivery(spark, root):
    """The last delivery of each advisory, and how many there were."""
    t = table(spark, root, "osv_vulnerability").select("id", "delivery_id", "fetched_at")
    return t.groupBy("id").agg(F.max(F.struct("fetched_at", "delivery_id")).delivery_id.alias("delivery_id"), F.count("*").alias("deliveries"))


@query("""
WITH tree AS (SELECT repo, path, max(file_id) AS file_id FROM source_files WHERE "commit" IS NULL GROUP BY repo, path),
past AS (SELECT repo, path, max(file_id) AS file_id FROM source_files WHERE "commit" IS NOT NULL GROUP BY repo, path)
SELECT repo, path, file_id, 'tree' AS place FROM tree
UNION ALL SELECT repo, path, file_id, 'history' FROM past WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.repo = past.repo AND t.path = past.path)""")
def w_prefer_tree(spark, root):
    """A file of the working tree where there is one, else the last of history."""
    t = table(spark, root, "source_files").select("repo", "path", "file_id", "commit")
    tree = relational.keep_last(t.where("commit is null").select("repo", "path", "file_id"), ["repo", "path"], F.col("file_id")).withColumn("place", F.lit("tree"))
    past = relational.keep_last(t.where("commit is not null").select("repo", "path", "file_id"), ["repo", "path"], F.col("file_id")).withColumn("place", F.lit("history"))
    return relational.prefer(tree, past, ["repo", "path"])


@query("""
WITH l AS (SELECT file_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (SELECT file_id, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS lines FROM source_files WHERE content IS NOT NULL)),
s AS (SELECT file_id, n, line, last_value(CASE WHEN regexp_matches(line, '^\\[[^\\]]+\\]$') THEN line END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT file_id, n::INTEGER AS line_no, section, regexp_extract(line, '^\\s*([A-Za-z_][\\w.-]*)\\s*[=:]', 1) AS name FROM s WHERE regexp_matches(line, '^\\s*[A-Za-z_][\\w.-]*\\s*[=:]')""")
def w_fill_sections(spark, root):
    """The section each setting stands in, carried forward line by line."""
    f = table(spark, root, "source_files").where(F.col("content").isNotNull())
    lines = f.select("file_id", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("n", "line"))
    marked = lines.withColumn("section", F.when(F.col("line").rlike(r"^\[[^\]]+\]$"), F.col("line")))
    name = r"^\s*([A-Za-z_][\w.-]*)\s*[=:]"
    filled = relational.fill_forward(marked, ["file_id"], ["n"], ["section"])
    return filled.where(F.col("line").rlike(name)).select("file_id", (F.col("n") + 1).alias("line_no"), "section", F.regexp_extract("line", name, 1).alias("name"))


@query("""
SELECT repo, file_id, rank FROM (SELECT repo, file_id, row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC NULLS LAST, file_id)::INTEGER AS rank FROM source_files) WHERE rank <= 3""")
def o_top_files(spark, root):
    """The three files of each repository that were committed last."""
    t = table(spark, root, "source_files").select("repo", "file_id", "committed_at")
    w = Window.partitionBy("repo").orderBy(F.desc_nulls_last("committed_at"), "file_id")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("repo", "file_id", "rank")


@query("""
WITH c AS (SELECT snapshot_id, count(DISTINCT project_id || '/' || fingerprint) AS findings, count(DISTINCT CASE WHEN level = 'error' THEN project_id || '/' || fingerprint END) AS errors FROM finding_snapshots WHERE fingerprint IS NOT NULL GROUP BY snapshot_id)
SELECT snapshot_id, findings, errors, findings - lag(findings) OVER (ORDER BY snapshot_id) AS change FROM c""")
def w_trend(spark, root):
    """Findings of each snapshot and the change from the one before."""
    t = table(spark, root, "finding_snapshots").where("fingerprint is not null and project_id is not null")
    one = t.groupBy("snapshot_id", "project_id", "fingerprint").agg(F.bool_or(F.col("level") == "error").alias("e"))
    c = one.groupBy("snapshot_id").agg(F.count("*").alias("findings"), F.count_if("e").alias("errors"))
    return c.withColumn("change", F.col("findings") - F.lag("findings").over(Window.orderBy("snapshot_id")))


@query("""
WITH r AS (SELECT rule_id, level, title, row_number() OVER (PARTITION BY rule_id ORDER BY snapshot_id, project_id, fingerprint, ingested_at, title, level) AS n FROM finding_snapshots WHERE rule_id IS NOT NULL)
SELECT rule_id, level, title, CASE level WHEN 'error' THEN '8.0' WHEN 'warning' THEN '4.0' ELSE '1.0' END AS security_severity FROM r WHERE n = 1""")
def k_sarif_rules(spark, root):
    """The rule descriptions of a report: the first finding of each rule describes it."""
    t = table(spark, root, "finding_snapshots").where("rule_id is not null")
    first = t.groupBy("rule_id").agg(F.min(F.struct(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in ("snapshot_id", "project_id", "fingerprint", "ingested_at")]).alias("o"), "title", "level")).alias("f"))
    sev = F.when(F.col("f.level") == "error", "8.0").when(F.col("f.level") == "warning", "4.0").otherwise("1.0")
    return first.select("rule_id", "f.level", "f.title", sev.alias("security_severity"))


@query("""
SELECT project_id, package_key, 'SPDXRef-Package-' || (row_number() OVER (PARTITION BY project_id ORDER BY package_key) - 1) AS spdx_id
FROM (SELECT DISTINCT project_id, package_key FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL)""")
def k_spdx_ids(spark, root):
    """Stable identifiers of the packages of each project's bill of materials."""
    t = table(spark, root, "dependency_nodes").where("project_id is not null and package_key is not null").select("project_id", "package_key").distinct()
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("package_key")) - 1
    return t.select("project_id", "package_key", F.concat(F.lit("SPDXRef-Package-"), n.cast("string")).alias("spdx_id"))


@query("""
SELECT project_id, substring(sha256(string_agg(package_key, chr(10) ORDER BY package_key)), 1, 32) AS document_id
FROM (SELECT DISTINCT project_id, package_key FROM dependency_nodes WHERE package_key IS NOT NULL) GROUP BY project_id""")
def k_document_id(spark, root):
    """An identifier of each project's bill of materials that depends on its packages only."""
    from .reports import document_ids

    return document_ids(table(spark, root, "dependency_nodes"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS events FROM events GROUP BY 1")
def t_hourly_events(spark, root):
    """Events by hour; the streaming form of the same window is in lodetrace.streaming."""
    return table(spark, root, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("events"))


# --- joins, sets, graphs ------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT DISTINCT ecosystem, name, version, lower(ecosystem) AS eco, CASE WHEN lower(ecosystem) = 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g') ELSE name END AS nn FROM dependency_nodes WHERE name IS NOT NULL AND version IS NOT NULL),
a0 AS (SELECT id, unnest(affected) AS a FROM osv_vulnerability WHERE withdrawn IS NULL AND id IS NOT NULL),
a AS (SELECT id, lower(a.package.ecosystem) AS eco, CASE WHEN lower(a.package.ecosystem) = 'pypi' THEN regexp_replace(lower(a.package.name), '[-_.]+', '-', 'g') ELSE a.package.name END AS nn, a.ranges AS ranges, a.versions AS vs, row_number() OVER () AS k FROM a0 WHERE a IS NOT NULL),
j AS (SELECT p.ecosystem, p.name, p.version, a.id, a.k, a.ranges, a.vs FROM p JOIN a ON a.eco = p.eco AND a.nn = p.nn),
r AS (SELECT ecosystem, name, version, id, k, unnest(ranges) AS r, generate_subscripts(ranges, 1) AS ri FROM j),
e AS (SELECT ecosystem, name, version, id, k, ri, unnest(r.events) AS e, generate_subscripts(r.events, 1) AS ei FROM r WHERE r IS NOT NULL AND coalesce(r.type, '') <> 'GIT'),
x AS (SELECT *, e['introduced'] AS i, e['fixed'] AS f, e['last_affected'] AS l FROM e WHERE e IS NOT NULL),
s AS (SELECT *, CASE WHEN i IS NOT NULL AND (i = '0' OR {_vk('i', 'ecosystem')} <= {_vk('version', 'ecosystem')}) THEN 1 WHEN f IS NOT NULL AND {_vk('f', 'ecosystem')} <= {_vk('version', 'ecosystem')} THEN 0 WHEN l IS NOT NULL AND {_vk('l', 'ecosystem')} < {_vk('version', 'ecosystem')} THEN 0 END AS st FROM x),
inside AS (SELECT ecosystem, name, version, id, k, ri, arg_max(st, ei) AS st FROM s WHERE st IS NOT NULL GROUP BY ALL)
SELECT DISTINCT ecosystem, name, version, id FROM (SELECT ecosystem, name, version, id FROM inside WHERE st = 1 UNION ALL SELECT ecosystem, name, version, id FROM j WHERE list_contains(vs, version))""")
def j_vulnerable(spark, root):
    """Package versions of all projects that advisories cover."""
    return advisories.vulnerable(table(spark, root, "dependency_nodes"), table(spark, root, "osv_vulnerability"))


@query("""
SELECT DISTINCT delivery_id, o.id FROM (SELECT delivery_id, id, unnest(list_append(coalesce(aliases, []), id)) AS x FROM osv_vulnerability) o
JOIN kev_feed k ON upper(regexp_replace(k.cve_id, '\\s+', '', 'g')) = upper(regexp_replace(o.x, '\\s+', '', 'g'))""")
def j_exploited(spark, root):
    """Deliveries that name an exploited flaw among their identifiers."""
    return advisories.exploited(table(spark, root, "osv_vulnerability"), table(spark, root, "kev_feed")).select("delivery_id", "id")


@query("""
WITH a AS (SELECT id, unnest(affected) AS a FROM osv_vulnerability WHERE withdrawn IS NULL AND id IS NOT NULL),
r AS (SELECT id, lower(a.package.ecosystem) AS eco, CASE WHEN lower(a.package.ecosystem) = 'pypi' THEN regexp_replace(lower(a.package.name), '[-_.]+', '-', 'g') ELSE a.package.name END AS name, unnest(a.ranges) AS r FROM a WHERE a IS NOT NULL AND a.package.name IS NOT NULL),
e AS (SELECT id, eco, name, unnest(r.events) AS e FROM r WHERE r IS NOT NULL)
SELECT DISTINCT id, eco, name, e['fixed'] AS fixed FROM e WHERE e['fixed'] IS NOT NULL""")
def j_fixed_versions(spark, root):
    """Versions in which advisories say a package is fixed."""
    return advisories.fixed_versions(table(spark, root, "osv_vulnerability"))


@query("""
WITH used AS (SELECT lower(name) AS target, count(DISTINCT project_id) AS c FROM dependency_nodes WHERE name IS NOT NULL GROUP BY lower(name) HAVING count(DISTINCT project_id) >= 2),
pop AS (SELECT target, row_number() OVER (ORDER BY c DESC, target) AS rank FROM used),
n AS (SELECT DISTINCT name FROM (SELECT name FROM registry_docs UNION SELECT package_name FROM documents UNION SELECT name FROM dependency_nodes) WHERE name IS NOT NULL AND lower(name) NOT IN (SELECT target FROM pop)),
c AS (SELECT n.name, target, rank, levenshtein(lower(n.name), target) AS d FROM n, pop WHERE length(target) >= 5 AND abs(length(n.name) - length(target)) <= 2)
SELECT name, target, d::INTEGER AS distance FROM c WHERE d <= CASE WHEN least(length(name), length(target)) >= 7 THEN 2 ELSE 1 END
QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, rank, target) = 1""")
def j_lookalikes(spark, root):
    """Names of all tables within two edits of a name that two or more projects use."""
    d = table(spark, root, "dependency_nodes").where("name is not null")
    used = d.groupBy(F.lower("name").alias("name")).agg(F.countDistinct("project_id").alias("c")).where("c >= 2")
    ranked = relational.row_numbers(used.withColumn("neg", -F.col("c")), "neg", "name", name="rank").select("name", "rank")
    names = table(spark, root, "registry_docs").select("name").unionByName(table(spark, root, "documents").select(F.col("package_name").alias("name"))).unionByName(d.select("name"))
    return lookalike.lookalikes(names, ranked)


@query("SELECT DISTINCT name FROM registry_docs WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM dependency_nodes WHERE name IS NOT NULL)")
def j_unused_names(spark, root):
    """Registry names no project depends on (anti join)."""
    used = table(spark, root, "dependency_nodes").select("name").distinct()
    return table(spark, root, "registry_docs").where("name is not null").select("name").distinct().join(used, "name", "left_anti")


@query("SELECT DISTINCT project_id FROM finding_snapshots WHERE project_id IN (SELECT project_id FROM dependency_nodes)")
def j_projects_with_both(spark, root):
    """Projects that have findings and dependencies (semi join)."""
    return table(spark, root, "finding_snapshots").select("project_id").distinct().join(table(spark, root, "dependency_nodes").select("project_id").distinct(), "project_id", "left_semi")


@query("""
WITH RECURSIVE n AS (SELECT project_id AS g, package_key AS k, coalesce(bool_or(direct), false) AS direct FROM dependency_nodes WHERE project_id IS NOT NULL AND package_key IS NOT NULL GROUP BY 1, 2),
raw AS (SELECT project_id AS g, package_key AS a, unnest(dependencies) AS b FROM dependency_nodes UNION SELECT project_id, unnest(parents), package_key FROM dependency_nodes),
l AS (SELECT g, a, b FROM raw JOIN n n1 USING (g) JOIN n n2 USING (g) WHERE n1.k = a AND n2.k = b),
size AS (SELECT g, count(*) AS c FROM n GROUP BY g),
w AS (SELECT g, k, 0 AS d FROM n WHERE direct
      UNION SELECT w.g, l.b, w.d + 1 FROM w JOIN l ON l.g = w.g AND l.a = w.k JOIN size s ON s.g = w.g WHERE w.d < s.c),
best AS (SELECT g, k, (min(d) + 1)::INTEGER AS depth FROM w GROUP BY g, k)
SELECT g AS project_id, k AS package_key, coalesce(depth, CASE WHEN direct THEN 1 ELSE 2 END)::INTEGER AS depth FROM n LEFT JOIN best USING (g, k)""")
def g_levels(spark, root):
    """Depth of each package from its project's direct dependencies, those being 1; packages
    that none of them reaches count as 2."""
    from .dependencies import package_links

    from ..operators.hierarchy import clean_links

    nodes, links = clean_links(*package_links(spark, root))
    seeds = table(spark, root, "dependency_nodes").where("direct").select(F.col("project_id").alias("grp"), F.col("package_key").alias("node"))
    reached = graph.levels(seeds, links)
    return nodes.join(reached, ["grp", "node"], "left").select(F.col("grp").alias("project_id"), F.col("node").alias("package_key"), (F.coalesce("depth", F.lit(1)) + 1).alias("depth"))


@query("""
SELECT source, kind, count(*) AS findings FROM (
  SELECT 'advisory' AS source, 'vulnerability' AS kind FROM (SELECT DISTINCT id FROM osv_vulnerability)
  UNION ALL SELECT 'scanner', kind FROM (SELECT DISTINCT match_id, kind FROM file_secret_matches)
  UNION ALL SELECT 'snapshot', category FROM (SELECT DISTINCT project_id, fingerprint, category FROM finding_snapshots WHERE fingerprint IS NOT NULL)) GROUP BY source, kind""")
def u_findings(spark, root):
    """All streams of findings as one (union all), counted by kind."""
    a = table(spark, root, "osv_vulnerability").select("id").distinct().select(F.lit("advisory").alias("source"), F.lit("vulnerability").alias("kind"))
    b = table(spark, root, "file_secret_matches").select("match_id", "kind").distinct().select(F.lit("scanner").alias("source"), "kind")
    c = table(spark, root, "finding_snapshots").where("fingerprint is not null").select("project_id", "fingerprint", "category").distinct().select(F.lit("snapshot").alias("source"), F.col("category").alias("kind"))
    return a.unionByName(b).unionByName(c).groupBy("source", "kind").agg(F.count("*").alias("findings"))


@query("""
WITH ok AS (SELECT DISTINCT record_id, ecosystem, payload::JSON AS j FROM registry_docs WHERE json_valid(payload)),
n AS (SELECT record_id, coalesce(j->>'$.name', j->>'$.info.name') AS name, coalesce(j->>'$."dist-tags".latest', j->>'$.info.version') AS latest, j->>'$.time.created' AS created,
  CASE WHEN json_type(j, '$.maintainers') = 'ARRAY' THEN json_array_length(j, '$.maintainers') END::INTEGER AS maintainers FROM ok)
SELECT * FROM n""")
def s_registry_metadata(spark, root):
    """Name, latest version, creation time and number of maintainers of registry documents."""
    return spark.sql("""
      SELECT record_id, coalesce(try_variant_get(j, '$.name', 'string'), try_variant_get(j, '$.info.name', 'string')) AS name,
             coalesce(try_variant_get(j, '$["dist-tags"].latest', 'string'), try_variant_get(j, '$.info.version', 'string')) AS latest,
             try_variant_get(j, '$.time.created', 'string') AS created,
             size(try_variant_get(j, '$.maintainers', 'array<variant>')) AS maintainers
      FROM (SELECT record_id, try_parse_json(payload) AS j FROM (SELECT DISTINCT record_id, ecosystem, payload FROM {docs})) WHERE j IS NOT NULL""", docs=table(spark, root, "registry_docs"))
