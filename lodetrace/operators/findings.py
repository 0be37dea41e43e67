"""Detectors' results as findings: one schema for vulnerabilities, credentials, unused packages,
licences and suspicious packages, and the tables behind them.

Every finding has stream (the detector's place in an audit), project_id, rule_id, level, category,
title, message, uri, start_line, fingerprint, ecosystem, name, version, remediation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors, packages, text, versions
from ..sources.reference_lists import CREDENTIAL_SERVICES, PACKAGE_SERVICES, PREFIX_SERVICES
from ..storage import cut
from . import advisories, relational
from .lookalike import lookalikes
from .registry import package_metadata, packument_versions

TOOL = "lodetrace"
FINDING = {
    "stream": "int", "project_id": "string", "rule_id": "string", "level": "string", "category": "string", "title": "string", "message": "string", "uri": "string", "start_line": "int",
    "fingerprint": "string", "ecosystem": "string", "name": "string", "version": "string", "remediation": "string",
}
_TEXTS = "array<string>"


def _finding(df: DataFrame, stream: int, **columns: Column | str) -> DataFrame:
    given = {"stream": F.lit(stream), **columns}
    return df.select(*[F.lit(given.get(c)).cast(t).alias(c) if not isinstance(given.get(c), Column) else given[c].cast(t).alias(c) for c, t in FINDING.items()])


def union_findings(*streams: DataFrame) -> DataFrame:
    """All streams as one (union all), each row with its stream's number."""
    return reduce(DataFrame.unionByName, streams)


# --- vulnerabilities ----------------------------------------------------------------------


def latest_advisories(osv: DataFrame) -> DataFrame:
    """The last delivery of each advisory: the latest fetch, then the greatest delivery_id."""
    last = osv.where("id is not null").groupBy("id").agg(F.max(F.struct("fetched_at", "delivery_id")).delivery_id.alias("delivery_id"))
    return osv.join(last.select("delivery_id"), "delivery_id", "left_semi")


def level_of(severity: Column, exploited: Column) -> Column:
    """error for exploited, critical and high flaws, warning for medium ones, else note."""
    return F.when(exploited | severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def vulnerabilities(nodes: DataFrame, osv: DataFrame, kev: DataFrame) -> DataFrame:
    """(ecosystem, name, version, id, cve, summary, score, severity, exploited, malicious, level,
    fixed, lowest_fixed) of every package version that an advisory covers.

    The last delivery of an advisory holds; one that was withdrawn covers nothing. An advisory of
    malware (by its id, an alias or its flag) is critical whatever its score. `fixed` are the
    versions in which the package's own entries say it is fixed.
    """
    last = latest_advisories(osv)
    hits = advisories.vulnerable(nodes, last)
    none = F.array().cast(_TEXTS)
    known = advisories.exploited(last, kev).select("id", F.lit(True).alias("exploited"))
    about = last.select("id", "summary", F.coalesce("aliases", none).alias("aliases"), F.col("database_specific.malicious").alias("flag")).join(advisories.rated(last).select("id", "score", "severity"), "id").join(known, "id", "left")
    malicious = F.col("id").startswith("MAL-") | F.exists("aliases", lambda a: F.coalesce(a.startswith("MAL-"), F.lit(False))) | F.coalesce("flag", F.lit(False))
    cve = F.coalesce(F.get(F.filter("aliases", lambda a: F.coalesce(a.startswith("CVE-"), F.lit(False))), F.lit(0)), F.col("id"))
    about = about.select("id", "summary", cve.alias("cve"), "score", malicious.alias("malicious"), F.when(malicious, "critical").otherwise(F.col("severity")).alias("severity"), F.coalesce("exploited", F.lit(False)).alias("exploited"))
    fixed = advisories.fixed_versions(last).where("fixed <> ''").groupBy("id", F.col("eco").alias("_eco"), F.col("name").alias("_name")).agg(F.array_sort(F.collect_set("fixed")).alias("fixed"))
    keyed = hits.withColumn("_eco", F.lower("ecosystem")).withColumn("_name", packages.normal_name(F.col("ecosystem"), F.col("name")))
    v = keyed.join(about, "id").join(fixed, ["id", "_eco", "_name"], "left").withColumn("fixed", F.coalesce("fixed", none))
    return v.select("ecosystem", "name", "version", "id", "cve", "summary", "score", "severity", "exploited", "malicious", level_of(F.col("severity"), F.col("exploited")).alias("level"), "fixed", versions.lowest_listed(F.col("fixed"), F.col("_eco")).alias("lowest_fixed"))


def _rank(c: str, order: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c)), F.lit(0))


def in_severity_order(rows: DataFrame, name: str = "place") -> DataFrame:
    """Vulnerabilities numbered from 0: the worst first, then by package and advisory."""
    keyed = rows.withColumn("_r", _rank("severity", ["critical", "high", "medium", "low", "none", "unknown"])).withColumn("_k", packages.package_key(F.col("ecosystem"), F.col("name"), F.col("version")))
    return relational.row_numbers(cut(keyed), "_r", "_k", "id", name=name).drop("_r", "_k")


def in_plan_order(plan: DataFrame, name: str = "place") -> DataFrame:
    """Updates numbered from 0: those that mend flaws first, then the smallest step, then by name."""
    keyed = plan.withColumn("_f", F.size("fixes") == 0).withColumn("_b", _rank("bump", ["patch", "minor", "major"]))
    return relational.row_numbers(cut(keyed), "_f", "_b", "name", "ecosystem", "version", name=name).drop("_f", "_b")


def reachable_first(rows: DataFrame, name: str = "place") -> DataFrame:
    """Findings with `reachable` numbered from 0: reachable ones first, unknown ones last, each in
    the order of their other keys."""
    keyed = rows.withColumn("_r", F.when(F.col("reachable"), 0).when(~F.col("reachable"), 1).otherwise(2))
    return relational.row_numbers(cut(keyed), "_r", *[c for c in rows.columns if c != "reachable"], name=name).drop("_r")


def vulnerability_summary(rows: DataFrame) -> DataFrame:
    """(severity, vulnerabilities, exploited) of all six severities, whether there are any or not."""
    buckets = rows.sparkSession.createDataFrame([(s,) for s in ("critical", "high", "medium", "low", "none", "unknown")], "severity string")
    got = rows.groupBy("severity").agg(F.count("*").alias("n"), F.count_if("exploited").alias("k"))
    return buckets.join(got, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("vulnerabilities"), F.coalesce("k", F.lit(0)).alias("exploited"))


def vulnerability_findings(rows: DataFrame) -> DataFrame:
    """A finding of each row of `vulnerabilities`: known malware to be removed, or a flaw to be
    mended by an upgrade."""
    key = packages.package_key(F.col("ecosystem"), F.col("name"), F.col("version"))
    bad, at = F.col("malicious"), F.concat_ws("@", "name", "version")
    either = lambda a, b: F.when(bad, a).otherwise(b)
    note = F.concat(F.when(F.col("exploited"), " [known to be exploited]").otherwise(""), F.lit(". Severity: "), F.col("severity"), F.when(F.col("score").isNotNull(), F.concat(F.lit(" (CVSS "), F.col("score").cast("string"), F.lit(")"))).otherwise(""), F.lit("."))
    return _finding(
        rows, 1, rule_id=either(F.lit(f"{TOOL}/malicious-package"), F.concat(F.lit(f"{TOOL}/"), F.col("cve"))), level=either(F.lit("error"), F.col("level")), category=either(F.lit("malicious"), F.lit("vulnerability")),
        title=either(F.concat(F.lit("Known malicious package: "), at), F.concat(F.col("cve"), F.lit(" in "), at)),
        message=either(F.concat(F.coalesce("summary", F.lit("This package is flagged as malware")), F.lit(" ("), F.col("id"), F.lit(").")), F.concat(F.coalesce("summary", "cve"), note)),
        uri=packages.purl(F.col("ecosystem"), F.col("name"), F.col("version")), fingerprint=F.concat_ws("::", either(F.lit("malicious"), F.col("cve")), key), ecosystem=F.col("ecosystem"), name=F.col("name"), version=F.col("version"),
        remediation=F.when(bad, F.concat(F.lit("Remove "), F.col("name"), F.lit(" immediately; it is known malware."))).when(F.col("lowest_fixed").isNull(), F.lit("No fixed version is available yet.")).otherwise(F.concat(F.lit("Upgrade "), F.col("name"), F.lit(" to "), F.col("lowest_fixed"), F.lit(" or later."))),
    )


# --- updates ------------------------------------------------------------------------------


def update_plan(nodes: DataFrame, docs: DataFrame, vulns: DataFrame) -> DataFrame:
    """(ecosystem, name, version, target, bump, fixes, changelog, reason) of every direct package
    that has something to move to.

    Each flaw asks for its lowest fixed version above the current one; the greatest of these is
    the boundary, and the lowest listed version not below it that is no pre-release the target,
    or else the boundary. Without such flaws the target is the current release, if it is newer.
    """
    direct = nodes.where("direct and name is not null and version is not null and ecosystem is not null").select("ecosystem", "name", "version").distinct()
    eco, now = F.lower("ecosystem"), versions.sort_key(F.col("version"), F.lower("ecosystem"))
    above = F.filter("fixed", lambda v: versions.sort_key(v, eco) > now)
    asked = vulns.withColumn("first", versions.lowest(above, eco)).where("first is not null")
    asked = asked.groupBy("ecosystem", "name", "version").agg(F.max(F.struct(versions.sort_key(F.col("first"), eco).alias("k"), F.col("first").alias("v"))).alias("b"), F.array_sort(F.collect_set("id")).alias("fixes"))
    meta = package_metadata(docs)
    m = meta.select(F.lower("ecosystem").alias("_eco"), F.col("key").alias("_key"), "latest", F.col("versions").alias("listed"), "repository")
    d = direct.withColumn("_eco", eco).withColumn("_key", packages.normal_name(F.col("ecosystem"), F.col("name"))).join(m, ["_eco", "_key"]).join(asked, ["ecosystem", "name", "version"], "left")
    fine = F.filter("listed", lambda v: ~versions.is_prerelease(v, eco) & (versions.sort_key(v, eco) >= F.col("b.k")))
    target = F.when(F.col("b").isNotNull(), F.coalesce(versions.lowest(fine, eco), F.col("b.v"))).when(versions.sort_key(F.col("latest"), eco) > now, F.col("latest"))
    p = d.withColumn("target", target).where(versions.sort_key(F.col("target"), eco) > now).withColumn("bump", versions.bump(F.col("version"), F.col("target"))).withColumn("fixes", F.coalesce("fixes", F.array().cast(_TEXTS)))
    told = F.when(F.size("fixes") > 0, F.concat(F.lit(" Resolves "), F.array_join("fixes", ", "), F.lit("."))).otherwise("")
    reason = F.when(F.col("bump") == "major", F.concat(F.lit("Major update, likely breaking; review before applying."), told)).when(F.col("bump") == "minor", F.concat(F.lit("Minor update."), F.when(told != "", told).otherwise(" Keeps the dependency current."))).otherwise(F.concat(F.lit("Patch update, no breaking changes."), told))
    return p.select("ecosystem", "name", "version", "target", "bump", "fixes", packages.changelog_url(F.col("repository")).alias("changelog"), reason.alias("reason"))


def apply_updates(manifests: DataFrame, plan: DataFrame) -> DataFrame:
    """(project_id, name, from, to, section) of every range of manifests(project_id, content) that
    the npm entries of a plan(ecosystem, name, target) move; of several sections the first that
    names the package is changed, and only if its range differs after."""
    sections = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
    t = manifests.select("project_id", F.from_json("content", ", ".join(f"{s} map<string,string>" for s in sections)).alias("j"))
    rows = reduce(DataFrame.unionByName, [t.select("project_id", F.explode(F.col(f"j.{s}")).alias("name", "from"), F.lit(i).alias("place"), F.lit(s).alias("section")) for i, s in enumerate(sections)])
    first = rows.where(F.col("from").isNotNull()).groupBy("project_id", "name").agg(F.min(F.struct("place", "from", "section")).alias("f")).select("project_id", "name", "f.from", "f.section")
    moved = first.join(plan.where(F.lower("ecosystem") == "npm").select("name", "target").distinct(), "name").withColumn("to", packages.bump_range(F.col("from"), F.col("target")))
    return moved.where(F.col("to") != F.col("from")).select("project_id", "name", "from", "to", "section")


# --- credentials --------------------------------------------------------------------------


def secret_scan(matches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(match_id, kind, description, preview, file, line, commit, in_history, breached, breach_count)
    of each credential once: matches of one pattern, value and file are the same; of those in the
    working tree (no commit) the last holds, of those in history the first, and the tree's before
    history's. Values of password rules are looked up in breach ranges(prefix, suffix, count)."""
    m = matches.withColumn("_key", F.struct("pattern_id", "value", "file"))
    cols = ["match_id", "kind", "description", "preview", "file", "line", "commit", "value", "password"]
    packed = F.struct("matched_at", "match_id", *[c for c in cols if c != "match_id"])
    one = m.groupBy("_key").agg(F.max(F.when(F.col("commit").isNull(), packed)).alias("tree"), F.min(F.when(F.col("commit").isNotNull(), packed)).alias("past"))
    s = one.select(F.coalesce("tree", "past").alias("r"), F.col("tree").isNull().alias("in_history")).select("r.*", "in_history")
    found = advisories.breached(s.where("password").select("value"), ranges).select("value", F.col("count").alias("n"))
    b = s.join(found, "value", "left")
    hit = F.when(F.col("password"), F.col("n").isNotNull())
    return b.select("match_id", "kind", "description", "preview", "file", "line", "commit", "in_history", hit.alias("breached"), F.when(F.col("password"), F.col("n")).alias("breach_count"))


def in_report_order(secrets: DataFrame, name: str = "place") -> DataFrame:
    """Secrets numbered from 0: the working tree before history, then by file and line."""
    keyed = secrets.withColumn("_l", F.coalesce("line", F.lit(0)))
    return relational.row_numbers(cut(keyed), "in_history", "file", "_l", "match_id", name=name).drop("_l")


def secret_summary(secrets: DataFrame) -> DataFrame:
    """(total, in_tree, history_only, breached): one row."""
    return secrets.agg(F.count("*").alias("total"), F.count_if(~F.col("in_history")).alias("in_tree"), F.count_if("in_history").alias("history_only"), F.count_if(F.coalesce("breached", F.lit(False))).alias("breached"))


def secret_findings(secrets: DataFrame) -> DataFrame:
    past = F.col("in_history")
    seen = F.when(F.coalesce("breached", F.lit(False)), F.concat(F.lit(" It appears in "), F.col("breach_count").cast("string"), F.lit(" public breaches."))).otherwise("")
    return _finding(
        secrets, 3, rule_id=F.concat(F.lit(f"{TOOL}/secret-"), F.col("kind")), level="error", category="secret", title=F.concat(F.col("description"), F.lit(" in "), F.col("file"), F.when(past, " (history)").otherwise("")),
        message=F.concat(F.col("description"), F.lit(" detected."), seen, F.when(past, " It stays recoverable from history and must be rotated.").otherwise(" Rotate it and remove it from the code.")), uri=F.col("file"), start_line=F.col("line"),
        fingerprint=F.concat_ws(":", "kind", "preview", "file", F.coalesce("commit", F.lit("worktree"))), remediation="Rotate the credential; rewrite history to remove it.",
    )


def leaked_by_service(secrets: DataFrame) -> DataFrame:
    """(service, leaked): credentials by the service their kind belongs to."""
    services = F.create_map(*[F.lit(x) for kv in CREDENTIAL_SERVICES.items() for x in kv])
    return secrets.select(F.try_element_at(services, F.col("kind")).alias("service")).where("service is not null").groupBy("service").agg(F.count("*").alias("leaked"))


# --- packages -----------------------------------------------------------------------------


def unused_packages(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(project_id, name) of direct production packages of npm that no import names; packages of
    types are used without being imported. `imports` has package."""
    d = nodes.where("direct and ecosystem = 'npm' and name is not null and array_contains(scopes, 'production')").select("project_id", "name").distinct()
    return d.where(~F.col("name").startswith("@types/")).join(imports.select(F.col("package").alias("name")).distinct(), "name", "left_anti").select("project_id", "name")


def unused_findings(unused: DataFrame) -> DataFrame:
    n = F.col("name")
    return _finding(unused, 4, project_id=F.col("project_id"), rule_id=f"{TOOL}/unused-dependency", level="note", category="unused-dependency", title=F.concat(F.lit("Unused dependency: "), n), message=F.concat(n, F.lit(" is declared but never imported.")), uri="package.json", fingerprint=F.concat(F.lit("unused:"), n), ecosystem="npm", name=n, remediation=F.concat(F.lit("Remove "), n, F.lit(" if nothing needs it.")))


def package_licences(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, license) of each npm package that a project uses and a registry document describes;
    `UNKNOWN` where none is declared."""
    used = nodes.where("ecosystem = 'npm' and name is not null").select("name").distinct()
    meta = package_metadata(docs).where("ecosystem = 'npm'").select(F.col("key").alias("name"), "license")
    return used.join(meta, "name").select("name", F.when(F.trim(F.coalesce("license", F.lit(""))) == "", "UNKNOWN").otherwise(F.col("license")).alias("license"))


def licence_counts(licences: DataFrame) -> DataFrame:
    """(license, packages, place): packages by licence, the commonest first."""
    counts = licences.groupBy("license").agg(F.count("*").alias("packages")).withColumn("_n", -F.col("packages"))
    return relational.row_numbers(counts, "_n", "license", name="place").drop("_n")


def licence_findings(licences: DataFrame) -> DataFrame:
    n = F.col("name")
    return _finding(
        licences.where("license = 'UNKNOWN'"), 5, rule_id=f"{TOOL}/license-unknown", level="note", category="license", title=F.concat(n, F.lit(": no declared license")), message=F.concat(n, F.lit(" is used but declares no license.")),
        uri=F.concat(F.lit("node_modules/"), n, F.lit("/package.json")), fingerprint=F.concat(F.lit(f"{TOOL}/license-unknown:"), n), ecosystem="npm", name=n, remediation="Review the license or replace the dependency.",
    )


def service_of(name: Column) -> Column:
    """The service a package is a client of: its exact rule, else the first prefix that fits."""
    rule = F.lit(None).cast("string")
    for p, s in reversed(PREFIX_SERVICES):
        rule = F.when(name.startswith(p), F.lit(s)).otherwise(rule)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PACKAGE_SERVICES.items() for x in kv]), name), rule)


def api_surface(nodes: DataFrame, plan: DataFrame, vulns: DataFrame) -> DataFrame:
    """(service, name, version, outdated, major_behind, cves) of every package that is a client
    of a service, once a name (its least version text), with what is known of it by name."""
    n = nodes.where("name is not null").groupBy("name").agg(F.min("version").alias("version")).withColumn("service", service_of(F.col("name"))).where("service is not null")
    p = plan.groupBy("name").agg(F.bool_or(F.col("bump") == "major").alias("major_behind"))
    v = vulns.groupBy("name").agg(F.array_sort(F.collect_set("cve")).alias("cves"))
    out = n.join(p, "name", "left").join(v, "name", "left")
    return out.select("service", "name", "version", F.col("major_behind").isNotNull().alias("outdated"), F.coalesce("major_behind", F.lit(False)).alias("major_behind"), F.coalesce("cves", F.array().cast(_TEXTS)).alias("cves"))


# --- suspicious packages ------------------------------------------------------------------


def package_signals(names: DataFrame, docs: DataFrame, popular: DataFrame) -> DataFrame:
    """(ecosystem, name, signal, level, detail) of each package of names(ecosystem, name): a name
    near a well-known one or with suspicious characters, and what the current version's install
    scripts do (or that there are any)."""
    n = names.where("ecosystem is not null and name is not null").select("ecosystem", "name").distinct()
    near = n.join(lookalikes(n.select("name"), popular), "name").select("ecosystem", "name", F.lit("typosquat").alias("signal"), F.lit("error").alias("level"), F.concat(F.lit("Edit distance "), F.col("distance").cast("string"), F.lit(" from "), F.col("target")).alias("detail"))
    h = text.homoglyph(F.col("name"))
    odd = n.withColumn("h", h).where("h.suspicious").select("ecosystem", "name", F.lit("homoglyph").alias("signal"), F.lit("error").alias("level"), F.col("h.reason").alias("detail"))
    current = package_metadata(docs).where("ecosystem = 'npm'").select(F.col("key").alias("name"), F.col("latest").alias("version"))
    hooks = latest_hooks(docs).join(current, ["name", "version"]).where(F.size("hooks") > 0)
    run = n.where("ecosystem = 'npm'").join(hooks, "name").select("ecosystem", "name", F.explode("hooks").alias("hook", "command")).withColumn("does", detectors.script_labels(F.col("command")))
    bad = run.where(F.size("does") > 0).select("ecosystem", "name", F.lit("install-script").alias("signal"), F.lit("error").alias("level"), F.concat(F.lit("Install script ("), "hook", F.lit(") "), F.array_join("does", "; ")).alias("detail"))
    there = run.groupBy("ecosystem", "name").agg(F.max(F.size("does")).alias("most"), F.array_join(F.array_sort(F.collect_set("hook")), ", ").alias("all")).where("most = 0")
    there = there.select("ecosystem", "name", F.lit("install-script-present").alias("signal"), F.lit("note").alias("level"), F.concat(F.lit("Runs install scripts ("), "all", F.lit(")")).alias("detail"))
    return union_findings(near, odd, bad, there)


def latest_hooks(docs: DataFrame) -> DataFrame:
    """(name, version, hooks) of the packument versions of each package's last document."""
    from .registry import latest_documents

    last = latest_documents(docs)
    return packument_versions(last).join(last.where("ecosystem = 'npm'").select("record_id", F.col("key").alias("name")), "record_id").select("name", "version", "hooks")


def verdicts(signals: DataFrame) -> DataFrame:
    """(ecosystem, name, verdict, signals): flagged by an error, caution by a warning, else clear."""
    rank = F.max(F.when(F.col("level") == "error", 3).when(F.col("level") == "warning", 2).otherwise(1))
    v = signals.groupBy("ecosystem", "name").agg(rank.alias("r"), F.array_sort(F.collect_set("signal")).alias("signals"))
    return v.select("ecosystem", "name", F.when(F.col("r") == 3, "flagged").when(F.col("r") == 2, "caution").otherwise("clear").alias("verdict"), "signals")


def signal_findings(signals: DataFrame) -> DataFrame:
    return _finding(
        signals, 2, rule_id=F.concat(F.lit(f"{TOOL}/"), F.col("signal")), level=F.col("level"), category="malicious", title=F.concat(F.col("signal"), F.lit(": "), F.col("name")), message=F.col("detail"), uri=packages.purl(F.col("ecosystem"), F.col("name"), F.lit("")),
        fingerprint=F.concat(F.lit(f"{TOOL}/"), F.col("signal"), F.lit("::"), F.col("ecosystem"), F.lit(":"), F.col("name")), ecosystem=F.col("ecosystem"), name=F.col("name"),
    )


def version_changes(versions_of: DataFrame, by: Column) -> DataFrame:
    """(record_id, from, to, scripts_changed, dangerous, provenance_lost, verdict) of neighbouring
    versions (in the order `by`) that differ in what matters: install scripts whose command is new
    or another, hooks that do something dangerous and did not before, an attestation that is gone.
    A packument's versions meet in one task; one document is the unit."""
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("_by", "version")
    none = F.create_map().cast("map<string,string>")
    v = versions_of.where("version is not null").withColumn("_by", by)
    v = v.withColumn("from", F.lag("version").over(w)).withColumn("_old", F.lag("hooks").over(w)).withColumn("_prov", F.lag("provenance").over(w)).where(F.col("from").isNotNull())
    old = F.coalesce("_old", none)
    changed = F.array_sort(F.map_keys(F.map_filter("hooks", lambda k, c: ~F.try_element_at(old, k).eqNullSafe(c))))
    risky = lambda m: F.map_keys(F.map_filter(m, lambda k, c: F.size(detectors.script_labels(c)) > 0))
    dangerous = F.array_sort(F.array_except(risky(F.col("hooks")), risky(old)))
    lost = F.col("_prov") & ~F.col("provenance")
    out = v.select("record_id", "from", F.col("version").alias("to"), changed.alias("scripts_changed"), dangerous.alias("dangerous"), lost.alias("provenance_lost"))
    verdict = F.when(F.size("dangerous") > 0, "flagged").when((F.size("scripts_changed") > 0) | F.col("provenance_lost"), "caution").otherwise("clear")
    return out.withColumn("verdict", verdict).where("verdict <> 'clear'")


def change_findings(changes: DataFrame, name: Column) -> DataFrame:
    """A finding of each row of `version_changes`: an error if flagged, else a warning."""
    at = F.concat(name, F.lit("@"), F.col("to"))
    told = F.concat_ws(" ", F.when(F.col("provenance_lost"), "Build provenance was removed."), F.when(F.size("dangerous") > 0, F.concat(F.lit("New dangerous install scripts: "), F.array_join("dangerous", ", "), F.lit("."))), F.when(F.size("scripts_changed") > 0, F.concat(F.lit("Install scripts changed: "), F.array_join("scripts_changed", ", "), F.lit("."))))
    return _finding(
        changes, 2, rule_id=f"{TOOL}/version-diff", level=F.when(F.col("verdict") == "flagged", "error").otherwise("warning"), category="malicious", title=F.concat(F.lit("Suspicious changes in "), at), message=told,
        uri=packages.purl(F.lit("npm"), name, F.col("to")), fingerprint=F.concat(F.lit("version-diff:"), at), ecosystem="npm", name=name, version=F.col("to"),
    )


def not_clear(assessed: DataFrame) -> DataFrame:
    """Assessments with a verdict worth showing."""
    return assessed.where("verdict <> 'clear'")


def check_candidate(name: str, ecosystem: str, docs: DataFrame, popular: DataFrame) -> DataFrame:
    """The signals of one package that is about to be installed, one of them being that no
    registry document describes it."""
    spark = docs.sparkSession
    one = spark.createDataFrame([(ecosystem, name)], "ecosystem string, name string")
    known = package_metadata(docs).select(F.lower("ecosystem").alias("_e"), F.col("key").alias("_k"))
    key = one.withColumn("_e", F.lower("ecosystem")).withColumn("_k", packages.normal_name(F.col("ecosystem"), F.col("name")))
    absent = key.join(known, ["_e", "_k"], "left_anti").select("ecosystem", "name", F.lit("not-found").alias("signal"), F.lit("warning").alias("level"), F.lit("Not in the registry: a typing error or an unpublished name").alias("detail"))
    return package_signals(one, docs, popular).unionByName(absent)


def lint_manifest(names: DataFrame, signals: DataFrame, vulns: DataFrame, unused: DataFrame) -> DataFrame:
    """(name, signals, cves, unused) of every name of a manifest: what detectors, advisories and
    import analysis say of it (left joins by name)."""
    s = signals.groupBy("name").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    v = vulns.groupBy("name").agg(F.array_sort(F.collect_set("cve")).alias("cves"))
    u = unused.select("name").distinct().withColumn("unused", F.lit(True))
    none = F.array().cast(_TEXTS)
    out = names.select("name").distinct().join(s, "name", "left").join(v, "name", "left").join(u, "name", "left")
    return out.select("name", F.coalesce("signals", none).alias("signals"), F.coalesce("cves", none).alias("cves"), F.coalesce("unused", F.lit(False)).alias("unused"))


def maintainer_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """Maintainers added and removed: the identity of one is its name, or else its address; blank
    ones do not count."""
    ids = lambda m: F.array_distinct(F.filter(F.transform(m, lambda x: F.coalesce(x["name"], x["email"])), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.array_sort(F.array_except(ids(new), ids(old))), F.array_sort(F.array_except(ids(old), ids(new)))


def capability_changes(files: DataFrame) -> DataFrame:
    """(name, version, signal, occurrences, files) of files(name, version, content): how often each
    kind of code signal occurs in a version's source."""
    s = files.where("content is not null").select("name", "version", F.explode(detectors.signal_counts(F.col("content"))).alias("signal", "n"))
    return s.groupBy("name", "version", "signal").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"))
