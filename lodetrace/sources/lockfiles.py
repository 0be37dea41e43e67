"""Lockfiles and manifests as tables of packages and links.

Input is one row per file: project_id, path, content. The npm lockfile of versions 2 and 3
is a flat map, so its packages and links are DataFrame expressions with a nearest-ancestor
join. The other formats are recursive or need a parser of their own and are read by a
Python function over Arrow batches, one file at a time. A file that cannot be read counts as
absent: the next in precedence is read; `lock_errors` names those a parser refused.

Every reader returns (project_id, ecosystem, name, version, direct, scopes, dependencies),
`dependencies` being package keys.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import keep_first, resolve_nearest

NODES = "project_id string, ecosystem string, name string, version string, direct boolean, scopes array<string>, dependencies array<string>"
#: Which file of a project is read: the first of these that is there.
NPM_FILES = ["package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock"]
PYPI_FILES = ["poetry.lock", "requirements.txt"]
#: Sections of a manifest, the first that names a package deciding its scope.
SECTIONS = [("dependencies", "production"), ("optionalDependencies", "optional"), ("peerDependencies", "peer"), ("devDependencies", "development")]


def base_name(path):
    return F.regexp_extract(path, r"([^/]+)$", 1)


def chosen_files(files: DataFrame, names: list[str]) -> DataFrame:
    """Per project the readable file whose name comes first in `names`: content that is there,
    and of JSON files an object."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), base_name(F.col("path")))
    json_object = F.coalesce(F.expr("schema_of_variant(try_parse_json(content)) LIKE 'OBJECT%'"), F.lit(False))
    readable = F.col("content").isNotNull() & (~F.col("path").endswith(".json") | json_object)
    return keep_first(files.withColumn("_rank", rank).where(F.col("_rank") > 0).where(readable), ["project_id"], F.col("_rank")).drop("_rank")


def project_roots(files: DataFrame) -> DataFrame:
    """(project_id, name, version, path) of each project: named by its manifest, else by its npm
    lockfile, else by its folder; the version is the manifest's or else the lockfile's."""
    told = lambda name, out: files.where(base_name(F.col("path")) == name).select("project_id", F.regexp_replace("path", r"/?[^/]+$", "").alias("path"), F.from_json("content", "name string, version string").alias(out)).groupby("project_id").agg(F.min("path").alias("path"), F.first(out, True).alias(out))
    m, k = told("package.json", "m"), told("package-lock.json", "k").withColumnRenamed("path", "_path")
    r = files.select("project_id").distinct().join(m, "project_id", "left").join(k, "project_id", "left").withColumn("path", F.coalesce("path", "_path", F.lit("")))
    folder = F.regexp_extract("path", r"([^/]+)/?$", 1)
    return r.select("project_id", F.coalesce("m.name", "k.name", F.when(folder != "", folder).otherwise(F.col("project_id"))).alias("name"), F.coalesce("m.version", "k.version").alias("version"), "path")


def installed_licences(files: DataFrame) -> DataFrame:
    """(project_id, name, license) of packages installed at the top of node_modules: the text of
    `license`, its `type`, or the first of `licenses`; null where none is declared. Folders with
    a leading dot and manifests that cannot be read do not count."""
    at = r"^(?:.*/)?node_modules/((?:@[^/]+/)?[^/.@][^/]*)/package\.json$"
    t = files.where(F.col("path").rlike(at) & ~F.col("path").rlike(r"node_modules/.*node_modules/")).select("project_id", F.regexp_extract("path", at, 1).alias("name"), F.expr("try_parse_json(content)").alias("j"))
    t = t.where(F.expr("schema_of_variant(j) LIKE 'OBJECT%'"))
    text = F.when(F.expr("schema_of_variant(try_variant_get(j, '$.license', 'variant')) = 'STRING'"), F.try_variant_get("j", "$.license", "string"))
    licence = F.coalesce(text, F.try_variant_get("j", "$.license.type", "string"), F.try_variant_get("j", "$.licenses[0].type", "string"))
    return t.select("project_id", "name", F.when(licence != "", licence).alias("license"))


#: What reads each ecosystem; anything unknown is read as npm.
ECOSYSTEMS = {"npm": NPM_FILES, "pypi": PYPI_FILES}


def lock_names(ecosystem: str) -> list[str]:
    """The lockfiles of an ecosystem in their precedence."""
    return ECOSYSTEMS.get(ecosystem, NPM_FILES)


def manifest_scopes(files: DataFrame) -> DataFrame:
    """(project_id, name, scope) of every direct dependency in package.json files."""
    t = files.where(base_name(F.col("path")) == "package.json").select("project_id", F.from_json("content", ", ".join(f"{s} map<string,string>" for s, _ in SECTIONS)).alias("j"))
    named = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(scope).alias("scope"), F.coalesce(F.map_keys(F.col(f"j.{s}")), F.array().cast("array<string>")).alias("names")) for i, (s, scope) in enumerate(SECTIONS)])
    rows = t.select("project_id", F.explode(named).alias("x")).select("project_id", F.explode("x.names").alias("name"), "x.rank", "x.scope")
    return rows.groupBy("project_id", "name").agg(F.min_by("scope", "rank").alias("scope"))


def npm_lock(files: DataFrame) -> DataFrame:
    """Packages of lockfile versions 2 and 3; nodes of version 1 come from `npm_legacy`."""
    entry = "struct<version:string,link:boolean,dev:boolean,optional:boolean,dependencies:map<string,string>,optionalDependencies:map<string,string>>"
    locks = chosen_files(files, NPM_FILES).where(base_name(F.col("path")).isin(NPM_FILES[:2]))
    j = locks.select("project_id", F.from_json("content", f"packages map<string,{entry}>").alias("j")).where("j.packages is not null")
    e = j.select("project_id", F.explode("j.packages").alias("path", "e")).where(F.col("path").contains("node_modules/") & F.col("e.version").isNotNull() & ~F.coalesce("e.link", F.lit(False)))
    name = F.regexp_extract("path", r"^(?:.*node_modules/)?(.*)$", 1)
    nodes = e.select(F.col("project_id").alias("scope"), "path", name.alias("name"), F.col("e.version").alias("version"), F.when(F.col("e.dev"), "development").when(F.col("e.optional"), "optional").otherwise("production").alias("kind"), "e.dependencies", "e.optionalDependencies")
    none = F.array().cast("array<string>")
    wants = nodes.select("scope", F.col("path").alias("base"), F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("dependencies"), none), F.coalesce(F.map_keys("optionalDependencies"), none)))).alias("name"))
    found = resolve_nearest(wants, nodes)
    key = F.concat(F.lit("npm:"), F.col("name"), F.lit("@"), F.col("version"))
    keyed = nodes.select("scope", "path", key.alias("key"))
    links = (
        found.join(keyed.select("scope", F.col("path").alias("base"), F.col("key").alias("parent")), ["scope", "base"])
        .join(keyed, ["scope", "path"]).where("parent <> key").groupBy("scope", "parent").agg(F.array_sort(F.collect_set("key")).alias("dependencies"))
    )
    direct = manifest_scopes(files).select(F.col("project_id").alias("scope"), "name", F.col("scope").alias("declared"))
    # only a top-level instance of a declared name is the direct one
    n = nodes.withColumn("parent", key).withColumn("top", F.col("path") == F.concat(F.lit("node_modules/"), F.col("name"))).join(direct, ["scope", "name"], "left")
    is_direct = F.col("top") & F.col("declared").isNotNull()
    m = n.groupBy("scope", "parent", "name", "version").agg(F.bool_or(is_direct).alias("direct"), F.array_sort(F.collect_set(F.when(is_direct, F.col("declared")).otherwise(F.col("kind")))).alias("scopes"))
    return m.join(links, ["scope", "parent"], "left").select(F.col("scope").alias("project_id"), F.lit("npm").alias("ecosystem"), "name", "version", "direct", "scopes", F.coalesce("dependencies", none).alias("dependencies"))


def requirements(files: DataFrame) -> DataFrame:
    """Pinned lines of requirements.txt: all direct, without links."""
    t = chosen_files(files, PYPI_FILES).where(base_name(F.col("path")) == "requirements.txt")
    pin = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*={2,3}\s*([^\s;#,]+)"
    line = t.select("project_id", F.explode(F.split("content", r"\r?\n")).alias("line")).where(F.col("line").rlike(pin))
    name = F.regexp_replace(F.lower(F.regexp_extract("line", pin, 1)), r"[-_.]+", "-")
    rows = line.select("project_id", F.lit("pypi").alias("ecosystem"), name.alias("name"), F.regexp_extract("line", pin, 2).alias("version")).distinct()
    return rows.select("*", F.lit(True).alias("direct"), F.array(F.lit("production")).alias("scopes"), F.array().cast("array<string>").alias("dependencies"))


Node = tuple[str, str, bool, list[str], list[str]]


def parse_npm_legacy(content: str, manifest: dict[str, str]) -> list[Node]:
    """Version 1: a tree, walked with every package before those below it and after those listed
    before it; of a name the instance met first counts."""
    seen: dict[str, dict] = {}
    walk = [iter((json.loads(content).get("dependencies") or {}).items())]
    while walk:
        name, e = next(walk[-1], (None, None))
        if name is None:
            walk.pop()
        elif isinstance(e, dict) and isinstance(e.get("version"), str):
            seen.setdefault(name, e)
            if isinstance(e.get("dependencies"), dict):
                walk.append(iter(e["dependencies"].items()))
    key = {n: f"npm:{n}@{e['version']}" for n, e in seen.items()}
    out = []
    for n, e in seen.items():
        kind = manifest.get(n) or ("development" if e.get("dev") else "optional" if e.get("optional") else "production")
        out.append((n, e["version"], n in manifest, [kind], sorted({key[d] for d in e.get("requires") or {} if d in key and d != n})))
    return out


def parse_pnpm(content: str, manifest: dict[str, str]) -> list[Node]:
    import yaml

    doc = yaml.safe_load(content) or {}
    split = lambda k: re.match(r"/?(.+)@([^@]+)$", re.sub(r"\(.*$", "", k))
    nodes = {}
    for k in {**(doc.get("packages") or {}), **(doc.get("snapshots") or {})}:
        if m := split(str(k)):
            nodes.setdefault((m[1], m[2]), set())
    for k, e in ((doc.get("snapshots") or doc.get("packages")) or {}).items():
        if not (m := split(str(k))):
            continue
        for section in ("dependencies", "optionalDependencies"):
            for name, v in ((e or {}).get(section) or {}).items():
                v = re.sub(r"\(.*$", "", str(v)).lstrip("/")
                dep = (name, v.rpartition("@")[2]) if "@" in v[1:] else (name, v)
                if dep in nodes and dep != (m[1], m[2]):
                    nodes[(m[1], m[2])].add(f"npm:{dep[0]}@{dep[1]}")
    top = (doc.get("importers") or {}).get(".") or doc
    direct = {}
    for section, scope in reversed(SECTIONS):
        for name, v in (top.get(section) or {}).items():
            v = v.get("version") if isinstance(v, dict) else v
            direct[(name, re.sub(r"\(.*$", "", str(v)))] = scope
    return [(n, v, (n, v) in direct, [direct[(n, v)]] if (n, v) in direct else [], sorted(d)) for (n, v), d in nodes.items()]


def _yarn_blocks(content: str) -> list[tuple[list[str], str, dict[str, str]]]:
    """(specs, version, dependencies) of every block, classic or berry."""
    if "__metadata:" in content:
        import yaml

        doc = yaml.safe_load(content) or {}
        return [([s.strip() for s in str(k).split(",")], str(e["version"]), {str(a): str(b) for a, b in (e.get("dependencies") or {}).items()}) for k, e in doc.items() if k != "__metadata" and isinstance(e, dict) and e.get("version")]
    blocks: list[tuple[list[str], str, dict[str, str]]] = []
    specs, version, deps, inside = [], "", {}, False
    for line in [*content.splitlines(), "end:"]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line.startswith(" "):
            if specs and version:
                blocks.append((specs, version, deps))
            specs, version, deps, inside = [s.strip().strip('"') for s in line.rstrip(":").split(",")], "", {}, False
        elif m := re.match(r'  version "?([^"]+)"?$', line):
            version = m[1]
        elif re.match(r"  (optionalD|d)ependencies:$", line):
            inside = True
        elif inside and (m := re.match(r'    "?([^"\s]+)"? "?([^"]+)"?$', line)):
            deps[m[1]] = m[2]
        elif not line.startswith("    "):
            inside = False
    return blocks


def parse_yarn(content: str, manifest: dict[str, list[str]], ranges: dict[str, str] | None = None) -> list[Node]:
    """`manifest` holds every scope of each direct name: one named in two sections has both."""
    where: dict[str, tuple[str, str]] = {}
    nodes: dict[tuple[str, str], set[str]] = {}
    blocks = _yarn_blocks(content)
    plain = lambda s: s.replace("@npm:", "@")
    for specs, version, _ in blocks:
        for s in specs:
            name = re.match(r"(@?[^@]+)@", s)
            if name:
                node = (name[1], version)
                nodes.setdefault(node, set())
                where[s] = where[plain(s)] = node
    for specs, version, deps in blocks:
        name = re.match(r"(@?[^@]+)@", specs[0])
        for d, r in deps.items():
            hit = where.get(f"{d}@{r}") or where.get(plain(f"{d}@{r}"))
            if hit and name and hit != (name[1], version):
                nodes[(name[1], version)].add(f"npm:{hit[0]}@{hit[1]}")
    direct = {where.get(f"{n}@{r}") or where.get(f"{n}@npm:{r}"): manifest.get(n) for n, r in (ranges or {}).items()}
    return [(n, v, direct.get((n, v)) is not None, sorted(direct.get((n, v)) or []), sorted(d)) for (n, v), d in nodes.items()]


def parse_poetry(content: str, manifest: dict[str, str]) -> list[Node]:
    plain = lambda n: re.sub(r"[-_.]+", "-", n.lower())
    packs = [p for p in tomllib.loads(content).get("package", []) if p.get("name") and p.get("version")]
    key = {plain(p["name"]): f"pypi:{plain(p['name'])}@{p['version']}" for p in packs}
    links = {plain(p["name"]): sorted({key[plain(d)] for d in p.get("dependencies", {}) if plain(d) in key and plain(d) != plain(p["name"])}) for p in packs}
    needed = {d for ds in links.values() for d in ds}
    out = []
    for p in packs:
        n = plain(p["name"])
        groups = p.get("groups") or [p.get("category", "main")]
        kind = "development" if all(g in ("dev", "test") for g in groups) else "production"
        direct = n in manifest if manifest else key[n] not in needed
        out.append((n, p["version"], direct, [manifest.get(n) or kind], links[n]))
    return out


def parse_pyproject(content: str) -> dict[str, str]:
    """Direct dependencies and their scopes; what is written later holds."""
    plain = lambda n: re.sub(r"[-_.]+", "-", n.lower())
    doc = tomllib.loads(content)
    poetry = doc.get("tool", {}).get("poetry", {})
    out = {plain(n): "production" for n in poetry.get("dependencies", {}) if n != "python"}
    for g in poetry.get("group", {}).values():
        out |= {plain(n): "development" for n in g.get("dependencies", {})}
    out |= {plain(n): "development" for n in poetry.get("dev-dependencies", {})}
    for spec in doc.get("project", {}).get("dependencies", []):
        if m := re.match(r"\s*([A-Za-z0-9][\w.-]*)", spec):
            out[plain(m[1])] = "production"
    return out


def _manifest(content: str | None) -> tuple[dict[str, str], dict[str, str], dict[str, list[str]]]:
    """Of each name in a manifest: the scope and range that hold, and all scopes."""
    try:
        doc = json.loads(content or "{}")
    except ValueError:
        return {}, {}, {}
    scopes, ranges, every = {}, {}, {}
    for section, scope in reversed(SECTIONS):
        for n, r in (doc.get(section) or {}).items():
            scopes[n], ranges[n] = scope, r
            every.setdefault(n, []).append(scope)
    return scopes, ranges, every


def _read(name: str, content: str, manifest: str | None) -> list[Node]:
    if name in PYPI_FILES:
        return parse_poetry(content, parse_pyproject(manifest) if manifest else {})
    scopes, ranges, every = _manifest(manifest)
    if name in NPM_FILES[:2]:
        return [] if json.loads(content).get("packages") else parse_npm_legacy(content, scopes)
    return parse_pnpm(content, scopes) if name == "pnpm-lock.yaml" else parse_yarn(content, every, ranges)


def _parsed(files: DataFrame) -> DataFrame:
    """Nodes of npm version 1, pnpm, yarn and poetry lockfiles with `file` and `error`: a file the
    parser refuses gives one row that has an error only."""
    eco = lambda names, manifest, e: chosen_files(files, names).join(
        files.where(base_name(F.col("path")) == manifest).select("project_id", F.col("content").alias("manifest")).dropDuplicates(["project_id"]), "project_id", "left"
    ).select("project_id", F.lit(e).alias("ecosystem"), base_name(F.col("path")).alias("file"), "content", "manifest")
    src = eco(NPM_FILES, "package.json", "npm").unionByName(eco(PYPI_FILES, "pyproject.toml", "pypi").where("file = 'poetry.lock'"))

    def run(batches: Iterator[pd.DataFrame], read: Callable = _read) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    rows += [(r.project_id, r.ecosystem, *n, r.file, None) for n in read(r.file, r.content, r.manifest if isinstance(r.manifest, str) else None)]
                except (ValueError, TypeError, AttributeError, KeyError, yaml.YAMLError) as e:  # malformed, or of another shape
                    rows.append((r.project_id, r.ecosystem, None, None, None, None, None, r.file, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["project_id", "ecosystem", "name", "version", "direct", "scopes", "dependencies", "file", "error"])

    return src.mapInPandas(run, NODES + ", file string, error string")


def other_locks(files: DataFrame) -> DataFrame:
    """Packages of npm version 1, pnpm, yarn and poetry lockfiles, with their manifests."""
    return _parsed(files).where("error is null").drop("file", "error")


def lock_errors(files: DataFrame) -> DataFrame:
    """(project_id, ecosystem, file, error) of lockfiles that could not be parsed."""
    return _parsed(files).where("error is not null").select("project_id", "ecosystem", "file", "error")


def inventory(files: DataFrame) -> DataFrame:
    """All packages of all projects, from whichever files each project has."""
    return npm_lock(files).unionByName(requirements(files)).unionByName(other_locks(files))
