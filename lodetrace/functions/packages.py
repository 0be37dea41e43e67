"""Column expressions over package names, versions' places and licences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_key(ecosystem: Column, name: Column, version: Column) -> Column:
    """`ecosystem:name@version`."""
    return F.concat(ecosystem, F.lit(":"), name, F.lit("@"), version)


def key_parts(key: Column) -> Column:
    """struct(ecosystem, name, version) of a package key; the last `@` ends the name."""
    m = lambda g: F.regexp_extract(key, r"^([^:]*):(.*)@([^@]*)$", g)
    return F.when(key.rlike(r"^[^:]*:.*@[^@]*$"), F.struct(m(1).alias("ecosystem"), m(2).alias("name"), m(3).alias("version")))


def pypi_name(name: Column) -> Column:
    """PEP 503: lower case, runs of - _ . as one -."""
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def normal_name(ecosystem: Column, name: Column) -> Column:
    """A name as its ecosystem compares it."""
    return F.when(F.lower(ecosystem) == "pypi", pypi_name(name)).otherwise(name)


def _percent(c: Column) -> Column:
    """Percent-encoding that leaves the marks bare which encodeURIComponent leaves bare."""
    e = F.url_encode(c)
    for coded, bare in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(coded), F.lit(bare))
    return e


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """The package URL of an npm or PyPI package."""
    scope, bare = F.regexp_extract(name, r"^(@[^/]+)/(.+)$", 1), F.regexp_extract(name, r"^(@[^/]+)/(.+)$", 2)
    npm = F.when(scope != "", F.concat(_percent(scope), F.lit("/"), _percent(bare))).otherwise(_percent(name))
    path = F.when(ecosystem == "pypi", F.concat(F.lit("pypi/"), _percent(pypi_name(name)))).otherwise(F.concat(F.lit("npm/"), npm))
    return F.concat(F.lit("pkg:"), path, F.lit("@"), _percent(version))


def advisory_ecosystem(ecosystem: Column) -> Column:
    """The name advisories use for an ecosystem."""
    return F.when(F.lower(ecosystem) == "pypi", "PyPI").otherwise("npm")


def specifier_package(spec: Column) -> Column:
    """The package an import specifier names; null for relative, absolute and node: ones."""
    skip = spec.startswith(".") | spec.startswith("/") | spec.startswith("node:") | (spec == "")
    name = F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return F.when(skip | (name == ""), None).otherwise(name)


def mask(value: Column) -> Column:
    """A preview of a secret: a short start, then at most 16 stars; four or fewer are all stars."""
    n = F.length(value)
    keep = F.least(F.lit(4), F.floor(n / 3)).cast("int")
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, keep), F.repeat(F.lit("*"), F.least(F.lit(16), n - keep))))


def bump_range(current: Column, target: Column) -> Column:
    """A manifest's range moved to `target`, its operator kept; complex ranges become ^target."""
    return F.when(F.trim(current).rlike(r"\s|\|\|"), F.concat(F.lit("^"), target)).otherwise(F.concat(F.regexp_extract(F.trim(current), r"^([^\d]*)", 1), target))


def yarn_spec_name(spec: Column) -> Column:
    """The package name of a lockfile spec such as `"@a/b@npm:^1"`."""
    return F.regexp_extract(F.regexp_replace(spec, r'^"|"$', ""), r"^(@?[^@]+)@", 1)


def yarn_spec_plain(spec: Column) -> Column:
    """A lockfile spec without quotes and `npm:` protocol."""
    return F.regexp_replace(F.regexp_replace(spec, r'^"|"$', ""), "@npm:", "@")


def pnpm_key(key: Column) -> Column:
    """struct(name, version) of `/name@1.0.0(peer)` or `name@1.0.0`."""
    k = F.regexp_replace(F.regexp_replace(key, r"\(.*$", ""), r"^/", "")
    return F.struct(F.regexp_extract(k, r"^(.+)@([^@]+)$", 1).alias("name"), F.regexp_extract(k, r"^(.+)@([^@]+)$", 2).alias("version"))


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob: ** any path, * within a part, ? one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
            if glob.startswith("/", i + 1):
                i += 1
        elif glob[i] == "*":
            out.append("[^/]*")
        elif glob[i] == "?":
            out.append(".")
        else:
            out.append(re.escape(glob[i]))
        i += 1
    return "^" + "".join(out) + "$"


def changelog_url(repository: Column) -> Column:
    """A repository's page of releases from its clone address."""
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(repository, r"^git\+", ""), r"\.git$", ""), r"^git://", "https://")
    return F.when(u.contains("github.com"), F.concat(u, F.lit("/releases"))).otherwise(u)


def extension(path: Column) -> Column:
    """The last extension of a path with its dot, '' if it has none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a URL is https and its host, in any letter case, is one of `hosts`."""
    return (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin([h.lower() for h in hosts])
