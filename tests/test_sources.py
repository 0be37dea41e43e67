import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lodetrace.plans import reports
from lodetrace.sources import archives, feeds, history, lockfiles, settings
from lodetrace.streaming import flows

LOCK3 = {
    "lockfileVersion": 3,
    "packages": {
        "": {"name": "root"},
        "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "^1", "missing": "1"}},
        "node_modules/b": {"version": "2.0.0", "dev": True},
        "node_modules/a/node_modules/b": {"version": "1.5.0", "optionalDependencies": {"@s/c": "1"}},
        "node_modules/@s/c": {"version": "3.0.0", "optional": True},
        "packages/w": {"version": "0.0.1"},
        "node_modules/w": {"link": True, "version": "0.0.1"},
        "node_modules/nov": {},
    },
}
LOCK1 = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "requires": {"b": "1"}, "dependencies": {"b": {"version": "9.0.0"}}}, "b": {"version": "1.0.0", "dev": True}}}
PNPM = "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a:\n        specifier: ^1\n        version: 1.0.0(react@18.0.0)\npackages:\n  a@1.0.0: {}\n  '@s/b@2.0.0': {}\nsnapshots:\n  a@1.0.0(react@18.0.0):\n    dependencies:\n      '@s/b': 2.0.0\n  '@s/b@2.0.0': {}\n"
YARN1 = '# yarn lockfile v1\n\na@^1.0.0, a@~1.0.0:\n  version "1.0.1"\n  dependencies:\n    "@s/b" "^2.0.0"\n\n"@s/b@^2.0.0":\n  version "2.1.0"\n'
YARN2 = '__metadata:\n  version: 6\n"a@npm:^1.0.0":\n  version: 1.0.1\n  dependencies:\n    b: ^2.0.0\n"b@npm:^2.0.0":\n  version: 2.0.0\n'
POETRY = '[[package]]\nname = "My_App"\nversion = "1.0"\n[package.dependencies]\nreq = ">=1"\n[[package]]\nname = "req"\nversion = "2.0"\ncategory = "dev"\n'
REQS = "flask==1.0\n# c\n-r x\nDjango [x] === 2.0 ; python_version > '3'\nunpinned>=1\nflask==1.0\n"
PKG = json.dumps({"dependencies": {"a": "^1.0.0"}, "devDependencies": {"a": "1", "b": "^2.0.0"}})


def files(spark):
    rows = [
        ("p3", "x/package-lock.json", json.dumps(LOCK3)), ("p3", "x/package.json", PKG), ("p3", "x/yarn.lock", YARN1), ("p1", "package-lock.json", json.dumps(LOCK1)), ("p1", "package.json", PKG), ("pn", "pnpm-lock.yaml", PNPM),
        ("y1", "yarn.lock", YARN1), ("y1", "package.json", PKG), ("y2", "yarn.lock", YARN2), ("po", "poetry.lock", POETRY), ("re", "requirements.txt", REQS), ("bad", "package-lock.json", "{"), ("bad2", "poetry.lock", "= ="), ("none", "yarn.lock", None),
    ]
    return spark.createDataFrame(rows, "project_id string, path string, content string")


def test_inventory_of_all_formats(spark):
    got = {}
    for r in lockfiles.inventory(files(spark)).collect():
        got[r.project_id, r.name, r.version] = (r.direct, r.scopes, r.dependencies)
    assert got["p3", "a", "1.0.0"] == (True, ["production"], ["npm:b@1.5.0"])
    assert got["p3", "b", "2.0.0"] == (True, ["development"], []) and got["p3", "b", "1.5.0"] == (False, ["production"], ["npm:@s/c@3.0.0"])
    assert got["p3", "@s/c", "3.0.0"] == (False, ["optional"], []) and sum(k[0] == "p3" for k in got) == 4
    # version 1 is walked in pre-order: the b below a is met before the b beside it
    assert got["p1", "a", "1.0.0"] == (True, ["production"], ["npm:b@9.0.0"]) and ("p1", "b", "1.0.0") not in got
    assert got["pn", "a", "1.0.0"] == (True, ["production"], ["npm:@s/b@2.0.0"]) and got["pn", "@s/b", "2.0.0"][0] is False
    # yarn: a stands in two sections of the manifest and has both scopes
    assert got["y1", "a", "1.0.1"] == (True, ["development", "production"], ["npm:@s/b@2.1.0"]) and got["y2", "a", "1.0.1"][2] == ["npm:b@2.0.0"]
    assert got["po", "my-app", "1.0"] == (True, ["production"], ["pypi:req@2.0"]) and got["po", "req", "2.0"] == (False, ["development"], [])
    assert {k[1:] for k in got if k[0] == "re"} == {("flask", "1.0"), ("django", "2.0")}
    assert not any(k[0] in ("bad", "bad2", "none") for k in got)


def test_pyproject():
    t = '[tool.poetry.dependencies]\npython="3"\nA_b="1"\n[tool.poetry.group.dev.dependencies]\nc="1"\n[project]\ndependencies=["d>=1","c"]\n'
    assert lockfiles.parse_pyproject(t) == {"a-b": "production", "c": "production", "d": "production"}


LOG = """commit abcdef1234
diff --git a/x.py b/x.py
+++ b/x.py
@@ -0,0 +3,2 @@
+one
+two
@@ -9 +12 @@
-gone
+three
diff --git a/y b/y
+++ /dev/null
@@ -1 +0,0 @@
+ghost
commit 1234567abc
+++ b/z
@@ -1,2 +1,3 @@
 same
+new""".split("\n")


def test_patch_log(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(LOG)], "repo string, seq int, line string")
    got = [(r.commit, r.file, r.line_no, r.text) for r in history.patch_lines(df).orderBy("seq").collect()]
    assert got == [("abcdef1234", "x.py", 3, "one"), ("abcdef1234", "x.py", 4, "two"), ("abcdef1234", "x.py", 12, "three"), ("1234567abc", "z", 2, "new")]
    assert history.patch_lines(df.limit(0)).count() == 0


def test_streamed_patch_log_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LOG))
    flows.patch_lines_to(flows.patch_logs(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    ev = spark.createDataFrame([("2026-01-01 00:10:00", "k"), ("2026-01-01 00:50:00", "k"), ("2026-01-01 02:00:00", "m")], "ts string, key string")
    ev.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "ev"))
    stream = lambda: spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "ev"))
    for name, df in (("hours", flows.hourly_counts(stream())), ("firsts", flows.first_seen(stream(), ["key"], "ts")), ("lasts", flows.latest_values(stream(), "key", "ts", "3 hours"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name != "firsts" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.events for r in spark.table("hours").collect()) == [1, 2]
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["k", "m"]
    assert {r.key: r.updates for r in spark.table("lasts").collect()} == {"k": 2, "m": 1}


def test_files_and_ignore(spark, tmp_path):
    for p, b in {"a.py": b"x", "node_modules/b.py": b"x", "d/c.py": b"y\x00", "d/e.py": b"z", "d/f.txt": b"t", "skip/g.py": b"g"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    assert history.ignore_globs("# c\n\n skip/** \n") == ["skip/**"]
    got = history.read_files(spark, str(tmp_path), [".py"], ["skip/**"])
    assert sorted((r.path, r.error) for r in got.collect()) == [("a.py", None), ("d/c.py", "holds NUL bytes"), ("d/e.py", None)]
    (tmp_path / "long.py").write_text("é" * 30)
    (tmp_path / "longer.py").write_text("x" * 50)
    got = {r.path: (r.content, r.error) for r in history.read_files(spark, str(tmp_path), [".py"], ["skip/**"], most_chars=12).collect()}
    assert got["long.py"] == got["longer.py"] == (None, "too long") and got["a.py"] == ("x", None)


def tgz(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in entries:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    good, evil = tgz([("package/a.js", b"1"), ("package/d/b.js", b"22")]), tgz([("package/a", b"1"), ("../../etc/x", b"2")])
    df = spark.createDataFrame([("g", good), ("e", evil), ("j", b"junk"), ("n", None)], "ref string, content binary")
    got = sorted((r.ref, r.path, bytes(r.content) if r.content is not None else None, r.error) for r in archives.package_files(df).collect())
    assert ("g", "a.js", b"1", None) in got and ("g", "d/b.js", b"22", None) in got
    assert ("e", "../../etc/x", None, "path leaves the archive") in got and [r for r in got if r[0] == "j"][0][3].startswith("unreadable")


def test_feeds(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"id": "CVE-1", "aliases": ["X"], "affected": [{"package": {"ecosystem": "npm", "name": "a"}}]}))
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1"}, {"cveID": "CVE-1"}, {}]}))
    (tmp_path / "ABCDE.txt").write_text("0A1:3\n0B2: 0\njunk\n")
    assert feeds.read_osv(spark, str(tmp_path / "o.json")).count() == 1
    assert [r.cve_id for r in feeds.read_exploited(spark, str(tmp_path / "k.json")).collect()] == ["CVE-1"]
    assert sorted(map(tuple, feeds.read_breach_ranges(spark, str(tmp_path / "ABCDE.txt")).collect())) == [("ABCDE", "0A1", 3), ("ABCDE", "0B2", 0)]
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, None)], "k string, fetched_at int, expires_at int")
    new = spark.createDataFrame([("a", 2, 9), ("a", 3, 8)], "k string, fetched_at int, expires_at int")
    assert sorted((r.k, r.fetched_at) for r in feeds.upserted(old, new, ["k"]).collect()) == [("a", 3), ("b", 1)]
    assert sorted(r.k for r in feeds.unexpired(old, F.lit(6)).collect()) == ["b"]


def test_policy():
    assert settings.read_policy(None).values == settings.read_policy("").values == {}
    assert settings.read_policy("max_cvss_severity: 7.5\nother: 1").values == {"max_cvss_severity": 7.5}
    for bad in ("a: [", "- x", "block_on_kev: 3", "min_maintainers: true"):
        with pytest.raises(settings.PolicyError):
            settings.read_policy(bad)


def test_documents(spark, tmp_path):
    n = spark.createDataFrame(
        [("p", "npm:a@1", "npm", "a", "1", True, ["production"], ["npm:b@2", "npm:no@1"]), ("p", "npm:b@2", "npm", "b", "2", None, None, None), ("p", "npm:b@2", "npm", "b", "2", False, ["optional"], [])],
        "project_id string, package_key string, ecosystem string, name string, version string, direct boolean, scopes array<string>, dependencies array<string>",
    )
    cdx = json.loads(reports.cyclonedx(n).first().document)
    assert [(c["purl"], c["scope"]) for c in cdx["components"]] == [("pkg:npm/a@1", "required"), ("pkg:npm/b@2", "optional")]
    assert cdx["dependencies"] == [{"ref": "p", "dependsOn": ["pkg:npm/a@1"]}, {"ref": "pkg:npm/a@1", "dependsOn": ["pkg:npm/b@2"]}]
    sp = json.loads(reports.spdx(n).first().document)
    assert [p["SPDXID"] for p in sp["packages"]] == ["SPDXRef-Package-0", "SPDXRef-Package-1"] and len(sp["relationships"]) == 3
    f = spark.createDataFrame([("p", "r", "f2", "error", "t2", "m", [("u", 3)]), ("p", "r", "f1", "note", "t1", "m", [("v", None)])], "project_id string, rule_id string, fingerprint string, level string, title string, message string, locations array<struct<uri string, start_line int>>")
    run = json.loads(reports.sarif(f).first().document)["runs"][0]
    assert run["tool"]["driver"]["rules"] == [{"id": "r", "shortDescription": {"text": "t1"}, "properties": {"security-severity": "1.0"}}]
    assert "region" not in run["results"][0]["locations"][0]["physicalLocation"] and run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3}
    reports.write_documents(reports.cyclonedx(n), str(tmp_path / "sbom"))
    h = spark.createDataFrame([(i, i * 10) for i in range(5)], "recorded_at int, score int")
    reports.append_history(h, str(tmp_path / "h"))
    assert [r.score for r in reports.recent(spark.read.parquet(str(tmp_path / "h")), 2).collect()] == [30, 40]


def test_files_that_cannot_be_read(spark):
    tree = {"dependencies": {"a": {"version": "1.0.0", "dependencies": {"c": {"version": "3.0.0"}}}, "b": {"version": "1.0.0", "dependencies": {"c": {"version": "4.0.0"}}}, "c": {"version": "5.0.0"}}}
    both = json.dumps({"dependencies": {"a": "^1.0.0"}, "peerDependencies": {"a": "^1.0.0"}})
    rows = [
        ("next", "package-lock.json", "{"), ("next", "yarn.lock", YARN1), ("pre", "package-lock.json", json.dumps(tree)), ("bad", "poetry.lock", "= ="), ("bad", "requirements.txt", REQS),
        ("two", "yarn.lock", YARN1), ("two", "package.json", both), ("odd", "pnpm-lock.yaml", "a: [1"),
    ]
    df = spark.createDataFrame(rows, "project_id string, path string, content string")
    got = {(r.project_id, r.name, r.version): r.scopes for r in lockfiles.inventory(df).collect()}
    assert ("next", "a", "1.0.1") in got and got["two", "a", "1.0.1"] == ["peer", "production"]
    assert [k[2] for k in got if k[:2] == ("pre", "c")] == ["3.0.0"]
    errors = {(r.project_id, r.file) for r in lockfiles.lock_errors(df).collect()}
    assert errors == {("bad", "poetry.lock"), ("odd", "pnpm-lock.yaml")}
    assert lockfiles.lock_names("pypi") == lockfiles.PYPI_FILES and lockfiles.lock_names("x") == lockfiles.NPM_FILES


def test_roots_and_installed_licences(spark):
    rows = [
        ("p", "w/p/package.json", '{"name": "n"}'), ("p", "w/p/package-lock.json", '{"name": "k", "version": "2.0.0"}'), ("q", "w/q/yarn.lock", ""), ("l", "w/l/package-lock.json", '{"name": "k"}'), ("f", "w/f/package.json", "{"),
        ("p", "w/p/node_modules/a/package.json", '{"license": "MIT"}'), ("p", "w/p/node_modules/@s/b/package.json", '{"license": {"type": "ISC"}}'), ("p", "w/p/node_modules/c/package.json", '{"licenses": [{"type": "0BSD"}]}'), ("p", "w/p/node_modules/d/package.json", "{}"),
        ("p", "w/p/node_modules/.bin/package.json", "{}"), ("p", "w/p/node_modules/e/package.json", "{"), ("p", "w/p/node_modules/a/node_modules/z/package.json", "{}"),
    ]
    df = spark.createDataFrame(rows, "project_id string, path string, content string")
    top = df.where(~F.col("path").contains("node_modules"))
    got = {r.project_id: (r.name, r.version) for r in lockfiles.project_roots(top).collect()}
    assert got == {"p": ("n", "2.0.0"), "q": ("q", None), "l": ("k", None), "f": ("f", None)}
    assert {r.name: r.license for r in lockfiles.installed_licences(df).collect()} == {"a": "MIT", "@s/b": "ISC", "c": "0BSD", "d": None}


def test_saved_manifests(spark, tmp_path):
    (tmp_path / "in/p").mkdir(parents=True)
    (tmp_path / "in/p/package.json").write_text(PKG)
    for _ in range(2):
        flows.manifests_to(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.project_id, r.name, r.scope) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("p", "a", "production"), ("p", "b", "development")}


def test_reports_of_all_forms(spark):
    n = spark.createDataFrame([("p", "npm:a@1", "npm", "a", "1", True, ["production"], ["npm:b@1", "npm:x@9"]), ("p", "npm:b@1", "npm", "b", "1", False, [], None)], "project_id string, package_key string, ecosystem string, name string, version string, direct boolean, scopes array<string>, dependencies array<string>")
    for form, mark in (("spdx", "SPDX-2.3"), ("cyclonedx", "CycloneDX")):
        assert mark in reports.bill_of_materials(n, form).first().document
    with pytest.raises(ValueError):
        reports.bill_of_materials(n, "other")
    s = spark.createDataFrame([("p", 93, "A"), ("q", 12, "F")], "project_id string, score int, grade string")
    assert [json.loads(r.document)["color"] for r in reports.badge(s).orderBy("project_id").collect()] == ["brightgreen", "red"]
    f = spark.createDataFrame([("p", "secret", "error"), ("p", "secret", "error")], "project_id string, category string, level string")
    doc = {r.project_id: json.loads(r.document) for r in reports.audit_json(s.select("project_id", "score"), f).collect()}
    assert doc["p"] == {"project": "p", "summary": {"score": 93}, "findings": [{"category": "secret", "level": "error", "findings": 2}]} and doc["q"]["findings"] == []


def test_keyed_state_expires(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "in"))
    seen = []
    for n, rows in enumerate([[("2026-01-01 00:00:00", "a"), ("2026-01-01 00:05:00", "a"), ("2026-01-01 00:10:00", "b")], [("2026-01-01 03:00:00", "b")], [("2026-01-01 03:10:00", "a")], [("2026-01-01 03:20:00", "c")]]):
        spark.createDataFrame(rows, "ts string, key string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = flows.expiring_values(stream, "key", "ts", 3600).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: seen.extend((r.key, r.updates, r.expired) for r in df.collect()))
        q.trigger(availableNow=True).start().awaitTermination(120)
    assert ("a", 2, False) in seen and ("a", 2, True) in seen and ("a", 1, False) in seen and ("b", 2, False) in seen
