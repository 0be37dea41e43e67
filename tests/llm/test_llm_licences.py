import json

from lodetrace.llm.fuzzy import map_values
from lodetrace.llm.licences import map_licences


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [prev := i] + [prev := min(row[j] + 1, prev + 1, row[j - 1] + (x != y)) for j, y in enumerate(b, 1)]
    return row[-1]


def k(n):
    return 0 if n < 5 else 1 if n < 6 else 2


def test_pigeonhole_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    ref = [("mit", "M"), ("apache2", "A"), ("apachelicense2", "A"), ("gpl2only", "G2"), ("gpl3only", "G3"), ("boost1", "B"), ("zlibl", "Z"), ("isclicense", "I"), ("mitlicense", "M")]
    typed = set()
    for s, _ in ref:
        for _ in range(40):
            t = list(s)
            for _ in range(r.randint(0, 3)):
                at, how = r.randrange(len(t) + 1), r.random()
                t[at : at + (how < 0.66)] = [] if how < 0.33 else [r.choice("abcegilmnopst23")]
            typed.add("".join(t))
    typed = sorted(typed - {""})
    got = map_values(spark, spark.createDataFrame([(t, "e") for t in [*typed, "", None]], "value string, entry string"), spark.createDataFrame([(*x, 0) for x in ref], "spelling string, entry string, k int")).collect()
    digits = lambda s: "".join(c for c in s if c.isdigit())
    want = {}
    for t in typed:
        hits = [(lev(t, s), e) for s, e in ref if digits(s) == digits(t) and lev(t, s) <= k(len(s))]
        want[t] = min(hits)[1] if hits else "unmatched"
    assert {x.value: x.entry for x in got} == want and len(got) == len(typed)
    assert len({*want.values()}) == 8


REF = [("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("GPL-2.0-only", "GNU General Public License v2.0 only"), ("GPL-3.0-only", "GNU General Public License v3.0 only"), ("LicenseRef-Acme-2.0", "Acme Shared Terms License 2.0")]


def mapped(spark, payloads):
    docs = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], "record_id bigint, payload string, value string, license_id string")
    ref = spark.createDataFrame(REF, "license_id string, full_name string")
    return sorted((r.record_id, r.version, r.license_id) for r in map_licences(spark, docs, ref).collect())


def test_documents_of_all_shapes(spark):
    v = lambda l: {"version": "1", "license": l}
    docs = [
        json.dumps({"versions": {"1": v("Apache 2"), "2": v({"type": "mit licence"}), "3": v(None), "4": v(" "), "5": v({"url": "x"}), "6": None, "7": {"version": "7"}}}),
        json.dumps({"versions": [None, {"version": "9", "license": "GPLv3."}]}),
        json.dumps({"info": {"version": "3", "license": "Licensed under GNU GPL vursion 2"}}),
        json.dumps({"info": {"version": "4", "license": "proprietary"}}), json.dumps({"info": {"version": "5", "license": "?"}}), json.dumps({"info": {"version": "6", "license": "Acme STL 2"}}),
        None, "", "{", json.dumps({"info": None, "versions": None}), json.dumps({"info": {"version": "8", "license": "x" * 50_000}}),
    ]
    assert mapped(spark, docs) == [
        (0, "1", "Apache-2.0"), (0, "2", "MIT"), (1, "9", "GPL-3.0-only"), (2, "3", "GPL-2.0-only"), (3, "4", "unmatched"), (4, "5", "unmatched"), (5, "6", "LicenseRef-Acme-2.0"), (10, "8", "unmatched"),
    ]


def test_empty(spark):
    assert mapped(spark, []) == []


def test_licences_of_other_types_and_repeated_keys(spark):
    rows = [
        (1, '{"versions": {"1": {"license": ["MIT"]}, "2": {"license": ["MIT", "ISC"]}, "3": {"license": true}, "4": {"license": 7}, "5": {"license": []}, "6": {"license": null}}}'),
        (2, '{"name": "a", "name": "b", "versions": {"1": {"license": "MIT", "x": {"k": 1, "k": 2}}, "2": {"license": "ISC", "license": "MIT"}}}'),
    ]
    docs = spark.createDataFrame(rows, "record_id bigint, payload string")
    ref = spark.createDataFrame([("MIT", "MIT License"), ("ISC", "ISC License")], "license_id string, full_name string")
    got = sorted((r.record_id, r.version, r.license_id) for r in map_licences(spark, docs, ref).collect())
    assert got == [(1, "1", "MIT"), *((1, v, "unmatched") for v in "2345"), (2, "1", "MIT"), (2, "2", "MIT")]
