import random

from pyspark.sql import functions as F

from lodetrace.llm.truncation import THRESHOLD, artificial_cuts, ending, strip_marks, truncation_scores, whole_pieces

NOUNS = "parser registry worker archive mirror policy resolver token schema branch manifest header".split()
VERBS = "reloads rewrites shadows trusts drops caches hides logs".split()
ENDS = "without a network;under heavy load;on older runners;in offline mode;after an upgrade;behind a proxy".split(";")


def sentence(r):
    return f"The {r.choice(NOUNS)} {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} {r.choice(ENDS)}"


def whole(r):
    body = "\n\n".join(" ".join(sentence(r) + "." for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3)))
    tail = r.choice(["", "", "\n\n- " + sentence(r) + "\n- " + sentence(r), "\n\n## Licence\n\nMIT", "\n\nThanks!", "\n\nSolved", "\n\nTo be continued…", "\n\n```\nERR exit code 1\n```", "\n\nChange-Ref: " + "".join(r.choice("0123456789abcdef") for _ in range(12)), "\n\n:)"])
    return body + tail


def test_held_out_cuts_are_found(spark):
    r = random.Random(5)
    rows, truth = [], {}
    for i in range(900):
        t = whole(r)
        if i % 10 == 0 and (c := artificial_cuts(t, i + 10_000, 3)[1:2]):
            t, truth[i] = c[0], True
        rows.append((i, t, "a" if i % 2 else "b", 0.1))
    df = spark.createDataFrame([*rows, (9001, None, "a", 0.0), (9002, "", "a", 0.0), (9003, " \n", None, 0.0)], "doc_id bigint, text string, source string, score double")
    got = {x.doc_id: x.score >= THRESHOLD for x in truncation_scores(df, keep=("source",)).collect()}
    assert set(got) == set(range(900))
    tp = sum(got[i] for i in truth)
    fp = sum(v for i, v in got.items() if i not in truth)
    assert tp >= 0.85 * len(truth) and fp <= 12, (tp, len(truth), fp)


def test_marks_and_pieces():
    assert strip_marks("abc def […") == ("abc def", "[…") or strip_marks("abc def […")[0] == "abc def"
    assert strip_marks("abc...")[0] == "abc" and strip_marks("abc�")[0] == "abc" and strip_marks("abc.\r\n")[0] == "abc."
    assert [ending(t).piece for t in ("see fooBarBaz", "a_bc de…", "end.", "")] == ["baz", "de", "", ""]


def test_features_of_anything():
    assert strip_marks("a" + "..." * 300_000)[0] == "a" and strip_marks(" " * 200_000) == ("", " " * 5000)
    for t in ("x", "….", "\n\n", "- ", "```", "# h", "a: b", "é" * 100_000, "\ud800", "http://a/b"):
        assert ending(t).names


def test_tiny_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ok"), (1, "ok"), (2, "x")], "doc_id bigint, text string")
    assert truncation_scores(df).count() == 3 and truncation_scores(df.limit(0)).count() == 0


def test_pieces_counted_before_the_end(spark):
    df = spark.createDataFrame([("Read fooBar from resolv…",), ("one Two.",), ("",), ("end",)], "text string")
    got = [sorted(r[0]) for r in df.select(whole_pieces(F.col("text"))).collect()]
    assert got == [["bar", "foo", "from", "read"], ["one", "two"], [], []]
