import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lodetrace.operators.shred import StructuralIndex, shred

values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=4), st.booleans())
def test_every_json_value_is_valid(docs, spaced):
    texts = [json.dumps(d, indent=2 if spaced else None, ensure_ascii=False).encode("utf-8", "surrogatepass") for d in docs]
    assert StructuralIndex(texts).valid.all()


@settings(max_examples=300, deadline=None)
@given(values, st.integers(0, 60), st.integers(0, 4), st.sampled_from(["", ",", "}", "]", '"', "\\", "1", "tru", ":"]))
def test_validity_is_that_of_a_parser(doc, at, n, put):
    text = json.dumps(doc, ensure_ascii=True)
    text = text[:at] + put + text[at + n :]
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    assert StructuralIndex([b"[1]", text.encode(), b'{"a":2}']).valid.tolist() == [True, good, True]


def rows(spark, texts, paths, named=None):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "id bigint, t string, child string, path string")
    got = shred(df, "id", "t", paths, named).collect()
    return sorted([(r.id, r.child, "/".join(r.path), r.place, r.kind, r.value) for r in got], key=str)


def test_paths_places_and_names(spark):
    texts = ['{"v":[null,{"n":"1\\u0041","d":{}},{"d":null}],"w":{"a/b":"s","c":[1,[2]]}}', None, "", "{", '{"v":{"k":{"d":1}}}']
    got = rows(spark, texts, {"v": ("v", "*"), "d": ("v", "*", "d"), "c": ("w", "c", "*")}, {"v": "n"})
    assert got == sorted(
        [
            (0, "v", "v/0", 0, "null", "null"), (0, "v", "v/1A", 1, "object", None), (0, "v", "v/2", 2, "object", None), (0, "d", "v/1A/d", 1, "object", None), (0, "d", "v/2/d", 0, "null", "null"),
            (0, "c", "w/c/0", 0, "literal", "1"), (0, "c", "w/c/1", 1, "array", None), (4, "v", "v/k", 0, "object", None), (4, "d", "v/k/d", 0, "literal", "1"),
        ],
        key=str,
    )


def test_rows_link_to_their_parents(spark):
    df = spark.createDataFrame([(7, '{"a":[{"b":[1,2]},{"b":[3]}]}')], "id bigint, t string")
    got = shred(df, "id", "t", {"a": ("a", "*"), "bs": ("a", "*", "b"), "b": ("a", "*", "b", "*")}).collect()
    node = {r.node: r for r in got}
    for r in got:
        if r.child != "a":
            assert node[r.parent].path == r.path[:-1]


def test_empty_table_repeated_and_very_long(spark):
    assert rows(spark, [], {"a": ("a",)}) == []
    long = json.dumps({"a": ["x" * 10] * 30_000})
    df = spark.createDataFrame([(1, long), (1, long), (None, long)], "id bigint, t string")
    assert shred(df, "id", "t", {"a": ("a", "*")}).count() == 60_000


def test_repeated_keys_all_come_out(spark):
    assert [r[-1] for r in rows(spark, ['{"a":1,"a":2}'], {"a": ("a",)})] == ["1", "2"]
