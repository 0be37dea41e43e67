import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from lodetrace.llm.mixing import count_tokens, fit_budget, mix_shares, mix_sources


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 4), max_size=4), st.integers(-1, 70))
def test_knapsack_is_the_best_subset_sum(lengths, budget):
    take = fit_budget(lengths, budget)
    assert all(0 < c <= lengths[n] for n, c in take.items())
    sums = (sum(n * c for n, c in zip(lengths, cs)) for cs in itertools.product(*[range(c + 1) for c in lengths.values()]))
    assert sum(n * c for n, c in take.items()) == max((s for s in sums if s <= budget), default=0)


def docs(spark):
    rows = [(i, "big", 10 + i % 7, "x") for i in range(400)] + [(1000 + i, "small", 5, "x") for i in range(10)] + [(2000, "none", 50, "x"), (2001, None, 3, "x"), (None, "big", 3, "x"), (2002, "big", 0, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, repeats string")


TARGETS = [("big", 0.7, 1), ("small", 0.05, 3), ("absent", 0.25, 9), ("small", 0.05, 3), (None, 0.1, 1)]


def mixed(spark, knapsack):
    d = docs(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return d, t, mix_sources(d, t, knapsack_tokens=knapsack)


def test_shares_and_caps(spark):
    total = sum(10 + i % 7 for i in range(400)) + 50 + 50 + 3 + 3
    for knapsack in (200_000, 60):
        d, t, m = mixed(spark, knapsack)
        rows = m.collect()
        used = {}
        for r in rows:
            used[r.source] = used.get(r.source, 0) + r.n_tokens * r.repeats
        assert used["big"] == round(0.7 * total) and used["small"] == 150
        assert {r.repeats for r in rows if r.source == "big"} == {1} and {r.repeats for r in rows if r.source == "small"} == {3}
        assert {r.source for r in rows} == {"big", "small"} and len({(r.doc_id) for r in rows}) == len(rows)
        shares = {r.source: r for r in mix_shares(d, t.where("source is not null").dropDuplicates(), m).collect()}
        assert shares["absent"].reached_share == 0 and abs(shares["big"].reached_share - 0.7) < 1e-3


def test_same_seed_same_choice(spark):
    a, b = (sorted(map(tuple, mixed(spark, 60)[2].collect())) for _ in range(2))
    assert a == b


def test_empty(spark):
    d, t, _ = mixed(spark, 60)
    assert mix_sources(d.limit(0), t).count() == 0 and mix_sources(d, t.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a" * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000


def test_long_documents_do_not_end_the_filling(spark):
    rows = [(i, "a", 5_000 if i < 8 else 7 + i % 5) for i in range(1_500)] + [(i, "b", 30) for i in range(2_000, 5_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    total = sum(r[2] for r in rows)
    for want in (4_000, 50):
        targets = spark.createDataFrame([("a", want / total, 1)], "source string, target_share double, max_repeats int")
        for seed in (1, 2):
            got = mix_sources(docs, targets, seed, knapsack_tokens=100).collect()
            assert all(r.repeats == 1 for r in got) and sum(r.n_tokens for r in got) == want, (want, seed)


def test_every_unused_length_counts_and_ids_once(spark):
    # one short document far back in the order, many long ones, an id that comes three times
    rows = [(i, "a", 400) for i in range(50)] + [(100 + i, "a", 10) for i in range(40)] + [(500, "a", 5)] + [(7, "a", 400)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    total = 50 * 400 + 40 * 10 + 5
    targets = spark.createDataFrame([("a", 305 / total, 1)], "source string, target_share double, max_repeats int")
    for seed in range(4):
        got = mix_sources(docs, targets, seed, knapsack_tokens=100).collect()
        assert sum(r.n_tokens * r.repeats for r in got) == 305 and len({r.doc_id for r in got}) == len(got)
    once = spark.createDataFrame([(1, "a", 10)] * 3 + [(2, "b", 10)], "doc_id bigint, source string, n_tokens bigint")
    got = mix_sources(once, spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")).collect()
    assert [(r.doc_id, r.n_tokens, r.repeats) for r in got] == [(1, 10, 1)]


def test_long_budget_needs_little_memory():
    lengths = {n: 3 for n in range(300, 4_000, 7)}
    take = fit_budget(lengths, 900_001)
    assert sum(n * c for n, c in take.items()) == 900_001 and all(c <= lengths[n] for n, c in take.items())
