import random
from collections import deque

from hypothesis import given, settings
from hypothesis import strategies as st

from lodetrace.operators.hierarchy import ChainGraph, closure, forest

nodes = st.sampled_from("abcdefghij")
links_of = st.lists(st.tuples(nodes, nodes), max_size=25)


def brute(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    got = {}
    for s in out:
        queue = deque((x, 1) for x in out[s])
        while queue:
            x, d = queue.popleft()
            if (s, x) not in got:
                got[s, x] = d
                queue.extend((y, d + 1) for y in out.get(x, ()))
    return got


def reached(g, v):
    pairs = [(g.members[c][i], d + i - a) for c, a, b, d in g.intervals(v) for i in range(a, b)]
    assert len(pairs) == len({w for w, _ in pairs})
    return pairs


@settings(max_examples=200, deadline=None)
@given(links_of)
def test_chains_reach_what_a_search_reaches(links):
    g = ChainGraph([x for e in links for x in e], links)
    got = {(g.keys[v], g.keys[w]): d for v in range(g.n) for w, d in reached(g, v)}
    assert got == brute(links)
    for v in range(g.n):
        assert g.cyclic[v] == ((g.keys[v], g.keys[v]) in got)
        p = g.path(v)
        assert len(p) == g.depth[v] + 1 and p[0] == g.keys[g.root[v]] and p[-1] == g.keys[v]
        assert all(e in links for e in zip(p, p[1:]))


LINKS = [("g", a, b) for a, b in ["ab", "bc", "cd", "ac", "de", "ec", "xf", "ff", "pq", "qp"]] + [("h", "a", "b"), ("h", "a", "b"), ("g", "a", "zz"), ("g", None, "a"), (None, "a", "b")]
NODES = [("g", n) for n in "abcdexfpqs"] + [("h", "a"), ("h", "b"), ("h", "b"), ("g", None)]


def tables(spark):
    n = spark.createDataFrame([(*r, 1, "x") for r in NODES], "grp string, node string, depth int, root string")
    return n, spark.createDataFrame([(*r, 5) for r in LINKS], "grp string, src string, dst string, distance int")


def want():
    g = {("g", a, b): d for (a, b), d in brute([(a, b) for x, a, b in LINKS if x == "g" and a and b != "zz"]).items()}
    return {**g, ("h", "a", "b"): 1}


def test_closure_local_and_distributed_agree(spark):
    for bound in (20_000, 0):
        rows = closure(*tables(spark), local_links=bound).collect()
        assert len(rows) == len(want())
        assert {(r.grp, r.ancestor, r.descendant): r.distance for r in rows} == want()


def test_forest_local_and_distributed_agree(spark):
    got = []
    for bound in (20_000, 0):
        rows = forest(*tables(spark), local_links=bound).collect()
        got.append({(r.grp, r.node): (r.depth, r.root, r.on_cycle, r.subtree, len(r.path), r.parent, r.chain, r.place) for r in rows})
        for r in rows:
            assert r.path[0] == r.root and r.path[-1] == r.node
    small = got[0]
    assert got[1] == small
    assert small["g", "s"][:5] == (0, "s", False, 1, 1) and small["g", "d"][2] and not small["g", "a"][2] and small["g", "q"][:5] == (1, "p", True, 1, 2)


def test_empty_tables(spark):
    n, e = tables(spark)
    assert closure(n.limit(0), e.limit(0)).count() == 0 and forest(n.limit(0), e.limit(0)).count() == 0
    assert closure(n, e.limit(0)).count() == 0 and forest(n, e.limit(0)).count() == 12


def test_long_chain():
    keys = [f"n{i:05d}" for i in range(5000)]
    g = ChainGraph(keys, list(zip(keys, keys[1:])))
    assert g.depth[4999] == 4999 and len(g.members) == 1 and list(g.intervals(0)) == [(0, 1, 5000, 1)]


def test_random_graphs_local_and_distributed(spark):
    r = random.Random(3)
    rows, nodes_of = [], []
    for g in range(6):
        keys = [f"k{i:02d}" for i in range(14)]
        nodes_of += [(str(g), k) for k in keys]
        rows += [(str(g), r.choice(keys), r.choice(keys)) for _ in range(r.randint(8, 30))]
    n, e = spark.createDataFrame(nodes_of, "grp string, node string"), spark.createDataFrame(rows, "grp string, src string, dst string")
    want = {(g, a, b): d for g in {x[0] for x in rows} for (a, b), d in brute([x[1:] for x in rows if x[0] == g]).items()}
    far = closure(n, e, local_links=0).collect()
    assert len(far) == len(want) and {(x.grp, x.ancestor, x.descendant): x.distance for x in far} == want
    near, far = [{(x.grp, x.node): tuple(x) for x in forest(n, e, local_links=b).collect()} for b in (20_000, 0)]
    assert near == far and len(near) == len(nodes_of)


def test_results_of_a_group_pass_on_in_batches(spark):
    keys = [f"n{i:04d}" for i in range(400)]
    n = spark.createDataFrame([("g", k) for k in keys], "grp string, node string")
    e = spark.createDataFrame([("g", a, b) for a, b in zip(keys, keys[1:])], "grp string, src string, dst string")
    assert closure(n, e).count() == 400 * 399 // 2
