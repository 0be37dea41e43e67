"""Hierarchies from links: paths, depths, roots, descendants and cycles, by heavy paths.

Links of many independent groups (projects) form directed graphs. Per group:

1. Cycle separation: strongly connected components mark what depends on itself; roots are the
   smallest keys of the components nothing points to.
2. A breadth-first forest from the roots gives every node a depth, one parent and a root.
3. Subtree sizes of the forest choose each node's heavy child; heavy links join into chains,
   and a node is known by (chain, place on the chain).
4. A path is the concatenation of chain segments, one per chain on the way to the root.
5. Descendants come out as chain intervals: entering a chain at a place reaches the rest of
   it, one link further at each step. Links of the forest alone would miss descendants of
   nodes with several parents, so all other links are followed too, and an interval ends
   where an entry further down the chain serves its remainder in fewer links. Intervals, not
   pairs, are what is searched and passed on; pairs are made of them last, by SQL.

Groups up to `local_links` links are decomposed in a task, many groups after one another; of
larger groups the same steps run as joins (components by trimming and colouring, chains from
the paths, entries of chains relaxed until none improves), so no task ever holds a large group
and no pair is made twice.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Links of a group that one task may hold; beyond it the distributed form takes over.
LOCAL_LINKS = 20_000
#: Rows of a batch a task passes on.
BATCH_ROWS = 5_000


class ChainGraph:
    """One group's graph, decomposed. Nodes are numbered in the order of their keys."""

    def __init__(self, keys: list[str], links: list[tuple[str, str]]):
        self.keys = sorted(set(keys))
        num = {k: i for i, k in enumerate(self.keys)}
        self.n = n = len(self.keys)
        self.out: list[list[int]] = [[] for _ in range(n)]
        for a, b in sorted({(num[a], num[b]) for a, b in links if a in num and b in num}):
            self.out[a].append(b)
        self._components()
        self._forest()
        self._chains()

    def _components(self) -> None:
        n, out = self.n, self.out
        self.comp = [-1] * n
        self.cyclic = [False] * n
        low, seen, on = [0] * n, [0] * n, [False] * n
        stack: list[int] = []
        clock = comps = 0
        for s in range(n):
            if seen[s]:
                continue
            work = [(s, 0)]
            while work:
                v, i = work.pop()
                if i == 0:
                    clock += 1
                    seen[v] = low[v] = clock
                    stack.append(v)
                    on[v] = True
                descend = False
                for j in range(i, len(out[v])):
                    w = out[v][j]
                    if not seen[w]:
                        work += [(v, j + 1), (w, 0)]
                        descend = True
                        break
                    if on[w]:
                        low[v] = min(low[v], seen[w])
                if descend:
                    continue
                if low[v] == seen[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        self.comp[w] = comps
                        members.append(w)
                        if w == v:
                            break
                    loop = len(members) > 1 or v in out[v]
                    for w in members:
                        self.cyclic[w] = loop
                    comps += 1
                if work:
                    p = work[-1][0]
                    low[p] = min(low[p], low[v])
        self.comps = comps

    def _forest(self) -> None:
        n = self.n
        entered = [False] * self.comps
        for v in range(n):
            for w in self.out[v]:
                if self.comp[v] != self.comp[w]:
                    entered[self.comp[w]] = True
        self.parent, self.depth, self.root = [-1] * n, [-1] * n, [-1] * n
        queue: deque[int] = deque()
        rooted = set()
        for v in range(n):  # in key order: the smallest key of a source component is its root
            if not entered[self.comp[v]] and self.comp[v] not in rooted:
                rooted.add(self.comp[v])
                self.depth[v], self.root[v] = 0, v
                queue.append(v)
        self.order: list[int] = []
        while queue:
            v = queue.popleft()
            self.order.append(v)
            for w in self.out[v]:
                if self.depth[w] < 0:
                    self.depth[w], self.parent[w], self.root[w] = self.depth[v] + 1, v, self.root[v]
                    queue.append(w)

    def _chains(self) -> None:
        n = self.n
        self.size = [1] * n
        for v in reversed(self.order):
            if self.parent[v] >= 0:
                self.size[self.parent[v]] += self.size[v]
        heavy = [-1] * n
        for v in self.order:
            p = self.parent[v]
            if p >= 0 and (heavy[p] < 0 or self.size[v] > self.size[heavy[p]]):
                heavy[p] = v
        self.chain, self.place, self.members = [-1] * n, [0] * n, []
        for v in self.order:
            p = self.parent[v]
            if p >= 0 and heavy[p] == v:
                self.chain[v], self.place[v] = self.chain[p], self.place[p] + 1
                self.members[self.chain[v]].append(v)
            else:
                self.chain[v] = len(self.members)
                self.members.append([v])
        # links other than heavy ones, by chain in the order of their places
        self.side_at: list[list[int]] = [[] for _ in self.members]
        self.side_to: list[list[int]] = [[] for _ in self.members]
        for c, run in enumerate(self.members):
            for i, v in enumerate(run):
                for w in self.out[v]:
                    if w != heavy[v]:
                        self.side_at[c].append(i)
                        self.side_to[c].append(w)

    def path(self, v: int) -> list[str]:
        """Keys from the root to `v`, chain segment by chain segment."""
        parts: list[list[int]] = []
        while v >= 0:
            seg = self.members[self.chain[v]][: self.place[v] + 1]
            parts.append(seg)
            v = self.parent[seg[0]]
        return [self.keys[x] for seg in reversed(parts) for x in seg]

    def intervals(self, start: int) -> Iterator[tuple[int, int, int, int]]:
        """(chain, first place, place after the last, links to the first) of all that `start`
        reaches over one or more links, each place in the interval that serves it best."""
        chain, place = self.chain, self.place
        places: dict[int, list[int]] = {}
        dists: dict[int, list[int]] = {}
        todo: dict[int, list[int]] = {1: self.out[start]}
        step = 1
        while todo:
            entries = todo.pop(step, None)
            if entries is None:
                step += 1
                continue
            for v in entries:
                c, at = chain[v], place[v]
                ps = places.get(c)
                if ps is None:
                    places[c], dists[c] = [at], [step]
                    stop = len(self.members[c])
                else:
                    k = bisect_right(ps, at)
                    if k and dists[c][k - 1] + at - ps[k - 1] <= step:
                        continue  # the rest of the chain is reached as early already
                    stop = ps[k] if k < len(ps) else len(self.members[c])
                    if k and ps[k - 1] == at:
                        dists[c][k - 1] = step
                    else:
                        ps.insert(k, at)
                        dists[c].insert(k, step)
                side = self.side_at[c]
                for j in range(bisect_left(side, at), bisect_left(side, stop)):
                    w = self.side_to[c][j]
                    d = step + side[j] - at + 1
                    qs = places.get(chain[w])
                    if qs:
                        k = bisect_right(qs, place[w])
                        if k and dists[chain[w]][k - 1] + place[w] - qs[k - 1] <= d:
                            continue
                    todo.setdefault(d, []).append(w)
            step += 1
        for c, ps in places.items():
            for i, (at, d) in enumerate(zip(ps, dists[c])):
                yield c, at, ps[i + 1] if i + 1 < len(ps) else len(self.members[c]), d


def clean_links(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (grp, node) and (grp, src, dst) whose both ends are nodes of the group."""
    nodes = nodes.where("grp is not null and node is not null").distinct()
    links = links.where("grp is not null and src is not null and dst is not null").distinct()
    src, dst = nodes.withColumnRenamed("node", "src"), nodes.withColumnRenamed("node", "dst")
    return nodes, links.join(src, ["grp", "src"], "left_semi").join(dst, ["grp", "dst"], "left_semi")


def split_groups(links: DataFrame, local_links: int) -> tuple[DataFrame, DataFrame | None]:
    """Links of groups that fit one task, and those of larger groups if there are any."""
    big = links.groupBy("grp").count().where(F.col("count") > local_links).select("grp")
    if big.isEmpty():
        return links, None
    big = cut(big)
    return links.join(big, "grp", "left_anti"), links.join(big, "grp", "left_semi")


def by_group(rows: DataFrame, run: Callable[[str, list, list], Iterator[tuple]], schema: str, types: pa.Schema) -> DataFrame:
    """`run(grp, src, dst)` for every group of rows(grp, src, dst), its tuples as rows.

    Groups are clustered and sorted, so that a task works through all of its groups without
    a call from Spark for each; it holds one group and one batch of results at a time.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(3)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for grp, members in groupby(flat(batches), lambda r: r[0]):
            _, src, dst = zip(*members)
            for row in run(grp, list(src), list(dst)):
                held.append(row)
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)

    return rows.select("grp", "src", "dst").repartition("grp").sortWithinPartitions("grp").mapInArrow(task, schema)


_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())


def _local_closure(grp: str, src: list[str], dst: list[str]) -> Iterator[tuple]:
    g = ChainGraph([*src, *dst], list(zip(src, dst)))
    named = [[g.keys[v] for v in run] for run in g.members]
    for v in range(g.n):
        if g.out[v]:
            for c, a, b, d in g.intervals(v):
                yield grp, g.keys[v], d, named[c][a:b]


def _expanded(intervals: DataFrame) -> DataFrame:
    """The pairs of intervals(grp, ancestor, first, members)."""
    return intervals.select("grp", "ancestor", "first", F.posexplode("members").alias("i", "descendant")).select("grp", "ancestor", "descendant", (F.col("first") + F.col("i")).alias("distance"))


def _undominated(entries: DataFrame) -> DataFrame:
    """Of entries(grp, ancestor, chain, place, dist, ..) those that no entry further up the
    chain serves as well."""
    w = Window.partitionBy("grp", "ancestor", "chain").orderBy("place", "dist").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.col("dist") - F.col("place")).over(w)
    return entries.withColumn("_best", best).where("_best is null or dist - place < _best").drop("_best")


def _distributed_closure(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Entries of chains are relaxed: each covers the rest of its chain, and every other link
    that leaves what it covers is a new entry, until none serves a place better."""
    links = cut(links)
    known = cut(_distributed_forest(nodes, links).select("grp", "node", "parent", "chain", "place"))
    src = known.select("grp", F.col("node").alias("src"), F.col("chain").alias("c1"), F.col("place").alias("p1"))
    dst = known.select("grp", F.col("node").alias("dst"), F.col("parent"), F.col("chain"), F.col("place"))
    placed = cut(links.join(src, ["grp", "src"]).join(dst, ["grp", "dst"]))
    heavy = F.coalesce((F.col("parent") == F.col("src")) & (F.col("c1") == F.col("chain")), F.lit(False))
    side = cut(placed.where(~heavy).select("grp", F.col("c1").alias("chain"), "p1", F.col("chain").alias("c2"), F.col("place").alias("p2")).distinct())
    fresh = cut(_undominated(placed.select("grp", F.col("src").alias("ancestor"), "chain", "place", F.lit(1).alias("dist"))))
    entries = fresh
    while not fresh.isEmpty():
        step = fresh.join(side, ["grp", "chain"]).where("p1 >= place")
        step = step.groupBy("grp", "ancestor", F.col("c2").alias("chain"), F.col("p2").alias("place")).agg(F.min(F.col("dist") + F.col("p1") - F.col("place") + 1).alias("dist"))
        both = cut(_undominated(entries.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.lit(True)))))
        entries, fresh = both.drop("new"), both.where("new").drop("new")
    length = known.groupBy("grp", "chain").agg(F.max("place").alias("last"))
    after = F.lead("place").over(Window.partitionBy("grp", "ancestor", "chain").orderBy("place"))
    spans = entries.withColumn("after", after).join(length, ["grp", "chain"])
    spans = spans.select("grp", "ancestor", "chain", "dist", F.col("place").alias("from"), F.explode(F.sequence(F.col("place"), F.coalesce(F.col("after") - 1, F.col("last")))).alias("place"))
    at = known.select("grp", "chain", "place", F.col("node").alias("descendant"))
    return spans.join(at, ["grp", "chain", "place"]).select("grp", "ancestor", "descendant", (F.col("dist") + F.col("place") - F.col("from")).cast("int").alias("distance"))


def closure(nodes: DataFrame, links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(grp, ancestor, descendant, distance) for every ordered pair joined by one or more
    links, with the least number of links; a node on a cycle is paired with itself.

    `nodes` has grp and node, `links` grp, src and dst (other columns are ignored). Defined
    cases: nulls and links to keys that are no nodes are left out, repeated rows count once,
    empty tables give no rows.
    """
    nodes, links = clean_links(nodes.select("grp", "node"), links.select("grp", "src", "dst"))
    links = cut(links)
    small, large = split_groups(links, local_links)
    types = pa.schema([("grp", _TEXT), ("ancestor", _TEXT), ("first", pa.int32()), ("members", _TEXTS)])
    out = _expanded(by_group(small, _local_closure, "grp string, ancestor string, first int, members array<string>", types))
    return out if large is None else out.unionByName(_distributed_closure(_of_groups(nodes, large), large))


def _of_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(links.select("grp").distinct(), "grp", "left_semi")


def _local_forest(grp: str, src: list[str], dst: list[str | None]) -> Iterator[tuple]:
    g = ChainGraph([*src, *(d for d in dst if d is not None)], [(a, b) for a, b in zip(src, dst) if b is not None])
    for v in g.order:
        yield grp, g.keys[v], g.depth[v], g.keys[g.root[v]], g.keys[g.parent[v]] if g.parent[v] >= 0 else None, g.path(v), g.size[v], g.keys[g.members[g.chain[v]][0]], g.place[v], g.cyclic[v]


FOREST_SCHEMA = "grp string, node string, depth int, root string, parent string, path array<string>, subtree int, chain string, place int, on_cycle boolean"


def forest(nodes: DataFrame, links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """One row per node: depth (fewest links from a root), root, parent, path from the root
    (keys), subtree size, chain (its first key) and place on it, and whether it depends on
    itself.

    Roots are nodes nothing links to; of a cycle nothing else links to, the smallest key.
    For groups beyond `local_links` depth, root, parent, path and on_cycle come from
    distributed level joins and subtree, chain and place from the paths. Cases as `closure`.
    """
    nodes, links = clean_links(nodes.select("grp", "node"), links.select("grp", "src", "dst"))
    links = cut(links)
    small, large = split_groups(links, local_links)
    lone = nodes if large is None else nodes.join(large.select("grp").distinct(), "grp", "left_anti")
    rows = small.unionByName(lone.select("grp", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
    types = pa.schema([(n, t) for n, t in zip("grp node depth root parent path subtree chain place on_cycle".split(), [_TEXT, _TEXT, pa.int32(), _TEXT, _TEXT, _TEXTS, pa.int32(), _TEXT, pa.int32(), pa.bool_()])])
    out = by_group(rows, _local_forest, FOREST_SCHEMA, types)
    return out if large is None else out.unionByName(_distributed_forest(_of_groups(nodes, large), large))


def _trimmed(links: DataFrame) -> DataFrame:
    """Links that may lie on a cycle: both their ends are entered and left by such links."""
    left = links.count()
    while left:
        src, dst = links.select("grp", F.col("src").alias("dst")).distinct(), links.select("grp", F.col("dst").alias("src")).distinct()
        links = cut(links.join(dst, ["grp", "src"], "left_semi").join(src, ["grp", "dst"], "left_semi"))
        before, left = left, links.count()
        if left == before:
            break
    return links


def _cycles(links: DataFrame) -> DataFrame:
    """(grp, node, comp) of nodes on cycles, `comp` the smallest of those they share one with.

    What lies on no cycle is trimmed off. In the rest every node takes the smallest node that
    reaches it as its colour; those that reach the node their colour names share a cycle with
    it. They are taken out, and the rest is trimmed and coloured again.
    """
    core = cut(links.where("src <> dst"))
    found = [cut(links.where("src = dst").select("grp", F.col("src").alias("node"), F.col("src").alias("comp")).distinct())]
    while True:
        core = _trimmed(core)
        if core.isEmpty():
            break
        colour = cut(core.select("grp", F.col("src").alias("node"), F.col("src").alias("c")).distinct())
        moved = True
        while moved:
            came = core.join(colour.withColumnRenamed("node", "src"), ["grp", "src"]).groupBy("grp", F.col("dst").alias("node")).agg(F.min("c").alias("n"))
            step = cut(colour.join(came, ["grp", "node"]).select("grp", "node", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
            moved, colour = not step.where("moved").isEmpty(), step.select("grp", "node", "c")
        a, b = colour.select("grp", F.col("node").alias("src"), "c"), colour.select("grp", F.col("node").alias("dst"), F.col("c").alias("d"))
        within = cut(core.join(a, ["grp", "src"]).join(b, ["grp", "dst"]).where("c = d").select("grp", "src", "dst"))
        front = cut(colour.where("node = c"))
        levels = [front]
        while not front.isEmpty():
            into = within.join(front.withColumnRenamed("node", "dst"), ["grp", "dst"]).select("grp", F.col("src").alias("node"), "c").distinct()
            front = cut(into.join(union(levels).select("grp", "node"), ["grp", "node"], "left_anti"))
            levels.append(front)
        done = cut(union(levels).select("grp", "node", F.col("c").alias("comp")))
        found.append(done)
        out = done.select("grp", F.col("node"))
        core = cut(core.join(out.withColumnRenamed("node", "src"), ["grp", "src"], "left_anti").join(out.withColumnRenamed("node", "dst"), ["grp", "dst"], "left_anti"))
    return union(found).groupBy("grp", "node").agg(F.min("comp").alias("comp"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _distributed_forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    links, nodes = cut(links), cut(nodes)
    comp = cut(_cycles(links))
    tagged = nodes.join(comp, ["grp", "node"], "left").select("grp", "node", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNotNull().alias("on_cycle"))
    tagged = cut(tagged)
    src = tagged.select("grp", F.col("node").alias("src"), F.col("comp").alias("cs"))
    dst = tagged.select("grp", F.col("node").alias("dst"), F.col("comp").alias("cd"))
    entered = links.join(src, ["grp", "src"]).join(dst, ["grp", "dst"]).where("cs <> cd").select("grp", F.col("cd").alias("comp")).distinct()
    roots = tagged.join(entered, ["grp", "comp"], "left_anti").where("node = comp")
    level = cut(roots.select("grp", "node", F.lit(0).alias("depth"), F.col("node").alias("root"), F.lit(None).cast("string").alias("parent"), F.array("node").alias("path")))
    # each level is written once; a node found at an earlier one is not found again
    levels = [level]
    while not level.isEmpty():
        step = level.join(links, (level.grp == links.grp) & (level.node == links.src)).select(level.grp, F.col("dst").alias("node"), "root", F.col("src").alias("parent"), "path")
        step = step.join(union([x.select("grp", "node") for x in levels]), ["grp", "node"], "left_anti")
        # of several parents the one whose own path comes first, as a queue would have it
        best = step.groupBy("grp", "node").agg(F.min(F.struct("path", "root", "parent")).alias("b"))
        level = cut(best.select("grp", "node", F.lit(len(levels)).alias("depth"), "b.root", "b.parent", F.concat("b.path", F.array("node")).alias("path")))
        levels.append(level)
    done = cut(union(levels))
    sizes = done.select("grp", F.explode("path").alias("node")).groupBy("grp", "node").agg(F.count("*").cast("int").alias("subtree"))
    sized = cut(done.join(sizes, ["grp", "node"]))
    # the heavy child of each parent: largest subtree, then smallest key
    heavy = sized.where("parent is not null").groupBy("grp", "parent").agg(F.min(F.struct((-F.col("subtree")).alias("s"), F.col("node").alias("n"))).n.alias("node"))
    flagged = cut(sized.join(heavy.select("grp", "node", F.lit(True).alias("heavy")), ["grp", "node"], "left"))
    heads = (
        flagged.select("grp", F.col("node").alias("leaf"), F.posexplode("path").alias("i", "node"))
        .join(flagged.where("heavy is null").select("grp", "node"), ["grp", "node"], "left_semi")
        .groupBy("grp", F.col("leaf").alias("node"))
        .agg(F.max(F.struct("i", F.col("node").alias("head"))).alias("h"))
    )
    placed = flagged.join(heads, ["grp", "node"]).join(tagged.select("grp", "node", "on_cycle"), ["grp", "node"])
    return placed.select("grp", "node", "depth", "root", "parent", "path", "subtree", F.col("h.head").alias("chain"), (F.col("depth") - F.col("h.i")).cast("int").alias("place"), "on_cycle")
