"""Dependency graphs as tables: merging nodes, depths, reachability."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .hierarchy import LOCAL_LINKS, by_group, split_groups, union


def _union(c: str):
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Duplicate rows of (project_id, package_key) as one: direct if any is, the least depth,
    and the sorted unions of scopes, dependencies and parents. Equal rows meet before the
    shuffle; nulls count as absent."""
    return nodes.groupBy("project_id", "package_key").agg(
        F.coalesce(F.bool_or("direct"), F.lit(False)).alias("direct"), F.min("depth").alias("depth"), _union("scopes").alias("scopes"), _union("dependencies").alias("dependencies"), _union("parents").alias("parents")
    )


def _local_levels(grp: str, src: list[str], dst: list[str | None]) -> Iterator[tuple]:
    out: dict[str, list[str]] = {}
    depth: dict[str, int] = {}
    for a, b in zip(src, dst):
        if b is None:
            depth[a] = 0
        else:
            out.setdefault(a, []).append(b)
    queue = deque(depth)
    while queue:
        v = queue.popleft()
        for w in out.get(v, ()):
            if w not in depth:
                depth[w] = depth[v] + 1
                queue.append(w)
    for v, d in depth.items():
        yield grp, v, d


def levels(seeds: DataFrame, links: DataFrame, most: int | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(grp, node, depth): fewest links from any seed, the seeds being 0.

    Groups of up to `local_links` links are searched in a task; larger ones level by level,
    each level written once. A node is found once, so cycles end. `most` limits the depth where
    that is wanted. Nulls in seeds and links are left out.
    """
    links = cut(links.select("grp", "src", "dst").where("grp is not null and src is not null and dst is not null").distinct())
    seeds = seeds.select("grp", "node").where("grp is not null and node is not null").distinct()
    small, large = split_groups(links, local_links)
    near = seeds if large is None else seeds.join(large.select("grp").distinct(), "grp", "left_anti")
    rows = small.unionByName(near.select("grp", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
    found = by_group(rows, _local_levels, "grp string, node string, depth int", pa.schema([("grp", pa.string()), ("node", pa.string()), ("depth", pa.int32())]))
    if most is not None:
        found = found.where(F.col("depth") <= most)
    if large is None:
        return found
    front = cut(seeds.join(large.select("grp").distinct(), "grp", "left_semi").withColumn("depth", F.lit(0)))
    done = [front]
    while not front.isEmpty() and (most is None or len(done) <= most):
        step = front.join(large, (front.grp == large.grp) & (front.node == large.src)).select(front.grp, F.col("dst").alias("node")).distinct()
        seen = union([x.select("grp", "node") for x in done])
        front = cut(step.join(seen, ["grp", "node"], "left_anti").withColumn("depth", F.lit(len(done))))
        done.append(front)
    return found.unionByName(union(done))


def summary(nodes: DataFrame) -> DataFrame:
    """Per project: packages, direct and transitive ones, greatest depth, packages by ecosystem
    (those of a null ecosystem count in the totals only)."""
    eco = nodes.where("ecosystem is not null").groupBy("project_id", "ecosystem").agg(F.countDistinct("package_key").alias("n"))
    by = eco.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ecosystem", "n")))).alias("by_ecosystem"))
    one = merge_nodes(nodes)
    tot = one.groupBy("project_id").agg(
        F.count("*").alias("total"), F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("transitive"), F.max("depth").alias("max_depth")
    )
    return tot.alias("t").join(by.alias("b"), F.expr("t.project_id <=> b.project_id"), "left").select("t.*", "by_ecosystem")
