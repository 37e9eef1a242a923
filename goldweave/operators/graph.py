"""Graphs as edge tables: star edges, connected components, walks to active nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from goldweave.storage import discard, materialize


def star_edges(rows: DataFrame, node: str, *keys: str | Column) -> DataFrame:
    """(u, v): every holder of a key beside the smallest holder; n edges, never n squared.

    Repeated rows give repeated edges, which are dropped once, at the end.
    """
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    held = rows.select(F.col(node).alias("v"), F.struct(*named).alias("k"))
    least = held.groupBy("k").agg(F.min("v").alias("u"))
    return held.join(least, "k").filter("u <> v").select("u", "v").distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple, DataFrame]:
    """``edges`` as a stored table, its size and sum of hashes, which are counted while it is written, and the table to discard."""
    seen = Observation()
    counted = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    out = materialize(counted, "edges")
    # Stated, as a join would infer it on one side only, and what two branches share would be computed twice.
    return out.filter("u is not null and v is not null"), (seen.get["n"], seen.get["h"]), out


def _merge(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of the nodes of ``edges``, stored, a parent being the smallest of a node and its neighbours; and the edges between parents, once each."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    parents = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")), "parents")
    end = lambda name, out: parents.select(F.col("node").alias(name), F.col("parent").alias(out))
    ends = edges.join(end("u", "a"), "u").join(end("v", "b"), "v").filter("a <> b")
    return parents, ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v); a component is its smallest node.

    Nodes are merged into their smallest neighbour as long as that leaves half of the edges
    at most, so that all rounds together cost little more than the first; members get the
    component of what they were merged into.  What does not shrink so (long paths) is
    settled by alternating stars: larger neighbours, then smaller ones, hang on the
    smallest.  Each round is stored, and hubs are only ever aggregated and joined.
    """
    now, seen, table = _stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"))  # every round drops repeated edges
    merged = []
    halved = True
    while seen[0] and halved:
        parents, left = _merge(now)
        merged.append(parents)
        older, last = table, seen
        now, seen, table = _stored(left)
        discard(older)
        halved = 2 * seen[0] <= last[0]
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        older, last = table, seen
        now, seen, table = _stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(older)
        if seen == last:
            break
    else:
        raise RuntimeError("components have not settled")
    tips = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = tips.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if merged and not seen[0]:
        found = merged.pop().withColumnRenamed("parent", "component")
    for parents in reversed(merged):
        above = parents.join(found.withColumnRenamed("node", "parent"), "parent", "left")
        found = above.select("node", F.coalesce("component", "parent").alias("component"))
    return found


def label_all(nodes: DataFrame, node: str, edges: DataFrame, label: str = "component") -> DataFrame:
    """``nodes`` with their component; a node without edges is its own."""
    found = connected_components(edges).select(F.col("node").alias(node), F.col("component").alias(label))
    return nodes.join(found, node, "left").withColumn(label, F.coalesce(label, node))


def walk_to_active(starts: DataFrame, steps: DataFrame, active: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(start, active): active nodes first met on the paths from each start.

    ``steps`` is (node, next), ``active`` is (node). Visited pairs are kept, so cycles end;
    a path stops at its first active node.
    """
    seen = materialize(starts.select(F.col("node").alias("start"), "node").distinct(), "walk")
    frontier = seen
    for _ in range(max_rounds):
        open_ = frontier.join(active, "node", "left_anti")
        nxt = open_.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = materialize(nxt.join(seen, ["start", "node"], "left_anti"), "walk")
        if frontier.limit(1).count() == 0:
            return seen.join(active, "node", "left_semi").select("start", F.col("node").alias("active"))
        seen = seen.unionByName(frontier)  # rounds stay as they were stored; none is written twice
    raise RuntimeError("the walk has not ended")


def sole_active(starts: DataFrame, found: DataFrame) -> DataFrame:
    """(start, active, problem): the one active node of each start; ``none`` or ``several`` where there is not exactly one."""
    n = found.groupBy("start").agg(F.count("*").alias("n"), F.min("active").alias("active"))
    held = starts.select(F.col("node").alias("start")).distinct().join(n, "start", "left")
    problem = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several")
    return held.select("start", F.when(problem.isNull(), F.col("active")).alias("active"), problem.alias("problem"))
