"""Components and projections kept up to date under added and withdrawn links.

Links are rows (node, key): nodes that hold a key belong together.  A batch of changes
touches the components that lose a link and those that gain one.  Nodes of the first
start again, each with a label of its own; all other components keep theirs and are joined
as wholes.  One pass over the links finds the keys that hold several labels, and one run
of components over these labels settles both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators.graph import connected_components, star_edges
from goldweave.operators.resolve import changed_clusters
from goldweave.storage import materialize


@dataclass(frozen=True)
class Changes:
    """Links that came and went, and nodes that did: (node, key), (node, key), (node), (node)."""

    added: DataFrame
    withdrawn: DataFrame
    born: DataFrame
    gone: DataFrame


def compare(nodes_before: DataFrame, links_before: DataFrame, nodes: DataFrame, links: DataFrame) -> Changes:
    """What changed between two snapshots, stored; a null key links nothing."""
    pairs = _came_and_went(links_before.filter("key is not null"), links.filter("key is not null"), ["node", "key"])
    alone = _came_and_went(nodes_before, nodes, ["node"])
    came, went = F.col("side") == 2, F.col("side") == 1
    return Changes(*[x.filter(side).drop("side") for x in (pairs, alone) for side in (came, went)])


def _came_and_went(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    return materialize(_on_one_side(before, after, on), "changes")


def _on_one_side(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """(*on, side): rows of one snapshot only, 1 the first and 2 the second, by one aggregation of both."""
    both = before.select(*on, F.lit(1).alias("side")).unionByName(after.select(*on, F.lit(2).alias("side")))
    return both.groupBy(*on).agg(F.bit_or("side").alias("side")).filter("side < 3")


def update_components(labels: DataFrame, links: DataFrame, changes: Changes) -> DataFrame:
    """(node, component, touched): ``labels`` (node, component) after ``changes``; ``links`` are all links there are now.

    A component is its smallest node, as a full run would say.  ``touched`` marks nodes of
    components that lost or gained a link or a node.
    """
    links = links.filter("key is not null").select("node", "key")
    broken = changes.withdrawn.select("node").unionByName(changes.gone).distinct().join(labels, "node").select("component").distinct().withColumn("broken", F.lit(True))
    gained = changes.added.select("node").distinct().withColumn("gained", F.lit(True))
    left = labels.select("node", "component", F.lit(False).alias("fresh")).join(changes.gone, "node", "left_anti")
    left = left.unionByName(changes.born.select("node", F.col("node").alias("component"), F.lit(True).alias("fresh")))
    moved = F.col("fresh") | F.coalesce("broken", "gained", F.lit(False))
    label = F.when(F.col("broken"), F.col("node")).otherwise(F.col("component"))
    left = materialize(left.join(broken, "component", "left").join(gained, "node", "left").select("node", label.alias("label"), moved.alias("moved")), "left")
    # A key whose holders have one label links nothing; what is left is a graph over labels.
    held = materialize(links.join(left, "node").select("label", "key"), "held")
    joined = connected_components(star_edges(held, "label", "key")).withColumnRenamed("node", "label")
    out = materialize(left.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("component"), "moved"), "labels")
    touched = out.filter("moved").select("component").distinct().withColumn("touched", F.lit(True))
    return out.join(touched, "component", "left").select("node", "component", F.coalesce("touched", F.lit(False)).alias("touched"))


def _differ(before: DataFrame, after: DataFrame) -> bool:
    """Whether two sets of rows are not the same."""
    return not _on_one_side(before, after, before.columns).isEmpty()


@dataclass(frozen=True)
class Reprojection:
    """clusters (cluster, why) to be projected; ``full`` says why all are, or is None."""

    clusters: DataFrame
    full: str | None


def full_reason(blocked: tuple[DataFrame, DataFrame], ties: tuple[DataFrame, DataFrame], basis_changed: bool = False) -> str | None:
    """Why everything is to be projected, or None; known before any cluster is.

    ``blocked`` and ``ties`` are the blocked identities and the answers to ties, before and
    now: any lead may depend on these.
    """
    return "basis changed" if basis_changed else "compliance reports changed" if _differ(*blocked) else "tie answer stored" if _differ(*ties) else None


def project_all(clusters: DataFrame, why: str) -> Reprojection:
    """All clusters (key, cluster); what is stored is not looked at."""
    return Reprojection(clusters.select("cluster").distinct().withColumn("why", F.lit(why)), why)


def project_changed(clusters: DataFrame, stored: DataFrame, version: int) -> Reprojection:
    """Clusters (key, cluster) whose members are not exactly a lead's, and those whose lead has an older version; ``stored`` (key, lead, version) are the active leads."""
    moved = changed_clusters(stored.select("key", F.col("lead").alias("cluster")), clusters).select("cluster", F.lit("members changed").alias("why"))
    old = stored.filter(F.col("version") < version).select("key").distinct()
    stale = clusters.join(old, "key", "left_semi").select("cluster").distinct().join(moved, "cluster", "left_anti")
    return Reprojection(moved.unionByName(stale.select("cluster", F.lit("older version").alias("why"))), None)


def reproject(
    clusters: DataFrame,
    stored: DataFrame,
    version: int,
    blocked: tuple[DataFrame, DataFrame],
    ties: tuple[DataFrame, DataFrame],
    basis_changed: bool = False,
) -> Reprojection:
    """Clusters that need projecting, against what is stored: all for a ``full_reason``, else those that ``project_changed`` names."""
    full = full_reason(blocked, ties, basis_changed)
    return project_all(clusters, full) if full else project_changed(clusters, stored, version)


def blocked_keys(links: DataFrame, flags: DataFrame) -> DataFrame:
    """(key, flag, source): what flagged nodes (node, flag, source) are known by."""
    return links.filter("key is not null").join(flags, "node").select("key", "flag", "source").distinct()
