"""Queries of components and projections under changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators import incremental as N
from goldweave.operators.graph import label_all, star_edges
from goldweave.plans.identity import C_SQL, CLOSURE_SQL, contributions
from goldweave.plans.registry import Tables, query
from goldweave.storage import materialize

# Two snapshots of the log: later rows are new, some rows and some addresses have been withdrawn.
BEFORE, GONE, SILENT = "fetched_at < TIMESTAMP '1996-01-01'", "id % 50 = 1", "id % 45 = 2"
LINK_SQL = "SELECT id, 'l:' || linkedin AS key FROM {t} WHERE linkedin IS NOT NULL UNION SELECT id, 'e:' || email FROM {t} WHERE verified AND email LIKE 'p%'"
SNAPSHOT_SQL = f"""{C_SQL}, c0 AS (SELECT * FROM c WHERE {BEFORE}), c1 AS (SELECT * FROM c WHERE NOT ({GONE})),
k0 AS ({LINK_SQL.format(t='c0')}), k1 AS (SELECT * FROM ({LINK_SQL.format(t='c1')}) WHERE NOT ({SILENT} AND key LIKE 'e:%')),
e0 AS (SELECT DISTINCT a.id AS u, b.id AS v FROM k0 a JOIN k0 b USING (key) WHERE a.id <> b.id), e1 AS (SELECT DISTINCT a.id AS u, b.id AS v FROM k1 a JOIN k1 b USING (key) WHERE a.id <> b.id),
{CLOSURE_SQL.format(name='g0', edges='e0').replace('FROM c UNION', 'FROM c0 UNION')}, {CLOSURE_SQL.format(name='g1', edges='e1').replace('FROM c UNION', 'FROM c1 UNION')}"""
MOVED_SQL = """m0 AS (SELECT cluster, list_sort(list(id)) AS m FROM g0 GROUP BY 1), m1 AS (SELECT cluster, list_sort(list(id)) AS m FROM g1 GROUP BY 1),
moved AS (SELECT cluster FROM m1 WHERE m NOT IN (SELECT m FROM m0)), old AS (SELECT DISTINCT g1.cluster FROM g1 JOIN g0 USING (id) WHERE g0.cluster % 7 = 0)"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and links, before and now."""
    c = contributions(t)
    held = F.array(
        F.when(F.col("linkedin").isNotNull(), F.concat(F.lit("l:"), "linkedin")),
        F.when(F.col("verified") & F.col("email").startswith("p"), F.concat(F.lit("e:"), "email")),
    )
    rows = c.select(F.col("id").alias("node"), "id", "fetched_at", F.explode(held).alias("key")).filter("key is not null")
    now = f"NOT ({GONE})"
    silent = f"NOT ({SILENT} AND key LIKE 'e:%')"
    nodes = c.select(F.col("id").alias("node"), "id", "fetched_at")
    return nodes.filter(BEFORE), rows.filter(BEFORE).select("node", "key"), nodes.filter(now), rows.filter(f"{now} AND {silent}").select("node", "key")


def updated(found: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Labels before by a full run over a snapshot, and labels now by an update of them."""
    old_nodes, old_links, nodes, links = found
    before = materialize(label_all(old_nodes.select("node"), "node", star_edges(old_links, "node", "key")), "before")
    return before, N.update_components(before, links, N.compare(old_nodes, old_links, nodes, links))


@query("j9b_incremental_components", f"WITH RECURSIVE {SNAPSHOT_SQL} SELECT id, cluster AS component FROM g1")
def j9b(t: Tables) -> DataFrame:
    """Equal to a full run over the new snapshot."""
    return updated(snapshots(t))[1].select(F.col("node").alias("id"), "component")


def _reproject(t: Tables, flagged: str) -> N.Reprojection:
    found = old_nodes, _, nodes, links = snapshots(t)
    flags = nodes.filter(flagged).select("node", F.lit("opt_out").alias("flag"), (F.col("id") % 3).alias("source"))
    merged = flags.join(old_nodes.select("node"), "node", "left_semi")  # a flag blocked keys before where its node was there
    none = nodes.select("node").limit(0)
    why = N.full_reason((N.blocked_keys(links, merged), N.blocked_keys(links, flags)), (none, none))
    if why:  # all clusters of now, whatever they were before
        return N.project_all(label_all(nodes.select(F.col("node").alias("key")), "key", star_edges(links, "node", "key"), "cluster"), why)
    before, now = updated(found)
    stored = before.select(F.col("node").alias("key"), F.col("component").alias("lead"), F.when(F.col("component") % 7 == 0, 1).otherwise(2).alias("version"))
    return N.project_changed(now.select(F.col("node").alias("key"), F.col("component").alias("cluster")), stored, 2)


@query("j9c_reprojected_clusters", f"WITH RECURSIVE {SNAPSHOT_SQL}, {MOVED_SQL} SELECT cluster, 'members changed' AS why FROM moved UNION ALL SELECT cluster, 'older version' FROM old WHERE cluster NOT IN (SELECT cluster FROM moved)")
def j9c(t: Tables) -> DataFrame:
    """Flags stand on rows that were merged before, so no report has changed."""
    return _reproject(t, f"{BEFORE} AND id % 40 = 0").clusters


@query("j9d_full_reprojection", f"WITH RECURSIVE {SNAPSHOT_SQL} SELECT DISTINCT cluster, 'compliance reports changed' AS why FROM g1")
def j9d(t: Tables) -> DataFrame:
    """Flags on new rows change the reports."""
    return _reproject(t, "id % 40 = 0").clusters
