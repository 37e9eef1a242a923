"""Components under random changes against a plain union-find of the whole."""

import random

import pytest

from goldweave import plans, storage
from goldweave.operators import incremental
from goldweave.operators.graph import connected_components, label_all, star_edges
from goldweave.plans import incremental as queries
from goldweave.plans import registry


def plain(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for n, k in sorted(links, key=str):
        if k is not None and n in up:
            a, b = find(first.setdefault(k, n)), find(n)
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def frames(spark, nodes, links):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(list(links) or [(0, None)], "node long, key string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_updates_equal_a_full_run(spark, seed):
    rng = random.Random(seed)
    nodes = set(range(60))
    links = {(n, f"k{rng.randrange(50)}") for n in nodes for _ in range(rng.randrange(3))} | {(n, "hot") for n in range(0, 60, 11)}
    old_nodes, old_links = frames(spark, nodes, links)
    labels = label_all(old_nodes, "node", star_edges(old_links.filter("key is not null"), "node", "key"))
    was = plain(nodes, links)
    for _ in range(2):
        gone = set(rng.sample(sorted(nodes), 5)) | ({0} & nodes)
        now = (nodes - gone) | set(range(max(nodes) + 1, max(nodes) + 6))
        kept = {(n, k) for n, k in links if n in now and rng.random() > 0.15}
        new = kept | {(n, f"k{rng.randrange(50)}") for n in rng.sample(sorted(now), 12)} | {(max(now), None)}
        new_nodes, new_links = frames(spark, now, new)
        found = incremental.update_components(labels, new_links, incremental.compare(old_nodes, old_links, new_nodes, new_links))
        rows = {r["node"]: (r["component"], r["touched"]) for r in found.collect()}
        want = plain(now, new)
        assert {n: c for n, (c, _) in rows.items()} == want
        sets = lambda d: {c: frozenset(n for n in d if d[n] == c) for c in d.values()}
        before, after = sets(was), sets(want)
        assert all(touched for n, (c, touched) in rows.items() if after[c] not in before.values())
        untouched = {c for c, touched in rows.values() if not touched}
        assert untouched
        nodes, links, was, old_nodes, old_links, labels = now, new, want, new_nodes, new_links, found.select("node", "component")


def test_nothing_changes_without_changes(spark):
    nodes, links = frames(spark, range(5), {(1, "a"), (2, "a"), (3, None)})
    labels = label_all(nodes, "node", star_edges(links.filter("key is not null"), "node", "key"))
    found = incremental.update_components(labels, links, incremental.compare(nodes, links, nodes, links)).collect()
    assert {(r["node"], r["component"]) for r in found} == {(0, 0), (1, 1), (2, 1), (3, 3), (4, 4)} and not any(r["touched"] for r in found)


def test_reasons_in_order(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "key long, cluster long")
    stored = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 3, 1)], "key long, lead long, version int")
    some, none = spark.createDataFrame([("k", "f")], "key string, flag string"), spark.createDataFrame([], "key string, flag string")
    twice = some.unionByName(some)
    run = lambda blocked=(some, twice), ties=(none, none), **x: incremental.reproject(clusters, stored, 2, blocked, ties, **x)
    rows = lambda r: {(x["cluster"], x["why"]) for x in r.clusters.collect()}
    assert rows(run()) == {(4, "members changed"), (3, "older version")} and run().full is None
    assert rows(run(blocked=(some, none))) == {(c, "compliance reports changed") for c in (1, 3, 4)}
    assert run(ties=(none, some)).full == "tie answer stored"
    assert run(blocked=(some, none), basis_changed=True).full == "basis changed"


def test_changes_are_stored_once_and_take_repeated_rows(spark):
    """Reading what changed compares nothing again."""
    old, old_links = frames(spark, [1, 2, 2, 3], [(1, "a"), (1, "a"), (2, "b"), (3, None)])
    new, new_links = frames(spark, [2, 3, 4, 4], [(2, "b"), (2, "b"), (3, "c"), (3, "c")])
    found = incremental.compare(old, old_links, new, new_links)
    sides = (found.added, found.withdrawn, found.born, found.gone)
    assert [sorted(map(tuple, d.collect())) for d in sides] == [[(3, "c")], [(1, "a")], [(4,)], [(1,)]]
    assert not any(word in d._jdf.queryExecution().optimizedPlan().toString() for d in sides for word in ("Join", "Aggregate"))


def test_a_full_reprojection_updates_nothing(spark, monkeypatch):
    """Why all is projected is known before any label is; labels of before and changes are for the other case only."""
    plans.load()
    stored = []

    def materialize(df, name):
        stored.append(name)
        return storage.materialize(df, name)

    for module in (incremental, queries):
        monkeypatch.setattr(module, "materialize", materialize)
    rows = registry.QUERIES["j9d_full_reprojection"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r["why"] for r in rows} == {"compliance reports changed"} and not stored
    assert {r["why"] for r in registry.QUERIES["j9c_reprojected_clusters"](spark, "/root/testdata/sf0.001").collect()} == {"members changed", "older version"}
    assert {"before", "changes"} <= set(stored)


def test_broken_and_joined_components_settle_in_one_run(spark, monkeypatch):
    """Only labels that a key joins become edges: components that stay give none, however many links they have."""
    nodes, links = range(40), {(n, f"k{n // 10}") for n in range(40)}
    old_nodes, old_links = frames(spark, nodes, links)
    labels = label_all(old_nodes, "node", star_edges(old_links, "node", "key"))
    new = (links - {(0, "k0"), (5, "k0")}) | {(40, "k1"), (15, "k9"), (25, "k9")}  # the first breaks, the next two meet, the last stays
    new_nodes, new_links = frames(spark, range(41), new)
    runs = []

    def components(edges):
        runs.append({tuple(r) for r in edges.collect()})
        return connected_components(edges)

    monkeypatch.setattr(incremental, "connected_components", components)
    found = incremental.update_components(labels, new_links, incremental.compare(old_nodes, old_links, new_nodes, new_links)).collect()
    assert {r["node"]: r["component"] for r in found} == plain(range(41), new)
    assert {r["component"] for r in found if not r["touched"]} == {30}
    assert runs == [{(1, n) for n in (2, 3, 4, 6, 7, 8, 9)} | {(10, 40), (10, 20)}]
