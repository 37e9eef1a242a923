"""Order independence, ties, nulls and empty inputs of operators; sinks; streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from goldweave import storage
from goldweave.operators import buckets, graph, identity, people, resolve, sequence, sinks
from goldweave.plans import registry
from goldweave.plans import resolution as bound
from goldweave.sources import catalog, fixtures

SF = "/root/testdata/sf0.001"
CONTRIBUTION = "id long, linkedin string, email string, verified boolean, name string, domain string, title string, employer string, fetched_at timestamp"
T0 = datetime(2024, 1, 1)


def contribution(i, linkedin=None, email=None, verified=False, name=None, domain=None, title=None, employer=None):
    return (i, linkedin, email, verified, name, domain, title, employer, T0)


def groups(spark, rows):
    c = spark.createDataFrame(rows, CONTRIBUTION)
    found = {}
    for r in identity.clusters(c).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(sorted, found.values()))


def test_links_of_each_kind(spark):
    rows = [
        contribution(1, linkedin="l/a", email="a@x.example", verified=True), contribution(2, linkedin="l/a"),
        contribution(3, email="a@x.example", verified=True), contribution(4, name="n", domain="d", title="t"),
        contribution(5, name="n", domain="d", title="t"), contribution(6, name="n", domain="d", title="u"), contribution(7),
    ]
    want = [[1, 2, 3], [4, 5], [6], [7]]
    assert groups(spark, rows) == want
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        assert groups(spark, rows) == want


def test_addresses_of_two_people_link_nobody(spark):
    rows = [
        contribution(1, email="info@x.example", verified=True), contribution(2, email="info@x.example", verified=True),
        contribution(3, email="s@x.example", verified=True, name="a"), contribution(4, email="s@x.example", verified=True, name="b"),
    ]
    assert groups(spark, rows) == [[1], [2], [3], [4]]


def test_email_links_only_beside_a_bare_holder(spark):
    rows = [contribution(1, linkedin="l/a", email="m@x.example", verified=True), contribution(2, linkedin="l/b", email="m@x.example", verified=True)]
    assert groups(spark, rows) == [[1], [2]]


def test_no_contributions(spark):
    assert groups(spark, []) == []


@pytest.mark.parametrize("shape", ["path", "star", "cycle", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 60
    edges = {
        "path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "cycle": [(i, (i + 1) % n) for i in range(n)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)],
    }[shape]
    parent = list(range(n + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_cost_little_more_than_their_first_round(spark, monkeypatch):
    """Stars of stars: members leave in the first round, and only hubs are linked again; a path of stars is settled too."""
    stars = [(100 * h, 100 * h + i) for h in range(30) for i in range(1, 20)] + [(100 * (h - h % 3), 100 * h + 7) for h in range(30) if h % 3]
    path = [(10_000 + 100 * h, 10_000 + 100 * h + i) for h in range(30) for i in range(1, 4)] + [(10_000 + 100 * h, 10_100 + 100 * h) for h in range(29)]
    stored = []

    def materialize(df, name):
        out = storage.materialize(df, name)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "materialize", materialize)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {x: x // 300 * 300 for e in stars for x in e}
    assert sum(n for name, n in stored if name == "edges") < 1.2 * len(stars) and sum(n for name, n in stored if name == "parents") < 1.2 * len(got)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(stars + path, "u long, v long")).collect()}
    assert got == {x: x // 300 * 300 if x < 10_000 else 10_000 for e in stars + path for x in e}


def test_people_are_asked_once(spark, monkeypatch):
    """Whom to ask, with anchors that only some records have; no row is shuffled once for each count, and ladders are not stored."""
    rows = [
        (1, "a", None, None, True), (2, "a", "m", "n", False), (3, None, "m", "n", True),  # one person: 3 has an anchor of its own, 1 a stronger one
        (4, "b", "x", None, True), (5, "c", "x", None, True), (6, None, "x", None, True),  # two profiles: each asks for itself, 6 has no anchor
        (7, None, "y", "k", False), (8, None, "y", None, True),  # its anchor is on a record without lookups: nobody is asked
        (9, None, None, "z", True), (10, "e", None, None, False),
    ]
    records = spark.createDataFrame(rows, "id long, linkedin string, email string, name string, able boolean")
    step = F.struct(F.lit("id").alias("rung"), F.concat(F.lit("r"), F.col("id")).alias("lookup"))
    lookups = F.when(F.col("able"), F.array(step)).otherwise(F.array().cast("array<struct<rung:string,lookup:string>>"))
    anchor = F.when(F.col("linkedin").isNotNull(), "linkedin_url").when(F.col("name").isNotNull(), "name")
    stored = []

    def materialize(df, name):
        stored.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return storage.materialize(df, name)

    monkeypatch.setattr(people, "materialize", materialize)
    askers, ladder, lost = people.ask_people(records, lookups, anchor)
    assert sorted(map(tuple, askers.collect())) == [(1, 1, "linkedin_url", "a"), (4, 4, "linkedin_url", "b"), (5, 4, "linkedin_url", "c"), (9, 9, "name", None)]
    assert sorted((r["asker"], r["lookup"]) for r in ladder.collect()) == [(1, "r1"), (1, "r3"), (4, "r4"), (5, "r5"), (9, "r9")]
    assert sorted(r["person"] for r in lost.collect()) == [4, 7]
    assert stored and not any("Expand" in plan or "lookups" in columns for columns, plan in stored)


def test_walk_ends_on_cycles(spark):
    steps = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "node long, next long")
    starts = spark.createDataFrame([(1,), (4,)], "node long")
    got = graph.walk_to_active(starts, steps, spark.createDataFrame([(3,)], "node long")).collect()
    assert [tuple(r) for r in got] == [(1, 3)]


def test_resolution_ignores_order(spark):
    t = registry.Tables(spark, SF)
    c = bound.candidates(t)
    first = sorted(map(tuple, resolve.winners(c).collect()))
    assert first == sorted(map(tuple, resolve.winners(c.repartition(7).orderBy(F.rand(3))).collect()))


def test_absent_confidence_ranks_as_zero(spark):
    rows = [("c", "p", "s1", "x", 1, 1, None, T0, "r", False), ("c", "p", "s2", "y", 1, 1, 0.1, T0, "r", False)]
    c = spark.createDataFrame(rows, "cluster string, path string, source string, value string, trust int, tier int, confidence double, fetched_at timestamp, raw_path string, echo boolean")
    assert resolve.winners(c).first()["value"] == "y"
    assert resolve.decided_by(resolve.rank_candidates(c)).first()["decided_by"] == "confidence"


def test_append_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sha string, v int")
    path = f"file://{tmp_path}/log"
    assert [sinks.append(batch, path, "sha"), sinks.append(batch, path, "sha")] == [2, 0]
    assert spark.read.parquet(path).count() == 2


def test_tick_twice_appends_once(spark):
    log = spark.createDataFrame([(k, "invite", datetime(2024, 1, 1)) for k in range(20)], "key long, kind string, at timestamp_ntz")
    facts = log.select("key", F.lit(False).alias("opted_out"), F.lit(True).alias("usable_email"))
    now = F.expr("timestamp_ntz '2024-01-09 00:00:00'")
    fresh = sequence.tick(log, now, facts, 3, 0.5, 3)
    assert fresh.count() >= 20
    assert sequence.tick(log.unionByName(fresh), now, facts, 3, 0.5, 3).count() == 0


@pytest.mark.parametrize(("block", "retries"), [(1024, False), (7, False), (1, True), (16, True)])
def test_throttle_against_a_plain_bucket(spark, block, retries):
    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), round(rng.random() * 60, 3), i) for i in range(200))
    windows = [(2, 1.0), (20, 30.0)]
    want, state, pause = {}, {}, {}
    retry = {i: rng.choice([None, 0.5, 3.0]) if retries else None for _, _, i in rows}
    for key, at, i in rows:
        tokens, clock = state.get(key, ([c for c, _ in windows], at))
        now = max(at, clock + pause.get((key, clock), 0))
        tokens = [min(c, x + (now - clock) * c / s) for x, (c, s) in zip(tokens, windows)]
        wait = max([0.0] + [(1 - x) * s / c for x, (c, s) in zip(tokens, windows)])
        state[key] = [min(c, x + wait * c / s) - 1 for x, (c, s) in zip(tokens, windows)], now + wait
        want[i] = now + wait - at
        pause[key, now + wait] = retry[i] or 0
    df = spark.createDataFrame([(*r, retry[r[2]]) for r in rows], "key string, at double, i long, retry double")
    got = buckets.throttle(df, "key", "at", "i", windows, "retry", block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["waited"] == pytest.approx(want[r["i"]], abs=1e-6)


def test_unmapped_leaves(spark):
    schema = spark.createDataFrame([], "a string, b struct<c:int,d:array<struct<e:int>>>").schema
    assert fixtures.unmapped(schema, [fixtures.FieldRule("b.c", "x")], {"a"}) == ["b.d[].e"]


def test_fixture_scan(spark, tmp_path):
    (tmp_path / "people").mkdir()
    (tmp_path / "people" / "search.json").write_text('{"people": [{"id": "1",\n "name": null}, {"id": "2", "name": "x"}]}')
    raw = fixtures.read_fixture(spark, f"file://{tmp_path}", "people", "search", "people array<struct<id:string,name:string>>").selectExpr("inline(people)")
    rules = [fixtures.FieldRule("name", "person.name")]
    assert [tuple(r) for r in fixtures.to_contributions(raw, "id", rules).collect()] == [("2", "person.name", "x", "name")]
    assert [tuple(r) for r in fixtures.absences(raw, "id", rules, {"person.name"}).collect()] == [("1", "person.name", "negative_evidence")]


def test_technology_list(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Category,Technology\nDatabase,Astra DB 2.0\n")
    assert tuple(fixtures.read_technologies(spark, f"file://{tmp_path}/t.csv").first()) == ("astra_db_2_0", "Database", "Astra DB 2.0")


def test_synthetic_people_repeat(spark):
    one, two = (sorted(map(tuple, catalog.synthetic_people(spark, 5, 4, 9).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == 20


def test_sequence_stream(spark, tmp_path):
    from goldweave.streaming.sequence import due_stream

    src, out = tmp_path / "in", tmp_path / "out"
    rows = [(1, "invite", datetime(2024, 1, 1)), (1, "accepted", datetime(2024, 1, 2)), (2, "invite", datetime(2024, 1, 1)), (3, "halted", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "key long, kind string, at timestamp").coalesce(1).write.parquet(f"file://{src}")
    stream = due_stream(spark.readStream.schema("key long, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{src}"))
    query = stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").start()
    try:
        query.processAllAvailable()
        late = [(9, "invite", datetime(2024, 2, 1)), (9, "halted", datetime(2024, 2, 1))]
        for i in range(2):
            spark.createDataFrame(late, "key long, kind string, at timestamp").coalesce(1).write.mode("append").parquet(f"file://{src}")
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r["key"], r["action"]) for r in spark.read.parquet(f"file://{out}").collect())
    assert got == [(1, "email"), (2, "fallback_email")]


def test_provider_source(spark, tmp_path):
    from goldweave.sources.provider import register

    (tmp_path / "people").mkdir()
    (tmp_path / "people" / "search.json").write_text('{"results": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "people" / "match.json").write_text('{"id": 3}')
    (tmp_path / "people" / "manifest.json").write_text("{}")
    register(spark)
    read = spark.read.format("provider").option("root", str(tmp_path)).option("provider", "people")
    assert sorted(map(tuple, read.load().collect())) == [("match", 1, 0, '{"id": 3}'), ("search", 1, 0, '{"id": 1}'), ("search", 1, 1, '{"id": 2}')]
    assert read.option("endpoint", "match").load().count() == 1


def test_unwanted_pages_are_never_opened(spark, tmp_path):
    from goldweave.sources.provider import register

    (tmp_path / "people" / "search").mkdir(parents=True)
    for i in (1, 2, 10):
        (tmp_path / "people" / "search" / f"{i}.json").write_text(f'{{"results": [{{"id": {i}}}]}}')
    (tmp_path / "people" / "broken.json").write_text("{")
    register(spark)
    read = spark.read.format("provider").option("root", str(tmp_path)).option("provider", "people")
    ids = lambda d: sorted(r["payload"] for r in d.collect())
    found = read.option("endpoint", "search,none").load()
    assert ids(found) == ['{"id": 10}', '{"id": 1}', '{"id": 2}'] and found.rdd.getNumPartitions() == 3
    two, ten = (found.filter(f"page = {n}") for n in (2, 10))
    assert ids(two.union(ten)) == ['{"id": 10}', '{"id": 2}'] and ids(found) == ['{"id": 10}', '{"id": 1}', '{"id": 2}']
    assert ids(read.option("endpoint", "search").option("pages", "2,10,11").load()) == ['{"id": 10}', '{"id": 2}'] and ids(read.option("endpoint", "none").load()) == []
    with pytest.raises(Exception, match="JSONDecodeError"):
        spark.read.format("provider").option("root", str(tmp_path)).option("provider", "people").load().collect()


def test_provider_stream_goes_on_where_it_stopped(spark, tmp_path):
    from goldweave.sources.provider import register

    folder = tmp_path / "people" / "search"
    folder.mkdir(parents=True)
    register(spark)

    def run(pages):
        for i in pages:
            (folder / f"{i}.json").write_text(f'{{"results": [{{"id": {i}}}]}}')
        stream = spark.readStream.format("provider").option("root", str(tmp_path)).option("provider", "people").option("pages_per_batch", 2).load()
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["page"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    assert run([1, 2, 3]) == [1, 2, 3]
    assert run([4, 5, 6, 7, 8]) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_stream_owes_what_the_batch_owes(spark, tmp_path):
    """The first action of each key by the stream is the one that the batch fold owes at the stream's time."""
    from pyspark.sql import functions as F

    from goldweave.operators import sequence
    from goldweave.streaming.sequence import due_stream

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for key in range(60):
        opted, mail = rng.random() < 0.2, rng.random() < 0.5
        for kind in rng.sample(["invite", "accepted", "email", "halted", "other"], rng.randrange(1, 4)):
            rows.append((key, kind, start + timedelta(hours=rng.randrange(96)), opted, mail))
    schema = "key long, kind string, at timestamp, opted_out boolean, usable_email boolean"
    src, out = tmp_path / "in", tmp_path / "out"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"file://{src}")
    stream = due_stream(spark.readStream.schema(schema).parquet(f"file://{src}"))
    query = stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {}
    for r in spark.read.parquet(f"file://{out}").orderBy("at").collect():
        got.setdefault(r["key"], r["action"])
    # What falls due later is owed when the watermark, a day behind the newest event, passes it.
    times = df.groupBy("key").agg(F.max("at").alias("now"), F.first("opted_out").alias("o"), F.first("usable_email").alias("u"))
    mark = F.lit(max(r[2] for r in rows) - timedelta(days=1))
    owed = F.coalesce(*(sequence.due_action(now, F.col("o"), F.col("u")) for now in (F.col("now"), mark)))
    first = sequence.first_per_kind(df, "key", "kind", "at").join(times, "key").select("key", owed.alias("action"))
    want = {r["key"]: r["action"] for r in first.collect()}
    assert got == {k: v for k, v in want.items() if v} and {"halted", "invite", "email"} <= set(got.values())


def test_stream_stalls_without_an_address():
    from goldweave.operators.sequence import KINDS
    from goldweave.streaming.sequence import decide

    first = dict.fromkeys(KINDS) | {"invite": 10.0}
    assert decide(first, 9e5, 10, 100, False, False) == "stalled" and decide(first, 9e5, 10, 100, False, True) == "fallback_email"
    assert decide(first, 9e5, 10, 100, True, True) == "halted" and decide(first | {"halted": 1.0}, 9e5, 10, 100, True, True) is None


def test_registrable_domains(spark):
    from pyspark.sql import functions as F

    from goldweave.functions import urls

    want = {
        "www.example.com": "example.com", "a.b.co.uk": "b.co.uk", "co.uk": None, "com": None, "x.github.io": "x.github.io", "github.io": None, "b.c.kawasaki.jp": "b.c.kawasaki.jp", "c.kawasaki.jp": None,
        "a.city.kawasaki.jp": "city.kawasaki.jp", "www.ck": "www.ck", "a.www.ck": "www.ck", "x.ck": None, "a.x.ck": "a.x.ck", "10.0.0.1": None, "a..b": None, "xn--bcher-kva.example": "bücher.example",
        "www.xn--fiqs8s": "www.中国", "xn--a-.com": "a.com", "XN--MGBH0FB.xn--kgbechtv": "مثال.إختبار",
    }

    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r["name"]: r["d"] for r in df.select("name", urls.registrable_domain(F.col("name")).alias("d")).collect()} == want
    own = urls.Suffixes.parse("// a list\n*.host.test\n!www.host.test\nmine.test // private\n")
    got = {r["name"]: r["d"] for r in spark.createDataFrame([("a.b.host.test",), ("q.www.host.test",), ("x.y.mine.test",)], "name string").select("name", urls.registrable_domain(F.col("name"), own).alias("d")).collect()}
    assert got == {"a.b.host.test": "a.b.host.test", "q.www.host.test": "www.host.test", "x.y.mine.test": "y.mine.test"}


def test_punycode_labels_against_the_codec(spark):
    from pyspark.sql import functions as F

    from goldweave.functions import urls

    rng = random.Random(12)
    words = ["".join(rng.choice("abcxyz09éüß中文字дом😀") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    labels = ["xn--" + w.encode("punycode").decode() for w in words if not w.isascii()]
    got = [r["d"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i long, x string").orderBy("i").select(urls.decode_label(F.col("x")).alias("d")).collect()]
    assert got == [w for w in words if not w.isascii()]


def test_a_merge_is_stored_whole(spark, tmp_path):
    """Mapping, identities, succession, canonical values, provenance and index of one merge agree with each other."""
    from goldweave import storage
    from goldweave.operators import assembly

    day = datetime(2024, 1, 1)
    c = spark.createDataFrame([(i, day + timedelta(days=i)) for i in range(1, 7)], "id long, fetched_at timestamp")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)], "id long, cluster long")
    keys = spark.createDataFrame([(1, 1, "a", False), (2, 1, "a", False), (3, 2, "b", True), (5, 2, "c", False)], "id long, kind int, value string, barred boolean")
    prior = spark.createDataFrame([(1, 10, 1), (3, 10, 1), (4, 11, 2), (5, 12, 3)], "key long, lead long, seniority long")
    won = spark.createDataFrame([(1, "name", "s1", "Ann"), (5, "name", "s2", "Bob")], "cluster long, path string, source string, value string")
    root = f"file://{tmp_path}/leads"
    assert assembly.persist_merge(assembly.merge_tables(c, labels, keys, prior, won), root) == 1
    read = lambda name: sorted(map(tuple, storage.read_committed(spark, root, name).collect()), key=str)
    # Lead 10 held rows of two clusters and retires; 11 and 12 go on; clusters 1 and 6 get new leads behind 12.
    assert dict(read("mapping")) == {1: 14, 2: 14, 3: 11, 4: 11, 5: 12, 6: 19}
    assert read("succession") == [(10, 11), (10, 14)]
    assert {r[0]: r[1] for r in read("identities")} == {14: 2, 11: 2, 12: 1, 19: 1}
    assert read("canonical") == [(12, "name", "Bob"), (14, "name", "Ann")] and read("provenance") == [(12, "name", "s2"), (14, "name", "s1")]
    assert read("index") == [(12, 2, "c"), (14, 1, "a")]


def test_tables_of_a_merge_share_what_is_stored(spark):
    """Leads are assigned once, not for each table."""
    from goldweave.operators import assembly

    c = spark.createDataFrame([(1, 5), (2, 6)], "id long, fetched_at long")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long")
    keys = spark.createDataFrame([(1, 1, "a", False)], "id long, kind int, value string, barred boolean")
    prior = spark.createDataFrame([(2, 9, 9)], "key long, lead long, seniority long")
    won = spark.createDataFrame([(1, "name", "s", "n")], "cluster long, path string, source string, value string")
    made = assembly.merge_tables(c, labels, keys, prior, won)
    for name, rows in {"mapping": [(1, 9), (2, 9)], "canonical": [(9, "name", "n")], "provenance": [(9, "name", "s")]}.items():
        assert sorted(map(tuple, made[name].collect())) == rows
        assert not any(word in made[name]._jdf.queryExecution().optimizedPlan().toString() for word in ("Join", "Aggregate"))
