"""Source declarations, catalogues, synthetic tables, robots rules, commits, leases, redaction, sinks, ports."""

import json
import random
import re
import types
import urllib.robotparser
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from goldweave import ports, storage
from goldweave.functions import text as text_functions
from goldweave.functions import values
from goldweave.operators import enrich, sinks
from goldweave.sources import catalog, contract, robots, synthetic


class Good(contract.Source):
    name, capabilities = "good", frozenset({"people"})
    surfaces = {"target.astra": frozenset({"uid"})}
    vocabulary = {"astra": ("astra",), "none": ()}
    endpoints = {"find": contract.Endpoint("GET", "/v1/people"), "match": contract.Endpoint("POST", "/v1/match", reads_only=True)}

    def fetch_raw(self, spark, asks):
        return asks

    def normalize(self, raw):
        return raw


def test_declarations_are_checked(spark):
    assert [tuple(r)[:3] for r in contract.declarations(spark, [Good()]).collect()] == [("good", "target.astra", "uid")]
    wrong = {
        "a name is missing": {"name": " "}, "capabilities are not a frozenset": {"capabilities": {"x"}}, "cost class or charge unit is unknown": {"cost_class": "cheap"},
        "a free source charges nothing": {"charge_unit": "credit"}, "target.astra has no surface": {"surfaces": {"target.astra": "uid"}}, "lacks a surface or a vocabulary": {"vocabulary": {"other": ("x",)}},
        "endpoint out can send": {"endpoints": {"out": contract.Endpoint("POST", "/v1/match")}}, "endpoint mail can send": {"endpoints": {"mail": contract.Endpoint("GET", "/v1/messages/send")}}, "a bucket holds nothing": {"rates": (contract.Bucket(0, 1.0),)},
    }
    for said, change in wrong.items():
        with pytest.raises(TypeError, match=said):
            type("Bad", (Good,), change)()


def test_discovery(tmp_path, monkeypatch):
    body = "from goldweave.sources.contract import Source\nclass {n}(Source):\n    name = '{s}'\n    def fetch_raw(self, spark, asks): return asks\n    def normalize(self, raw): return raw\n"
    (tmp_path / "found_sources").mkdir()
    (tmp_path / "found_sources" / "__init__.py").write_text("")
    (tmp_path / "found_sources" / "one.py").write_text(body.format(n="One", s="one"))
    (tmp_path / "found_sources" / "two.py").write_text(body.format(n="Two", s="two"))
    monkeypatch.syspath_prepend(str(tmp_path))
    import found_sources

    found = contract.discover(found_sources)
    assert [s.name for s in contract.choose(found, ["one", "two"], {"two": 5})] == ["two", "one"]
    with pytest.raises(ValueError, match="no such source: three"):
        contract.choose(found, ["three"], {})
    (tmp_path / "found_sources" / "three.py").write_text(body.format(n="Three", s="one"))
    with pytest.raises(ValueError, match="two sources are called one"):
        contract.discover(types.SimpleNamespace(__path__=[str(tmp_path / "found_sources")], __name__="found_sources"))


def test_catalog_folder(tmp_path):
    found = catalog.load_catalog(catalog.EXAMPLE_CATALOG)
    assert found.drafts == ("next",) and {p.key for p in found.products} == {"astra", "cassandra", "mongo"} and found.roles["core"] == ("data engineer",)
    assert found.workers_plan("acme") == {"domains": ["acme.example"], "labels": []} and found.users_plan("acme", "astra")["labels"] == ["uses:astra"]
    with pytest.raises(KeyError):
        found.users_plan("acme", "mongo")
    with pytest.raises(ValueError, match="mongo"):
        catalog.load_catalog(catalog.EXAMPLE_CATALOG, {"astra_db", "apache_cassandra"})
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text('{"vendor": {"key": "same"}, "products": []}')
    with pytest.raises(ValueError, match="two files"):
        catalog.load_catalog(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        catalog.load_catalog(str(tmp_path / "nowhere"))


def test_catalog_in_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "v.yaml").write_text("vendor: {key: v, domain: v.example}\nproducts:\n  - {key: p, name: Pi, aliases: [Pie, Pi]}\n")
    assert catalog.load_catalog(str(tmp_path)).products[0].aliases == ("Pi", "Pie")


def test_synthetic_tables_agree_with_their_key(spark):
    named = synthetic.tables(spark, 12, 5, 3)
    key = {r["id"]: r for r in named["answer_key"].collect()}
    people = {r["id"]: r for r in named["people"].collect()}
    assert len(key) == len(people) == 60 and all(key[i]["email"] == people[i]["email"] for i in key)
    uses = {r["company"]: r["uses"] for r in synthetic.companies(spark, 12, 3).collect()}
    for r in named["web"].collect():
        company = int(r["domain"][1:].split(".")[0])
        assert ("in production" in r["snippet"]) == (uses[company] == "uses_now")
    asks = spark.createDataFrame([(1, "people.match", "id:7"), (2, "people.match", "id:999"), (3, "mail.send", "x")], "ask long, endpoint string, key string")
    rows = [tuple(r) for r in synthetic.routed(asks, synthetic.index(named), faults=True).orderBy("ask", "attempt").collect()]
    assert rows == [(1, 1, 429, None), (1, 2, 200, "p7"), (2, 1, 200, None), (3, 1, 404, None)]
    assert synthetic.routed(asks, synthetic.index(named)).count() == 3


def test_robots_against_the_standard_parser(spark):
    rng = random.Random(6)
    files, pages = [], []
    for i in range(60):
        lines = []
        for agent in rng.sample(["*", "goldweave", "other", "GoldWeave/2"], rng.randrange(0, 4)):
            lines.append(f"User-agent: {agent}")
            lines += [f"{rng.choice(['Allow', 'Disallow', 'disallow'])}: {rng.choice(['/', '/a', '/a/b', '/c', ''])}  # x" for _ in range(rng.randrange(1, 4))]
            lines.append("")
        files.append((f"https://h{i}.example", rng.choice([200, 200, 200, 200, 404, 403, 500]), "\n".join(lines)))
        pages += [(len(pages) + j, f"https://h{i}.example{p}") for j, p in enumerate(["", "/", "/a", "/a/b/c", "/c?q=1", "/d"])]
    pages.append((10**6, "https://unknown.example/x"))
    got = {r["page"]: r["allowed"] for r in robots.judged(spark.createDataFrame(pages, "page long, url string"), robots.robots_rules(spark.createDataFrame(files, "origin string, status int, body string"), "goldweave/1.0"), "page", "url").collect()}
    known = {o: (s, b) for o, s, b in files}
    for page, url in pages:
        status, body = known.get("/".join(url.split("/")[:3]), (404, ""))
        parser = urllib.robotparser.RobotFileParser()
        if status == 200:
            parser.parse(body.splitlines())
        elif status in (401, 403) or status >= 500:
            parser.disallow_all = True
        else:
            parser.allow_all = True
        assert got[page] == parser.can_fetch("goldweave/1.0", url), (url, body)


def test_pages_end_at_a_short_one(spark):
    rows = [("a", 1, [1, 2]), ("a", 2, [3]), ("a", 3, [9, 9]), ("b", 1, []), ("c", 1, [1, 2]), ("c", 3, [5, 5]), ("d", 1, [1, 2]), ("d", 2, [1, 2]), ("d", 3, [1, 2])]
    df = spark.createDataFrame(rows, "ask string, page int, hits array<int>")
    assert {tuple(r)[:2] for r in enrich.until_short_page(df, "ask", "page", "hits", 2, 2).collect()} == {("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("d", 2)}


def test_versions_are_whole(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        storage.read_committed(spark, root, "leads")
    assert storage.commit_tables({"leads": spark.range(3), "index": spark.range(5)}, root) == 1
    assert storage.commit_tables({"leads": spark.range(4), "index": spark.range(6)}, root) == 2
    assert [storage.read_committed(spark, root, n, v).count() for n in ("leads", "index") for v in (None, 1)] == [4, 3, 6, 5]
    assert not storage.create_once(spark, f"{root}/commits/{1:012d}.json", "x")


def test_a_lease_has_one_holder(spark, tmp_path):
    now = [100.0]
    lease = storage.Lease(spark, f"file://{tmp_path}", "run", clock=lambda: now[0])
    assert lease.acquire("a", 10) is None and lease.acquire("b", 10) == storage.Held("a", 110.0)
    lease.renew("a", 20)
    with pytest.raises(RuntimeError):
        lease.renew("b", 20)
    now[0] = 121.0
    assert lease.acquire("b", 5) is None
    with pytest.raises(RuntimeError):
        lease.renew("a", 20)
    lease.release("a")
    assert lease.acquire("c", 5) == storage.Held("b", 126.0)
    lease.release("b")
    assert lease.acquire("c", 5) is None


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Cluster())


def test_discarded_tables_are_gone(spark):
    df = storage.materialize(spark.range(3), "gone")
    path = df._stored_at
    storage.discard(df, spark.range(2), None)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_redaction(spark):
    secrets = ["s3cret/value", "abcdefghij", "hijklmnop", "pin1", "x", " padded secret "]
    texts = {
        "a s3cret/value b": "a *** b", "s3cret%2Fvalue": "***", "czNjcmV0L3ZhbHVl=": "***=", "abcdefghijklmnop": "***", "pin12 pin1 apin1": "pin12 *** apin1", "x marks": "x marks", "padded secret": "***", "": "",
        "733363726574": "733363726574", "s3cret/values3cret/value": "***",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", text_functions.redact(F.col("t"), secrets).alias("c")).collect()} == texts
    row = F.struct(F.lit("s3cret/value").alias("a"), F.array(F.lit("pin1"), F.lit("y" * 50)).alias("b"))
    assert spark.range(1).select(text_functions.redact_row(row, secrets, 30).alias("c")).first()["c"] == ('{"a":"***","b":["***","' + "y" * 50)[:30] + "..."


def test_workbooks(spark):
    rows = [(1, "=1+1", "a & <b>"), (2, "\x00tab\t", None), (3, "x" * 40_000, "é")]
    df = spark.createDataFrame(rows, "id int, formula string, note string").coalesce(1)
    books = sinks.workbooks(df, 2).collect()
    assert sorted(b["n_rows"] for b in books) == [1, 2]
    cells = []
    for b in books:
        with zipfile.ZipFile(BytesIO(b["content"])) as z:
            sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
            assert {"[Content_Types].xml", "xl/workbook.xml"} <= set(z.namelist())
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        table = [["".join(c.itertext()) for c in r] for r in sheet.iter(f"{ns}row")]
        assert table[0] == ["id", "formula", "note"]
        cells += table[1:]
    assert cells == [["1", "'=1+1", "a & <b>"], ["2", "tab\t", ""], ["3", "x" * 32767, "é"]]


def test_outbox_appends(spark, tmp_path):
    path = f"file://{tmp_path}/outbox"
    for i in range(2):
        sinks.append_outbox(spark.createDataFrame([(i, "hi")], "id int, body string"), path)
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(path).collect()) == [0, 1]


def test_ports(spark):
    class Shouter:
        def classify(self, texts):
            return [None if t is None else t.upper() for t in texts]

    class First:
        def answer(self, question, choices):
            return choices[0] if question != "2" else "elsewhere"

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert sorted(map(tuple, ports.classify_with(df, Shouter(), "id", "text").collect())) == [(1, "A"), (2, None)]
    ties = spark.createDataFrame([(1, ["x", "y"]), (1, ["x", "y"]), (2, ["z"])], "id long, choices array<string>")
    assert [tuple(r) for r in ports.answer_ties(ties, First(), "id", "choices").collect()] == [(1, "x")]


def test_the_clock_is_one_time(spark):
    r = spark.range(2).select((values.database_now(90.5) - values.database_now()).cast("string").alias("d")).distinct().collect()
    assert len(r) == 1 and re.search("01:30.5", r[0]["d"])
