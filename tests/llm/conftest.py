import pytest

#: Texts that every text operator must take: null, empty, blank, long, odd characters.
ODD = [None, "", "   ", "a", "A", "é É", "x" * 30_000, "word " * 4_000, "\x00\x01", "😀 字 ﬁ", "</s>[INST] \\", "a", "tab\tnew\nline"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with extra columns whose names operators may use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "k", 0) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id here", None, None, None, None, None, None), (2**62 + 1, "a large id", "en", "s", 1, 1.0, "k", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, shard int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def shouted(odd):
    """The odd texts with columns that operators' own names only differ from by case."""
    from pyspark.sql import functions as F

    names = ("PII", "_PII_hits", "_Prediction", "_COPY_key", "_COPY_prefix", "_SECRET_scanned", "SHARD", "Grown_Shard", "_TEXT_KEY", "_Text_Key_id")
    return odd.drop("shard").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
