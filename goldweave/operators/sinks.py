"""Append-only logs and derived tables: idempotent appends, upserts, purges, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.storage import materialize


def new_rows(batch: DataFrame, log: DataFrame, sha: str) -> DataFrame:
    """Rows of ``batch`` whose digest the log does not hold, each digest once."""
    return batch.dropDuplicates([sha]).join(log.select(sha), sha, "left_anti")


def append(batch: DataFrame, path: str, sha: str) -> int:
    """Appends what is new to a log of Parquet files and says how many rows that were.

    A repeated batch appends nothing; files already written are never rewritten.
    """
    spark = batch.sparkSession
    try:
        log = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = batch.limit(0)
    fresh = materialize(new_rows(batch, log, sha), "append")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def to_fields(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value): one row for each column that has a value; null is no row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(key, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def changed(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): inserted, updated or removed; equal rows are left out."""
    pack = lambda d, n: d.select(key, F.struct(*columns).alias(n))
    both = pack(new, "n").join(pack(old, "o"), key, "full_outer")
    what = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "removed").when(~F.col("n").eqNullSafe(F.col("o")), "updated")
    return both.select(key, what.alias("change")).filter("change is not null")


def repoint(mapping: DataFrame, moved: DataFrame, key: str, target: str) -> DataFrame:
    """The derived mapping with new targets in place of old ones, and new keys added."""
    both = mapping.join(moved.select(key, F.col(target).alias("_new")), key, "full_outer")
    return both.select(key, F.coalesce("_new", target).alias(target))


def reindex(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of touched keys replaced by fresh ones."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def last_write(rows: DataFrame, keys: list[str], value: str, seq: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def first_write(rows: DataFrame, keys: list[str], value: str, seq: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, seq).alias(value))


def retention_until(mode: Column, fetched_at: Column, days: int = 30) -> Column:
    """Live rows expire; synthetic ones never do."""
    return F.when(mode == "live", fetched_at + F.make_dt_interval(F.lit(days)))


def purge(raw: DataFrame, until: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and those that have expired."""
    live = F.col(until).isNull() | (F.col(until) > now)
    return raw.filter(live), raw.filter(~live)


def detach(rows: DataFrame, expired: DataFrame, key: str) -> DataFrame:
    """References to expired rows become null."""
    gone = expired.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, codes): rows that break a rule, with all rules that they break."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    return rows.select(key, codes.alias("codes")).filter(F.size("codes") > 0)


def append_outbox(messages: DataFrame, path: str) -> None:
    """Appends one line of JSON a message; lines already written stay."""
    messages.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


#: What a workbook's cell holds at most, and characters that its format forbids.
CELL_CHARS = 32767
FORBIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def cell(text: Column) -> Column:
    """A value as a cell: no formula, no forbidden character, no more than a cell holds."""
    clean = F.regexp_replace(text, FORBIDDEN, "")
    return F.substring(F.when(clean.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), clean)).otherwise(clean), 1, CELL_CHARS)


def _workbook(rows: list[list[str | None]]) -> bytes:
    import io
    import zipfile
    from xml.sax.saxutils import escape

    lines = []
    for i, row in enumerate(rows, 1):
        cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v is not None else "<c/>" for v in row)
        lines.append(f'<row r="{i}">{cells}</row>')
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), head + body)
    return out.getvalue()


def workbooks(rows: DataFrame, rows_per_book: int = 50_000) -> DataFrame:
    """(n_rows, content): rows as workbooks with a heading, one or more a partition, each of bounded size."""
    import pandas as pd

    names = rows.columns

    def run(batches):
        held: list[list[str | None]] = []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                held.append([None if v is None else str(v) for v in row])
                if len(held) == rows_per_book:
                    yield pd.DataFrame({"n_rows": [len(held)], "content": [_workbook([names, *held])]})
                    held = []
        if held:
            yield pd.DataFrame({"n_rows": [len(held)], "content": [_workbook([names, *held])]})

    texts = rows.select(*[cell(F.col(c).cast("string")).alias(c) for c in names])
    return texts.mapInPandas(run, "n_rows long, content binary")
