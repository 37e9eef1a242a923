"""Intermediate tables in the folder that the whole cluster shares; commits and leases on it.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor
costs a re-read, never a recomputation of the branch above it.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and Spark runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="goldweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/goldweave-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``materialize`` that nothing lazy reads any more; others are left alone."""
    for df in tables:
        path = df.__dict__.get("_stored_at") if df is not None else None
        if path:
            where, files = _file_system(df.sparkSession, path)
            files.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file unless it is there; of several writers one succeeds where the file system says so."""
    where, files = _file_system(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Names of the numbered files of a folder, oldest first."""
    where, files = _file_system(spark, folder)
    if not files.exists(where):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().endswith(".json"))


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))  # one small file


def commit_tables(tables: dict[str, DataFrame], root: str, tries: int = 20) -> int:
    """Writes several tables as one version: readers see all of them or none.

    The version counts when its entry in ``commits`` exists, which is created once; a
    writer that loses the race writes its entry under the next number.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root}/data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    for _ in range(tries):
        held = _entries(spark, f"{root}/commits")
        version = int(held[-1].split(".")[0]) + 1 if held else 1
        if create_once(spark, f"{root}/commits/{version:012d}.json", json.dumps({"folder": folder, "tables": sorted(tables)})):
            return version
    raise RuntimeError("other writers were always faster")


def read_committed(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of a stated one."""
    held = _entries(spark, f"{root}/commits")
    if not held:
        raise FileNotFoundError(f"{root} holds no version")
    entry = held[-1] if version is None else f"{version:012d}.json"
    return spark.read.parquet(f"{_read(spark, f'{root}/commits/{entry}')['folder']}/{name}")


@dataclass(frozen=True)
class Held:
    """Who holds a lease, and until when (seconds)."""

    holder: str
    expires: float


class Lease:
    """One holder at a time for a name, on the shared folder; every change is a file that one writer can create."""

    def __init__(self, spark: SparkSession, folder: str, name: str, clock=time.time):
        self.spark, self.folder, self.clock = spark, f"{folder}/lease-{name}", clock

    def _last(self) -> tuple[int, dict]:
        held = _entries(self.spark, self.folder)
        return (int(held[-1].split(".")[0]), _read(self.spark, f"{self.folder}/{held[-1]}")) if held else (0, {"holder": None, "expires": 0})

    def _put(self, number: int, holder: str | None, expires: float) -> bool:
        return create_once(self.spark, f"{self.folder}/{number:012d}.json", json.dumps({"holder": holder, "expires": expires}))

    def acquire(self, holder: str, seconds: float) -> Held | None:
        """None when taken; else who has it."""
        number, last = self._last()
        now = self.clock()
        if last["holder"] is None or last["expires"] < now:
            if self._put(number + 1, holder, now + seconds):
                return None
            last = self._last()[1]
        return Held(last["holder"], last["expires"])

    def renew(self, holder: str, seconds: float) -> None:
        number, last = self._last()
        if last["holder"] != holder or not self._put(number + 1, holder, self.clock() + seconds):
            raise RuntimeError(f"{holder} has lost the lease")

    def release(self, holder: str) -> None:
        number, last = self._last()
        if last["holder"] == holder:
            self._put(number + 1, None, 0)
