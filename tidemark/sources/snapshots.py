"""A store of bars in versions: readers keep the version that they began with while another is being written.

``data/run=r`` holds what one replacement wrote; ``manifests/m`` says, for each symbol and timeframe, which run's rows count; ``versions/n``
is one small file that names the manifest of version n. It is made last, and making it fails if it is there, so a version appears
as a whole and no two writers make the same one: the slower one takes the newer manifest and tries the next number.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bars import KEYS, PRICES

_STORED = "ts timestamp, open double, high double, low double, close double, volume double, run string, symbol string, timeframe string"
_MANIFEST = "symbol string, timeframe string, run string"


@dataclass(frozen=True)
class Pending:
    """Rows that are written and count for nothing yet."""

    path: str
    run: str
    keys: DataFrame


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def _manifest(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], _MANIFEST)
    name = spark.read.text(f"{path}/versions/{version:08d}").first()[0]
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{name}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The bars of a version (the newest, if none is named), whatever is committed later."""
    known = versions(spark, path)
    version = version if version is not None else known[-1] if known else None
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not there")
    held = _manifest(spark, path, version)
    if version is None:
        return spark.createDataFrame([], "symbol string, timeframe string, " + _STORED.split(", run")[0])
    rows = spark.read.schema(_STORED).parquet(f"{path}/data")
    return rows.join(held, [*KEYS, "run"], "left_semi").select(*KEYS, "ts", *PRICES)


def prepare(bars: DataFrame, path: str) -> Pending:
    """Writes ``bars``, whose keys they will replace; a key is dealt over tasks by month."""
    run = uuid.uuid4().hex
    at = f"{path}/data/run={run}"
    rows = bars.select(*KEYS, "ts", *PRICES).withColumn("_month", F.date_trunc("month", "ts"))
    rows.repartition(*KEYS, "_month").sortWithinPartitions(*KEYS, "ts").drop("_month").write.partitionBy(*KEYS).parquet(at)
    keys = bars.sparkSession.read.schema(_STORED).parquet(f"{path}/data").where(F.col("run") == run).select(*KEYS, "run").distinct()
    return Pending(path, run, keys)


def commit(pending: Pending, tries: int = 5) -> int:
    """Makes the next version: the newest one's keys, with those of ``pending`` in the place of their own. Gives its number."""
    spark, path = pending.keys.sparkSession, pending.path
    for _ in range(tries):
        last = (versions(spark, path) or [None])[-1]
        name, number = uuid.uuid4().hex, 1 if last is None else last + 1
        kept = _manifest(spark, path, last).join(pending.keys, KEYS, "left_anti")
        kept.unionByName(pending.keys).coalesce(1).write.parquet(f"{path}/manifests/{name}")  # a row for each key
        fs, at = _fs(spark, f"{path}/versions/{number:08d}")
        try:
            out = fs.create(at, False)
        except Exception as e:  # py4j wraps Java's FileAlreadyExistsException
            if "AlreadyExists" not in str(e):
                raise
            continue
        out.write(bytearray(name.encode()))
        out.close()
        return number
    raise RuntimeError(f"{tries} other writers came first")


def replace(bars: DataFrame, path: str) -> int:
    return commit(prepare(bars, path))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Takes away all but the newest ``keep`` versions, and the runs that none of those names (so no writer may be at work); gives how many runs went."""
    known = versions(spark, path)
    for v in known[:-keep]:
        fs, at = _fs(spark, f"{path}/versions/{v:08d}")
        fs.delete(at, False)
    used = {r["run"] for v in known[-keep:] for r in _manifest(spark, path, v).select("run").distinct().collect()}  # at most a run for each commit
    fs, at = _fs(spark, f"{path}/data")
    gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("run=") and f.getPath().getName()[4:] not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
