"""A run's results as one bundle: all of its tables appear together, or none of them does.

Tables stand under ``path/tables/attempt=a/name``. ``path/runs/run`` is one small file that names the attempt and its tables; it is put in place last,
so a reader finds a run whole or not at all, and a run that is written again is the old one until the new one is whole.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as met


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def results(candles: DataFrame, frames: DataFrame, trades: DataFrame, balances: DataFrame, initial: float = 100.0, fraction: float = 0.01) -> dict[str, DataFrame]:
    """The tables of a run: what was given, a summary record for each instrument, and the months from its first exit to its last."""
    counts = met.counts(trades, "symbol").drop("win_rate")
    summary = counts.join(met.r_summary(trades, "symbol"), "symbol").join(met.streaks(trades, "symbol"), "symbol")
    return {"candles": candles, "frames": frames, "trades": trades, "equity": balances, "summary": summary, "monthly": met.monthly(trades, initial, fraction)}


def monthly_pivot(monthly: DataFrame, months: list[str] | None = None) -> DataFrame:
    """A row for each symbol and year, a column of pnl for each month (01 to 12)."""
    rows = monthly.select("symbol", F.year("month").alias("year"), F.date_format("month", "MM").alias("m"), "pnl")
    return rows.groupBy("symbol", "year").pivot("m", months or [f"{m:02d}" for m in range(1, 13)]).agg(F.sum("pnl"))


def write(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """Writes ``tables`` as the bundle ``run`` (letters, digits, ``.``, ``_`` and ``-``), in the place of one of that name."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"{run!r} can't name a run")
    attempt, spark = uuid.uuid4().hex, None
    for name, table in tables.items():
        spark = table.sparkSession
        table.write.parquet(f"{path}/tables/attempt={attempt}/{name}")
    fs, waiting = _fs(spark, f"{path}/runs/_{attempt}")
    out = fs.create(waiting, False)
    out.write(bytearray(json.dumps({"attempt": attempt, "tables": {n: t.schema.json() for n, t in tables.items()}}).encode()))
    out.close()
    _, at = _fs(spark, f"{path}/runs/{run}")
    if fs.exists(at):
        fs.delete(at, False)  # between the two steps the run is not there, never half there
    if not fs.rename(waiting, at):
        raise RuntimeError(f"run {run} was written by another at the same time")


def runs(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, f"{path}/runs")
    return sorted(n for f in fs.listStatus(at) if not (n := f.getPath().getName()).startswith(("_", "."))) if fs.exists(at) else []


def read(spark: SparkSession, path: str, run: str) -> dict[str, DataFrame]:
    """The tables of a bundle; one that is not there fails."""
    from pyspark.sql.types import StructType

    if run not in runs(spark, path):
        raise ValueError(f"no run {run}")
    held = json.loads(spark.read.text(f"{path}/runs/{run}", wholetext=True).first()[0])
    return {n: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{path}/tables/attempt={held['attempt']}/{n}") for n, s in held["tables"].items()}


def vacuum(spark: SparkSession, path: str) -> int:
    """Takes away attempts that no run names (so no writer may be at work); gives how many."""
    used = {json.loads(spark.read.text(f"{path}/runs/{r}", wholetext=True).first()[0])["attempt"] for r in runs(spark, path)}
    fs, at = _fs(spark, f"{path}/tables")
    gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().removeprefix("attempt=") not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
