"""A table that a stream writes exactly once, with a ledger from which readers go on where they stopped.

Under ``path`` stand ``rows/query=q/batch=n`` and, once those are whole, ``ledger/query=q/batch=n`` with one row: how many rows, their
latest time, and the watermark that the batch was held against. A batch that is run again replaces its own rows and its own entry; rows without an
entry are never read. A reader's cursor is the last batch that it has taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "rows long, latest timestamp, watermark timestamp"


def entries(spark: SparkSession, path: str, query: str) -> DataFrame:
    """batch, rows, latest, watermark of a query's whole batches."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"batch long, {ENTRY}")
    return spark.read.schema(f"{ENTRY}, query string, batch long").parquet(f"{path}/ledger").where(F.col("query") == query).drop("query")


def watermark(spark: SparkSession, path: str, query: str, delay: str, before: int | None = None) -> object:
    """The latest time of the batches before ``before`` less ``delay``; None if there are none."""
    held = entries(spark, path, query)
    held = held if before is None else held.where(F.col("batch") < before)
    return held.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"]


def sink(path: str, query: str, time: str = "ts", delay: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps batches under ``path``.

    With a ``delay``, each row has ``late``: whether it is older than the watermark of the batches before (the latest time in them, whatever its key, less the delay).
    Late rows go to a side table, ``late/query=q/batch=n``, and don't move the watermark.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = watermark(spark, path, query, delay, number) if delay else None
        late = F.coalesce(F.col(time) < F.lit(mark).cast("timestamp"), F.lit(False))
        name = f"query={query}/batch={number}"
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/rows/{name}")
        if delay:
            batch.where(late).write.mode("overwrite").parquet(f"{path}/late/{name}")
        whole = spark.read.schema(batch.schema).parquet(f"{path}/rows/{name}").agg(F.count(F.lit(1)).alias("rows"), F.max(time).cast("timestamp").alias("latest"))
        whole.withColumn("watermark", F.lit(mark).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/ledger/{name}")

    return keep


def taken(spark: SparkSession, path: str, query: str, schema: str, after: int = -1, side: str = "rows") -> tuple[DataFrame, int]:
    """The rows (with ``batch``) of all whole batches after the cursor ``after``, and the new cursor."""
    last = entries(spark, path, query).agg(F.max("batch").alias("b")).first()["b"]
    last = after if last is None else max(after, last)
    whole = entries(spark, path, query).where((F.col("batch") > after) & (F.col("batch") <= last)).select("batch")
    if last == after:
        return spark.createDataFrame([], f"{schema}, batch long"), after
    rows = spark.read.schema(f"{schema}, query string, batch long").parquet(f"{path}/{side}")
    return rows.where((F.col("query") == query) & (F.col("batch") > after) & (F.col("batch") <= last)).drop("query").join(whole, "batch", "left_semi"), last
