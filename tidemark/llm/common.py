"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, in texts as bytes and in regular expressions over strings.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Values that more than one in HOT_SHARE rows have, and HOT_LEAST rows at least, are dealt over SALTS tasks.
HOT_SHARE, HOT_LEAST, SALTS = 500, 100, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if (own := getattr(sc, "_tidemark_dir", None)) is None:
        own = sc._tidemark_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return own


def written(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, without its lineage, whole if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    for made in _making:
        made.append(out)
    return out


#: Rows that go to Python at once in ``small_batches``.
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands Python BATCH_ROWS rows at a time at most, however long their texts are; then the session's setting holds again.

    The executor's JVM and the worker hold whole batches, several at once, and their allocators keep the room for the rest of a long run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_making: list[list[DataFrame]] = []


@contextlib.contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that ``written`` makes meanwhile, for ``release`` once their readers are done."""
    made: list[DataFrame] = []
    _making.append(made)
    try:
        yield made
    finally:
        _making.remove(made)


def release(*tables: DataFrame) -> None:
    """Remove ``written`` tables that nothing will read again, and let Spark drop shuffle files that only finished jobs used.

    Spark cleans those up once the driver has collected its garbage, which else may not happen for half an hour.
    """
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)  # one that is gone already is no error
    if tables:
        sc._jvm.System.gc()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null: empty) and ``more`` columns; any others are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def row_of(docs: DataFrame, *without: str) -> Column:
    """All columns of ``docs`` but ``without`` as one struct, whatever they are called."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in without])


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, led by as many underscores as no column of ``tables`` has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, how: str, by: list[str]) -> DataFrame:
    """``rows`` joined with ``keys`` (written; a row for each value of ``on``, whose column ``n`` says how many of ``rows`` have it).

    The keys' side is hashed, not sorted: no value fills it. A value that over one in HOT_SHARE of these rows have (so there are fewer than HOT_SHARE such values, and they are
    broadcast) is dealt over SALTS tasks, by a hash of the columns ``by``, and stands in ``keys`` as often.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    hot = keys.where(F.col(n) > max(HOT_LEAST, total // HOT_SHARE)).select(*on)
    keys = keys.drop(n)
    if hot.isEmpty():
        return rows.join(keys.hint("shuffle_hash"), on, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(SALTS)))
    parts = lambda t: t.join(hot, on, "left").withColumn("_hot", F.coalesce("_hot", F.lit(1)))
    left = parts(rows).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_hot"))).drop("_hot")
    right = parts(keys).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_hot") - 1).cast("long")))).drop("_hot")
    return left.join(right.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, within: list[str], by: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """``df`` with a gapless number from 0 in ``name`` for the rows that share ``within``.

    No task gets all rows of one value: equal rows are first counted (map-side too), rows are dealt by a hash of ``by``
    into ``buckets`` parts of each value, the parts' sizes give each part its first number, and numbers inside a part
    follow ``by``. ``df`` should be cheap to read twice, as a written table is.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    parts = rows.groupBy(*within, "_part").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)], F.col("_part").alias("_p"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(within)] + [F.col("_part") == F.col("_p")]
    inside = Window.partitionBy(*within, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, on).withColumn("_at", F.col("_first") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    step = 10_000  # a count may be large: it is spelled out in two steps
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("long"), F.lit(step))))
    rows = rows.withColumn("_i", F.explode(F.sequence("_block", F.least(F.col("_block") + step - 1, F.col("_n") - 1))))
    return rows.select(*df.columns, (F.col("_at") + F.col("_i")).alias(name))


_remembered: dict[Any, Any] = {}


def remembered(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task under ``key``, made where it has none. One thing at a time: Spark uses its workers again for
    other operators, and those find no room that is taken by what they don't use."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Drop what this process has ``remembered``, and give its free memory back to the system, which allocators else keep."""
    _remembered.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def batches_of(values: Iterable, most: int) -> Iterator[list]:
    """Lists of at most ``most`` values."""
    some: list = []
    for v in values:
        some.append(v)
        if len(some) == most:
            yield some
            some = []
    if some:
        yield some


def in_order(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
