"""Near-duplicate documents: HyperMinHash sketches are banded, estimates screen the pairs, whole shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, texts, unused, written
from tidemark.llm.links import candidates, linked, only
from tidemark.llm.shingles import HyperMinHash, shingle_set

#: 32 bands of 4 registers: a pair at 0.85 (0.8) is missed once in 10**10 (10**7) times.
SKETCHES = HyperMinHash(registers=128, mantissa=10, rows=4)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, same, bands = batch.column("doc_id"), [], [], []
        for t in batch.column("text").to_pylist():
            s = shingle_set(t)
            n.append(len(s))
            same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(SKETCHES.bands(SKETCHES.sketch(s)) if len(s) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "same", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([SKETCHES.sketch(s).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "elements", "sketch"])


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= ``percent`` * union of their sets of 5-word shingles (lower-cased A-Z); a shorter
    text is one shingle, and null or empty ones have none and link with nothing. ``component_id`` is the least doc_id that
    links reach, its own included; ``kept`` marks that document. Documents of equal sets are one until the end. Rows of one id
    are one document, whose texts link it; a row without an id links with nothing and is kept; other columns are left behind.
    """
    plain = texts(docs)
    rows = written(plain.mapInArrow(_sketched, "doc_id long, n_shingles long, same binary, bands array<long>"), "sketches")
    sets_ = rows.where("same is not null and doc_id is not null")
    first = written(sets_.groupBy("same").agg(F.min("doc_id").alias("rep")), "equal")
    # The bands of an equal set are equal too: distinct rows of a key and a representative.
    bands = sets_.join(first, "same").where("doc_id = rep").select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    buckets = candidates(bands)
    sets = written(only(plain, "doc_id", written(buckets.select("id").distinct(), "ids")).mapInArrow(_sets, "id long, n long, elements binary, sketch binary").dropDuplicates(["id", "elements"]), "sets")
    found = linked(buckets, sets, percent, SKETCHES)
    release(buckets, sets)
    members = sets_.select("doc_id", "same").join(first, "same").select("doc_id", "rep").distinct()
    edges = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = members.groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).where("k > 1").isEmpty()
    if repeated:  # each id has one set: its component is its representative's
        part = members.join(found, members["rep"] == found["id"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    else:
        part = components_of(found, edges)
    out = rows.select("doc_id", "n_shingles").join(part.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components_of(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Components once more, where an id has several texts."""
    from tidemark.llm.links import components

    both = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges)
    return components(both).withColumnRenamed("id", "doc_id")


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document ``near_duplicates`` keeps; rows without an id stay."""
    name = unused("_gone", docs)
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
