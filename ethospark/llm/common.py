"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1024
#: A key is hot from so many rows on, and from this share of all rows.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst re-evaluates an expression that a lambda mentions at every call; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none (local tests), one under the warehouse is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for rows with long texts: Spark's default of 10,000 rows a batch would be too much memory at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Gives the memory that a task's worker has freed back to the system: workers stay and wait, while others work for the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_split(rows: DataFrame, groups: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` on ``key``, without one task for all rows of a hot key.

    ``groups`` has one row a key and in ``count`` the number of its rows; it is read several times and should be a written
    table. Rows of a hot key are dealt to several tasks by their hash, and the key's group goes to each of these. A key is
    hot from a ``HOT_SHARE``-th of all counted rows on, so hot keys are ``HOT_SHARE`` at most and can be broadcast. ``count`` is dropped.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot = groups.where(F.col(count) > bound)
    if hot.isEmpty():
        return rows.join(groups.drop(count), key, how)
    salts, salt = fresh(rows.join(groups, key), "salts", "salt")
    dealt = rows.join(F.broadcast(hot.select(key, F.ceil(F.col(count) / bound).cast("int").alias(salts))), key, "left")
    dealt = dealt.withColumn(salt, F.when(F.col(salts) > 1, F.pmod(F.xxhash64(*rows.columns), F.col(salts)).cast("int")).otherwise(0)).drop(salts)
    each = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(count) > bound, F.ceil(F.col(count) / bound).cast("int") - 1).otherwise(0)))).drop(count)
    return dealt.join(each, [key, salt], how).drop(salt)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as a list; null is empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies; the package is on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_file(path: str) -> bytes:
    with open(os.fspath(path), "rb") as f:
        return f.read()
