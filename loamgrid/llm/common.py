"""Shared plumbing of the training-data operators: reading tables, shared folders, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.session import settle, shared_path, shared_root, ship

#: Word separators of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

__all__ = ["Cache", "SPACES", "drop_settled", "join_small", "read", "settle", "shared_path", "shared_root", "ship", "trim"]

#: A side may be broadcast up to this many rows, counted before the join.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_root(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/" + root.split("://", 1)[-1].strip("/") + "/" in folder.replace("file:", ""):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], salt_by: str, how: str = "left", limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join ``big`` with ``small`` (one row per key, keys without nulls).

    ``small`` is counted first: up to ``limit`` rows it is broadcast; beyond that it is replicated
    ``salts`` times and both sides are dealt by key and salt, so that a key with a third of all rows
    is spread over ``salts`` tasks.
    """
    if small.count() <= limit:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def trim() -> None:
    """Give memory that a task has freed back to the system, for whatever runs beside its worker next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Cache:
    """A bounded dict in two generations: when the new one is full it becomes the old one, and what
    is still asked for moves back, so frequent entries survive floods of rare ones."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit // 2, {}, {}

    def recall(self, key):
        """What the old generation knows of a key that the new one lacks."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def get(self, key):
        found = self.new.get(key)
        return self.recall(key) if found is None else found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value
