"""Helpers that the corpus operators share: staging tables, words, lambdas that bind a value once, grouped Arrow reading."""

from __future__ import annotations

import atexit
import logging
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by whatever file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; only where it is unset, a temporary one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="veldt-")
    logging.getLogger("veldt").info("spark.checkpoint.dir is unset: tables are staged in %s until the session ends", root)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


#: Bytes that a writer of a staged table holds before it writes them.
ROW_GROUP = 32 << 20
#: Paths made in each open scope, the innermost last.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str, held: bool = False) -> str:
    """A path for a staged table or file; the innermost scope deletes it at its end unless it is `held`."""
    path = f"{staging_root(spark)}/veldt/{label}-{uuid.uuid4().hex}"
    if _scopes and not held:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged inside: for results that are written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Stage:
    """Tables that one operator writes to the shared folder on its way; a lost executor costs at most one step.

    `put` writes and rereads a table, `drop` deletes those that the result doesn't read. What it holds stays beyond scopes if
    `held`."""

    def __init__(self, spark: SparkSession, label: str, held: bool = False):
        self.spark, self.label, self.held, self.paths = spark, label, held, {}

    def put(self, name: str, frame: DataFrame, files: int | None = None) -> DataFrame:
        path = new_path(self.spark, f"{self.label}-{name}", self.held)
        (frame.coalesce(files) if files else frame).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete_path(self.spark, path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once for each row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def fold(text: Column, fn: Callable[[Column], Column]) -> Column:
    return fn(F.coalesce(text, F.lit("")))


def table_bytes(spark: SparkSession, frame: DataFrame) -> int:
    """Catalyst's estimate of a table's size."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, total: float, each: float) -> int:
    """Partitions so that each holds about `each` of `total`, at least as many as a shuffle has."""
    return max(shuffle_parts(spark), math.ceil(total / each))


def utf8(column: pa.Array) -> list[bytes]:
    """A text column's values as UTF-8 bytes, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key from batches sorted by it, one table a key; holds one key's rows at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if (held or i > start) and k != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
            last = k
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
