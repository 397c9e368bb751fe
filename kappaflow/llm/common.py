"""Shared helpers: scratch tables in shared storage, table readers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.session import drop_path, shared_dir


_OPENED: list[list["Scratch"]] = []


@contextmanager
def released_scratch() -> Iterator[None]:
    """Scratch tables that operators make inside go when the block ends; what
    they returned must be written by then."""
    _OPENED.append([])
    try:
        yield
    finally:
        for scratch in _OPENED.pop():
            drop_path(scratch.spark, scratch.root)


class Scratch:
    """Parquet tables of one operator run, in a fresh folder of shared storage.

    A written table cuts lineage: rows made once by a costly stage are read
    back instead of being made again when an executor is lost."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if _OPENED:
            _OPENED[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_FILTERS = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
_MANY_KEYS = {"spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
              "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864"}


def runtime_filters(spark: SparkSession, many: bool = False):
    """Jobs inside let Spark filter a join's scanned side by a Bloom filter of
    the other side's keys (of Spark's bounded size; 8 MB if ``many``) whatever
    the table's size; by default it does so above 10 GB only.  The filter never
    drops a partner."""
    return settings(spark, {**_FILTERS, **(_MANY_KEYS if many else {})})


def small_batches(spark: SparkSession):
    """Jobs inside hand texts to Python workers in batches of 4 MB or one row."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"})


def forgetting(run: Callable, forget: Callable[[], None]) -> Callable:
    """The task function ``run`` that gives its memory back when a task ends:
    Spark keeps workers for a minute, beside stages that run no Python."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
    return task


def unsized(df: DataFrame) -> DataFrame:
    """``df`` for a join in which Spark must broadcast neither side: it sizes the
    rows of an explode like those before it, and a broadcast passes the driver."""
    return df.hint("merge")


def sized(df: DataFrame) -> DataFrame:
    """``df``, a table as written, for a join whose other side is ``unsized``: it
    is broadcast while Spark's threshold allows, the other side never."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(df) if guess <= most else unsized(df)


def literal_array(values: list[int], kind: str) -> str:
    """SQL of a constant array; the planner folds it to one value."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"
