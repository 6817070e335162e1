"""Sessions, table access and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder the cluster names.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="indicatrix-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/indicatrix/{label}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


_MADE: ContextVar[list[str] | None] = ContextVar("folders made in a block", default=None)


def empty(spark: SparkSession, *paths: str) -> None:
    """Remove what is in folders of :func:`scratch` that nothing reads any more."""
    for path in paths:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def emptying(spark: SparkSession) -> Iterator[None]:
    """Folders made within the block are emptied at its end, but for rows that :func:`stored` is told to keep.

    For a job that is done part by part, so that what a part needs on the way is there for one part at a time.
    """
    made: list[str] = []
    mark = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(mark)
        empty(spark, *made)


_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is run within removes its shuffle files when it ends; else they stay until the driver collects.

    For results that are written and then read from there. A session that names the setting keeps it.
    """
    if spark.conf.get(_FREES, None) is not None:
        yield
        return
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREES)


def stored(rows: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Compute ``rows`` once into the shared folder, as compressed columns that stay until the folder is emptied.

    For a result that several passes use, such as the deduplicated indicators
    behind a report: the extraction then runs once, a lost executor costs a
    read, not a recomputation, and each pass reads the columns it needs. It ``stays``
    behind the block of :func:`emptying` that it is made in, if told so.
    """
    path = scratch(rows.sparkSession, label)
    if stays and (made := _MADE.get()) is not None:
        made.remove(path)
    with freeing(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checkpointed(rows: DataFrame, label: str) -> DataFrame:
    """Compute ``rows`` once into the shared folder, as they are; Spark removes the files with the DataFrame where it is told to."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(rows.sparkSession, label))
    with freeing(rows.sparkSession):
        return rows.select("*").checkpoint()
