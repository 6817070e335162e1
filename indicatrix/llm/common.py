"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import pathlib
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session that names no folder gets one of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="indicatrix-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(rows: DataFrame) -> DataFrame:
    """Compute ``rows`` once into the shared folder; for small tables and results.

    What follows reads those files, so a lost executor costs a read. Spark removes them with the
    DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


class Scratch:
    """Tables in the shared folder that an operator needs while it runs; they are emptied at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` once and read them from now on."""
        path = f"{shared_folder(self.spark).rstrip('/')}/indicatrix-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def hand_over(self) -> None:
        """Leave the last table to the caller."""
        self.paths.pop()

    def __exit__(self, *error) -> None:
        for path in self.paths:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def whole(text: str = "text"):
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def identified(docs: DataFrame, digest, doc_id: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns that tell rows apart, and their names, which are none of theirs.

    They are the ``doc_id``, whether it is null, and a ``digest`` of the row. None is null, so they serve
    a plain equi-join, and rows equal in all three meet in one place.
    """
    names = ["indicatrix_id", "indicatrix_none", "indicatrix_digest"]
    while set(names) & set(docs.columns):
        names = [name + "_" for name in names]
    values = [F.coalesce(F.col(doc_id), F.lit(0)).cast("long"), F.col(doc_id).isNull(), digest]
    return docs.withColumns(dict(zip(names, values))), names


FILTER_BITS = 1 << 23  # of a filter that goes to every task: 1 MiB, whatever it stands for


def bit_filter(places: DataFrame) -> bytes:
    """A bit set for each ``place`` from 0 to ``FILTER_BITS`` - 1. At most ``FILTER_BITS / 64`` rows reach the driver."""
    bits = places.selectExpr("place DIV 64 AS word", "shiftleft(1L, CAST(place % 64 AS INT)) AS bit")
    rows = bits.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in rows.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.tobytes()


def bits_at(kept: bytes, places: np.ndarray) -> np.ndarray:
    """Which places of a filter are set."""
    words = np.frombuffer(kept, np.int64)
    return ((words[places >> 6] >> (places & 63)) & 1) == 1


def release() -> None:
    """Give freed memory back at the end of a task: an idle worker, or one that goes on with another stage, holds what it uses alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others need none
    if trim is not None:
        trim(0)


_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of the rows that go to a Python worker together; Spark's own limit is a number of rows


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to its executors, once for each application, and texts to Python in small batches.

    A session that names the bytes of a batch keeps them.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if context.applicationId not in _SHIPPED:
        package = pathlib.Path(__file__).parents[1]
        folder = tempfile.TemporaryDirectory(prefix="indicatrix-package-")
        atexit.register(folder.cleanup)  # the driver serves the file until it ends
        archive = f"{folder.name}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
