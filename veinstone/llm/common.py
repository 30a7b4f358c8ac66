"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits and letters of ASCII and everything beyond ASCII make a word, after A-Z became a-z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row even if ``body`` names it often or in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: below ``spark.checkpoint.dir``, or in local mode (tests) a temporary one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext.getCheckpointDir()
        if not set_dir:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veinstone-"))
            set_dir = spark.sparkContext.getCheckpointDir()
        base = set_dir
    path = f"{base.rstrip('/')}/veinstone-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    """Deletes what this driver has written to the shared folder: results that are read later depend on it until then."""
    for spark, path in _written:
        with contextlib.suppress(Exception):
            file = spark._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it is computed once, and lost executors don't bring its lineage back."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Copies of a row that one array makes.
COPIES = 1 << 16


def copied(df: DataFrame, n: str, at: str) -> DataFrame:
    """Each row of ``df`` (which is read twice) as often as its column ``n`` says, numbered from 1 in ``at``. Rows with more than
    ``COPIES`` are dealt out to all tasks in blocks of so many."""
    few = df.filter(F.col(n) <= COPIES).withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    last = F.floor((F.col(n) - 1) / COPIES).cast("long")
    blocks = df.filter(F.col(n) > COPIES).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = blocks.withColumn(at, F.explode(F.sequence(F.col(at) * COPIES + 1, F.least((F.col(at) + 1) * COPIES, F.col(n).cast("long")))))
    return few.unionByName(many)


def release() -> None:
    """Gives memory that Arrow and the C library hold back to the system: Python workers outlive their tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Only ``cols`` of ``df``, under their own names, whatever else it carries."""
    return df.select(*(F.col(c) for c in cols))
