"""Tables that runs write to: a later batch replaces what it names, and files for exchange."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BATCH = "sink_batch"
#: Insight tables: what identifies a row besides the document, and columns without which a row isn't saved.
INSIGHTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "exposure": ("term_id1 int, term_id2 int", ()),
    "internalization": ("term_id1 int, term_id2 int", ()),
    "mitigation_exposure": ("term_id1 int, term_id2 int, mitigation_term_id int", ()),
    "mitigation_internalization": ("term_id1 int, term_id2 int, mitigation_term_id int", ()),
    "exposure_internalization": ("document_name string, exp_term_id1 int, exp_term_id2 int, int_term_id1 int, int_term_id2 int", ("document_id", "document_name")),
    "mitigation_exposure_internalization": ("exp_term_id1 int, exp_term_id2 int, int_term_id1 int, int_term_id2 int, mitigation_term_id int", ()),
}
SCORES = "factor1 long, factor2 double, score double, score_normalized double"
HITS = "document_id long, dictionary_type int, dictionary_id int, key_word string, frequency long, locations array<int>"
_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: below ``spark.checkpoint.dir``; in local mode a temporary one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="veinstone-")
    path = f"{base.rstrip('/')}/veinstone-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            delete(spark, path)


def _file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()), file


def delete(spark: SparkSession, path: str) -> None:
    system, file = _file(spark, path)
    system.delete(file, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, file = _file(spark, path)
    return system.exists(file)


def listed(spark: SparkSession, path: str) -> list[str]:
    """What lies in the folder ``path``."""
    system, folder = _file(spark, path)
    return [str(f.getPath()) for f in system.listStatus(folder)]


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read again: computed once for all that use it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versioned:
    """Rows by key (several to a key) in Parquet, a folder for each batch; of a key the last batch that names it counts.

    Replacing or deleting a key writes only the new batch, and nothing of other keys. A batch that is written again
    replaces itself. Its rows come before its keys, so a run that ends in between leaves what was there.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.key_schema = StructType([self.schema[k] for k in keys])

    def _part(self, name: str, schema: StructType) -> DataFrame:
        schema = StructType([*schema.fields, StructField(BATCH, IntegerType())])
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, batch: int, rows: DataFrame, named: DataFrame | None = None) -> None:
        """Replaces the keys ``named`` (those of ``rows`` if not given; keys without rows are emptied) by ``rows``."""
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{BATCH}={batch}")
        if named is None:
            named = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{BATCH}={batch}")
        named = named.select(*(F.col(f.name).cast(f.dataType) for f in self.key_schema)).distinct()
        named.write.mode("overwrite").parquet(f"{self.path}/keys/{BATCH}={batch}")

    def delete(self, batch: int, named: DataFrame) -> None:
        self.write(batch, self.spark.createDataFrame([], self.schema), named)

    def read(self) -> DataFrame:
        last = self._part("keys", self.key_schema).groupBy(*self.keys).agg(F.max(BATCH).alias(BATCH))
        return self._part("rows", self.schema).join(last, [*self.keys, BATCH], "left_semi").select(*self.schema.names)

    def compact(self, batch: int) -> None:
        """Writes what counts as one batch, later than all others, and deletes those."""
        self.write(batch, self.read())
        for name in ("keys", "rows"):
            system, folder = _file(self.spark, f"{self.path}/{name}")
            for status in system.listStatus(folder):
                if status.getPath().getName() != f"{BATCH}={batch}":
                    system.delete(status.getPath(), True)


def hits_table(spark: SparkSession, path: str) -> Versioned:
    """Keyword hits; a run replaces the (document, dictionary type) that it has looked at and leaves all others."""
    return Versioned(spark, path, ["document_id", "dictionary_type"], HITS)


class InsightStore:
    """The insight tables, replaced by document."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = {n: Versioned(spark, f"{path}/{n}", ["document_id"], f"document_id long, {columns}, {SCORES}") for n, (columns, _) in INSIGHTS.items()}

    def save(self, batch: int, name: str, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Saves a run's insights; rows without a required column are left out."""
        needed = INSIGHTS[name][1]
        self.tables[name].write(batch, rows.na.drop("any", subset=list(needed)) if needed else rows, documents)

    def delete_documents(self, batch: int, documents: DataFrame) -> None:
        """Deletes documents' insights from all tables."""
        for table in self.tables.values():
            table.delete(batch, documents)

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: dict[str, str]) -> DataFrame:
    """The columns that ``columns`` names, under its new names. ``schema`` is that of the file: nothing is inferred."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.select(*(F.col(old).alias(new) for old, new in columns.items()))


def read_workbook(spark: SparkSession, path: str, sheets: dict[str, str]) -> dict[str, DataFrame]:
    """Sheets that lie as CSV folders below ``path``, by name with their schema."""
    return {n: spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/{n}") for n, schema in sheets.items()}


def archive(texts: DataFrame, path: str, codec: str = "gzip") -> None:
    """Processed texts as compressed lines of JSON."""
    texts.write.mode("overwrite").option("compression", codec).json(path)


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_headers(headers: DataFrame, path: str) -> None:
    headers.write.mode("overwrite").parquet(path)
