"""Index files of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_index(lines: DataFrame) -> DataFrame:
    """Filings of a 10-K form from lines of five fields; other lines are left out."""
    p = F.split("line", r"\|")
    rows = lines.select(p.alias("p")).filter(F.size("p") == 5)
    rows = rows.select(
        F.expr("try_cast(p[0] AS bigint)").alias("cik"), F.col("p")[1].alias("name"), F.col("p")[2].alias("form"),
        F.expr("try_cast(replace(p[3], '-', '') AS int)").alias("filing_date"), F.col("p")[4].alias("path"),
    )
    rows = rows.filter(F.col("cik").isNotNull() & F.col("filing_date").isNotNull() & F.col("form").contains("10-K"))
    return rows.withColumn("file_name", F.concat(F.col("cik").cast("string"), F.lit("-"), F.element_at(F.split("path", "/"), -1)))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index files below ``path``; header lines don't have five fields with numbers and go by themselves."""
    return parse_index(spark.read.text(path).select(F.col("value").alias("line")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each text file: ``path``, ``text`` and ``pages`` (split at form feeds)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("pages", F.split("text", "\f"))


def pages(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``page`` (from 1) and ``text`` of each page of ``texts``: pages end in form feeds."""
    rows = texts.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f", -1)).alias("at", "page_text"))
    return rows.select(*keep, (F.col("at") + 1).alias("page"), F.col("page_text").alias("text"))
