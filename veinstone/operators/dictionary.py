"""Maintenance of the include and exclude dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.sources.sinks import delete, exists, listed


def parse_review(lines: DataFrame) -> DataFrame:
    """``key_word, related, action`` of lines ``K:V:ACTION``; what isn't INCLUDE is EXCLUDE, shorter lines are dropped."""
    p = F.split("line", ":")
    rows = lines.select(p.alias("p")).filter(F.size("p") >= 3)
    word = lambda i: F.upper(F.trim(F.get("p", F.lit(i))))
    return rows.select(word(0).alias("key_word"), word(1).alias("related"), F.when(word(2) == "INCLUDE", "INCLUDE").otherwise("EXCLUDE").alias("action"))


def merge(current: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Union of both as a row for each keyword and action, its related words sorted and joined by commas."""
    return current.unionByName(reviewed).groupBy("key_word", "action").agg(F.array_join(F.array_sort(F.collect_set("related")), ",").alias("related"))


def review(entries: DataFrame) -> DataFrame:
    """One row for each pair: an exclusion of an included pair is dropped."""
    first = W.partitionBy("key_word", "related").orderBy(F.when(F.col("action") == "INCLUDE", 0).otherwise(1))
    return entries.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def listing(entries: DataFrame) -> DataFrame:
    """Entries to review, numbered by keyword, related word and action. A review is as long as a person can read."""
    return entries.distinct().withColumn("line", F.row_number().over(W.orderBy("key_word", "related", "action")))


def apply_files(spark: SparkSession, current: str, inbox: str) -> int:
    """Merges the review lines of the files in ``inbox`` into the dictionary at ``current``, deletes the files and gives their number.

    The dictionary keeps its versions: ``current`` holds a folder for each, the last one counts, and one without
    ``_SUCCESS`` never does. Files go only after the version is written, and what comes in meanwhile stays.
    """
    if not exists(spark, inbox) or not (files := [f for f in listed(spark, inbox) if not f.rsplit("/", 1)[-1].startswith(("_", "."))]):
        return 0
    reviewed = parse_review(spark.read.text(files).select(F.col("value").alias("line")))
    merged = read(spark, current).unionByName(reviewed).distinct()
    merged.write.parquet(f"{current}/version={_last(spark, current) + 1:09d}")
    for f in files:
        delete(spark, f)
    return len(files)


def _last(spark: SparkSession, current: str) -> int:
    versions = [f for f in listed(spark, current) if exists(spark, f"{f}/_SUCCESS")] if exists(spark, current) else []
    return max((int(f.rsplit("=", 1)[1]) for f in versions), default=0)


def read(spark: SparkSession, current: str) -> DataFrame:
    """The entries ``key_word, related, action`` of the last version at ``current``; none if there is none."""
    schema, last = "key_word string, related string, action string", _last(spark, current)
    return spark.read.schema(schema).parquet(f"{current}/version={last:09d}") if last else spark.createDataFrame([], schema)
