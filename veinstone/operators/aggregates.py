"""Normalised scores, sector statistics and report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTOR_YEAR = ["sector_id", "year"]


def percent_of_most(df: DataFrame, *by: str) -> DataFrame:
    """``score_normalized``: percent of the group's highest score. For aggregates, a few rows to a group."""
    return df.withColumn("score_normalized", F.col("score") * 100 / F.max("score").over(W.partitionBy(*by)))


def percent_of_most_rows(df: DataFrame, *by: str) -> DataFrame:
    """The same for rows of few large groups: their maxima are aggregated before the shuffle and joined back."""
    return df.join(df.groupBy(*by).agg(F.max("score").alias("most")), list(by)).withColumn("score_normalized", F.col("score") * 100 / F.col("most")).drop("most")


def documents_of_sectors(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*SECTOR_YEAR).agg(F.count("*").alias("n_documents"))


def sector_stats(insights: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """Per sector, year and ``by``: ``cluster_count_all`` insights, those per document of the sector in the year (whole number),
    the mean score and its percentage of the sector year's highest mean."""
    stats = insights.groupBy(*SECTOR_YEAR, *by).agg(F.count("*").alias("cluster_count_all"), F.avg("score").alias("score"))
    stats = stats.join(documents_of_sectors(docs), SECTOR_YEAR).withColumn("cluster_count", F.expr("cast(cluster_count_all div n_documents as bigint)")).drop("n_documents")
    return percent_of_most(stats, *SECTOR_YEAR)


REPORT = ["sector_id", "company_name", "year", "document_id", "content_type", "esg_category_name", "exposure_path_id", "exposure_path_name"]


def report_exposure(insights: DataFrame) -> DataFrame:
    """Per sector, company, year, document and pathway: insights, mean score and its percentage of the document's highest."""
    return percent_of_most(insights.groupBy(*REPORT).agg(F.count("*").alias("cluster_count"), F.avg("score").alias("score")), "document_id")


def report_exposure_all(insights: DataFrame, types: DataFrame) -> DataFrame:
    """The report of all sectors and years: insights and their mean normalised score, with the kind of document."""
    rows = insights.groupBy(*REPORT).agg(F.count("*").alias("cluster_count"), F.avg("score_normalized").alias("score_normalized"))
    return rows.join(F.broadcast(types), "content_type")


def unique_keywords(insights: DataFrame) -> DataFrame:
    """The distinct terms of a document's insights on a pathway, sorted and joined by commas."""
    both = insights.select("document_id", "path_id", F.col("key_word1").alias("key_word")).union(insights.select("document_id", "path_id", "key_word2")).distinct()
    return both.groupBy("document_id", "path_id").agg(F.array_join(F.array_sort(F.collect_set("key_word")), ",").alias("unique_key_words"))


def averages(insights: DataFrame, by: list[str], year: int = 0, content_type: int = 0) -> DataFrame:
    """Insights and mean normalised score of groups; year or content type 0 takes all."""
    if year:
        insights = insights.filter(F.col("year") == year)
    if content_type:
        insights = insights.filter(F.col("content_type") == content_type)
    return insights.groupBy(*by).agg(F.count("*").alias("pathways"), F.avg("score_normalized").alias("score"))
