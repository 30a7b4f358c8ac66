"""The star schema that the analytics run on, derived from the generated tables, with fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPOSURE, INTERNALIZATION, MITIGATION = 1000, 1001, 1002
#: Dimension rows.
ESG = [(1, "Environment"), (2, "Social"), (3, "Governance")]
IMPACT = [(11, 1, "Climate"), (12, 2, "Labour"), (13, 3, "Board")]
PATHWAYS = [(101, 11, "Emissions"), (102, 12, "Safety")]
INTERNALIZATIONS = [(201, 101, "Carbon Cost")]
MITIGATIONS = [(301, 4, "Policy", "Audit"), (302, 4, "Policy", "Target")]
SECTORS = [(0, "Energy"), (1, "Materials"), (2, "Finance"), (3, "Health")]
#: Dictionaries (type, id, path id, keywords).
DICTIONARIES = [(1000, 1, 101, "THE,THING,THTION,MENTE"), (1000, 2, 102, "NICHT,THBLE,QUE,DER"), (1001, 3, 201, "WITH,THIS,DIE,DES"), (1002, 4, 301, "WAS,UND,BY")]
#: Terms of a dictionary table that hit ids leave room for.
TERMS = 10_000


def documents(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = [
        F.col("doc_id").alias("document_id"), F.col("source").alias("company_name"), (2015 + F.col("doc_id") % 5).cast("int").alias("year"),
        (1 + F.col("doc_id") % 2).cast("int").alias("content_type"), (F.substring("source", 4, 9).cast("int") % 4).cast("int").alias("sector_id"),
    ]
    return d.select(*columns, *(["text"] if text else []))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as a local relation: no Python worker reads it."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)


def pathways(spark: SparkSession) -> DataFrame:
    """Exposure pathways with their impact and ESG categories."""
    esg = frame(spark, ESG, "esg_category_id int, esg_category_name string")
    impact = frame(spark, IMPACT, "impact_category_id int, esg_category_id int, impact_category_name string")
    path = frame(spark, PATHWAYS, "exposure_path_id int, impact_category_id int, exposure_path_name string")
    return path.join(F.broadcast(impact), "impact_category_id").join(F.broadcast(esg), "esg_category_id")


def internalizations(spark: SparkSession) -> DataFrame:
    return frame(spark, INTERNALIZATIONS, "internalization_id int, exposure_path_id int, internalization_name string")


def mitigations(spark: SparkSession) -> DataFrame:
    return frame(spark, MITIGATIONS, "mitigation_id int, dictionary_id int, class_name string, sub_class_name string")


def sectors(spark: SparkSession) -> DataFrame:
    return frame(spark, SECTORS, "sector_id int, sector_name string")


def terms(spark: SparkSession, dictionaries: list[tuple[int, int, int, str]] = DICTIONARIES) -> DataFrame:
    """A row for each keyword: ``dictionary_type, dictionary_id, path_id, key_word`` (trimmed, upper case) and ``term_id``, its place in that order."""
    given = {(t, d, p, k.strip().upper()) for t, d, p, words in dictionaries for k in words.split(",")}
    if len(given) >= TERMS:
        raise ValueError(f"hit ids have room for {TERMS} terms")
    rows = [(*r, i) for i, r in enumerate(sorted(given))]
    return frame(spark, rows, "dictionary_type int, dictionary_id int, path_id int, key_word string, term_id int")
