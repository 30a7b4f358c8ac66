"""What charts ask for: measures of a company and year, rounded as they are drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import serving as V
from veinstone.plans import queries as Q


def _top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rounded(V.chart_top10(Q.exposures(spark, sf_dir), Q.exp_mit_rows(spark, sf_dir)))


def top10(spark: SparkSession, sf_dir: str, year: int, company: str) -> DataFrame:
    """The sector's ten highest pathways with the degrees of control, that of the sector first."""
    rows = _top10(spark, sf_dir).filter((F.col("company_name") == company) & (F.col("year") == year))
    return rows.select("exposure_path_name", "year", "rank", "sector_control", "company_control").orderBy(F.desc("sector_control"))


def triangle(spark: SparkSession, sf_dir: str, year: int, company: str) -> DataFrame:
    """The three pair scores of company and sector as whole numbers, the sector's exposure-internalization first."""
    rows = Q.chart_triangulation(spark, sf_dir).filter((F.col("company_name") == company) & (F.col("year") == year))
    return V.whole(rows.orderBy(F.desc("sector_ei"))).drop("company_name", "sector_id")


def yoy(spark: SparkSession, sf_dir: str, company: str) -> DataFrame:
    """A company's scores by year of its sector's ten highest pathways, as whole numbers."""
    rows = Q.rounded(V.chart_yoy(Q.exposures(spark, sf_dir))).filter(F.col("company_name") == company)
    ten = _top10(spark, sf_dir).select("company_name", "year", "exposure_path_name")
    return V.whole(rows.join(ten, ["company_name", "year", "exposure_path_name"])).select("exposure_path_name", "year", "exposure_score", "exposure_score_normalized")


def exposure_control(spark: SparkSession, sf_dir: str, year: int, company: str) -> DataFrame:
    """Exposure beside the company's degree of control, as whole numbers."""
    here = (F.col("company_name") == company) & (F.col("year") == year)
    control = _top10(spark, sf_dir).filter(here).select("exposure_path_name", "year", F.col("company_control").alias("control"))
    scores = Q.rounded(V.chart_yoy(Q.exposures(spark, sf_dir))).filter(here).select("exposure_path_name", "year", "exposure_score")
    return V.whole(scores.join(control, ["exposure_path_name", "year"]))
