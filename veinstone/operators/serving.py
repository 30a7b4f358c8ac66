"""Ranked, charted and filtered reads of the aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.sources.sinks import materialize


def top_by(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with ``rank``; ``order`` ends in a tie-breaker."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def top(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of all, ranked: the limit runs before the window, which sees ``most`` rows."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def average_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, average_rank, n``: the mean rank of rows with equal ``value`` within ``by``. Rows are counted first, so the window sees distinct values."""
    n = df.groupBy(by, value).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("average_rank", before + 1 + (F.col("n") - 1) / 2)


def versus(company: DataFrame, sector: DataFrame, names: dict[str, str], what: list[str], most: int = 10) -> DataFrame:
    """``side, rank, name, score``: the highest ``most`` rows of each company in ``names`` (by side) and of the sector, side by side."""
    order = [F.desc("score"), F.col("name")]
    rows = lambda df: df.select(F.concat_ws("/", *what).alias("name"), "score")
    sides = {side: rows(company.filter(F.col("company_name") == n)) for side, n in names.items()} | {"sector": rows(sector)}
    made = [top(df, order, most).select(F.lit(side).alias("side"), "rank", "name", "score") for side, df in sides.items()]
    return reduce(DataFrame.unionAll, made)


def pct_change(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Relative change against the row before in its group; null for the first and after a zero."""
    return df.withColumn("pct_change", F.try_divide(F.col(value), F.lag(value).over(W.partitionBy(*by).orderBy(order))) - 1)


def chart_yoy(insights: DataFrame) -> DataFrame:
    """Mean exposure score by company, sector, year and pathway, with its percentage of the company year's highest."""
    rows = insights.groupBy("company_name", "sector_id", "year", "exposure_path_name").agg(F.avg("score").alias("exposure_score"))
    return rows.withColumn("exposure_score_normalized", F.col("exposure_score") * 100 / F.max("exposure_score").over(W.partitionBy("sector_id", "year", "company_name")))


def chart_top10(exposures: DataFrame, controls: DataFrame) -> DataFrame:
    """Exposure and degree of control of the sector's ten highest pathways, and the company's own, by company and year.

    Exposure is the mean exposure score, the degree of control the mean exposure-mitigation score, each in percent of the
    sector year's highest group mean; company values take the sector's maximum too and may pass 100.
    """

    def both(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sector = df.groupBy("sector_id", "year", "exposure_path_name").agg(F.avg("score").alias("s"))
        sector = sector.withColumn("most", F.max("s").over(W.partitionBy("sector_id", "year")))
        company = df.groupBy("company_name", "sector_id", "year", "exposure_path_name").agg(F.avg("score").alias("c"))
        return sector.select("sector_id", "year", "exposure_path_name", (F.col("s") * 100 / F.col("most")).alias(f"sector_{name}"), F.col("most").alias(f"most_{name}")), company.withColumnRenamed("c", f"c_{name}")

    (se, ce), (sc, cc) = both(exposures, "exposure"), both(controls, "control")
    key = ["sector_id", "year", "exposure_path_name"]
    ranked = se.withColumn("rank", F.row_number().over(W.partitionBy("sector_id", "year").orderBy(F.desc("sector_exposure"), "exposure_path_name"))).filter("rank <= 10")
    rows = ce.join(ranked, key).join(sc, key, "left").join(cc, ["company_name", *key], "left")
    return rows.select(
        "company_name", "year", "sector_id", "exposure_path_name", "rank", "sector_exposure", (F.col("c_exposure") * 100 / F.col("most_exposure")).alias("company_exposure"),
        F.coalesce("sector_control", F.lit(0.0)).alias("sector_control"), F.coalesce(F.col("c_control") * 100 / F.col("most_control"), F.lit(0.0)).alias("company_control"),
    )


def triangulation(ei: DataFrame, em: DataFrame, im: DataFrame) -> DataFrame:
    """For each company, year and pathway the three pair scores, each in percent of the sector year's highest company mean, and
    the sector's, in percent of the sector year's highest pathway mean."""
    key = ["company_name", "sector_id", "year", "exposure_path_name"]

    def one(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sums = materialize(df.groupBy(*key).agg(F.sum("score").alias("sum"), F.count("*").alias("n")))  # both means come from these
        most = W.partitionBy("sector_id", "year")
        company = sums.withColumn("s", F.col("sum") / F.col("n"))
        sector = sums.groupBy(*key[1:]).agg((F.sum("sum") / F.sum("n")).alias("s"))
        return company.select(*key, (F.col("s") * 100 / F.max("s").over(most)).alias(f"company_{name}")), sector.select(*key[1:], (F.col("s") * 100 / F.max("s").over(most)).alias(f"sector_{name}"))

    (c1, s1), (c2, s2), (c3, s3) = one(ei, "ei"), one(em, "em"), one(im, "im")
    return c1.join(c2, key).join(c3, key).join(s1, key[1:]).join(s2, key[1:]).join(s3, key[1:])


def sector_companies(docs: DataFrame, sectors: DataFrame, sector: str) -> DataFrame:
    """The companies that a selector offers once a sector is chosen."""
    return docs.join(F.broadcast(sectors.filter(F.col("sector_name") == sector)), "sector_id").select("company_name").dropDuplicates()


def complete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition and have no null in any column."""
    return df.filter(condition).na.drop("any")


def shown(df: DataFrame, digits: int = 2) -> DataFrame:
    """All doubles rounded half to even, as tables show them."""
    return df.select(*(F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def whole(df: DataFrame) -> DataFrame:
    """All doubles rounded to whole numbers, as charts show them."""
    return df.select(*(F.round(c, 0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def metrics(financials: DataFrame, company: str, year: int) -> DataFrame:
    """A company's financial metrics of a year."""
    return financials.filter((F.col("company_name") == company) & (F.col("reporting_year") == year))
