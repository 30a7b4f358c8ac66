"""Scores of things that stand near each other in a document.

For the distances d of all pairs of places within ``RADIUS``, factor1 is their number, factor2 the mean of 1/d over
d > 0, and the score factor1 / factor2. Nothing is scored whose places only coincide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADIUS = 25
#: Least normalised score of an exposure-internalization pair that mitigations are sought for, and least score that such a triple needs.
SOURCE_THRESHOLD, RESULT_THRESHOLD = 10, 50


def near(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None, radius: int = RADIUS) -> DataFrame:
    """Pairs of rows of ``left`` and ``right`` (aliases l and r) with equal ``keys`` and ``pos`` at most ``radius`` apart, with ``d``.

    A range join by equality: places fall into blocks as long as the radius, and the left side meets its own and both
    neighbouring blocks. A long document costs in proportion to what is near, not to its square.
    """
    block = F.floor(F.col("pos") / radius)
    l = left.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).alias("l")  # noqa: E741
    r = right.withColumn("block", block).alias("r")
    on = F.abs(F.col("l.pos") - F.col("r.pos")) <= radius
    for k in [*keys, "block"]:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    if condition is not None:
        on = on & condition
    return l.join(r, on).withColumn("d", F.abs(F.col("l.pos") - F.col("r.pos")))


def scored(pairs: DataFrame, by: list[Column]) -> DataFrame:
    """``by`` with factor1 (all pairs), factor2 and score. 1/0 is left out of the mean, and where nothing is left there is no row."""
    made = pairs.groupBy(*by).agg(F.count("*").alias("factor1"), F.avg(F.when(F.col("d") > 0, 1 / F.nullif(F.col("d"), F.lit(0)))).alias("factor2"))
    return made.filter("factor2 IS NOT NULL").withColumn("score", F.col("factor1") / F.col("factor2"))


def two_factor(places: DataFrame) -> DataFrame:
    """Insights: pairs of terms of one dictionary in a document; coinciding places don't count here."""
    about = ["document_id", "company_name", "year", "content_type", "sector_id", "dictionary_type", "dictionary_id", "path_id"]
    r = places.select("document_id", "dictionary_type", "dictionary_id", "term_id", "key_word", "pos")
    pairs = near(places, r, ["document_id", "dictionary_type", "dictionary_id"], F.col("l.term_id") < F.col("r.term_id")).filter("d > 0")
    by = [F.col(f"l.{c}").alias(c) for c in about] + [F.col("l.term_id").alias("term_id1"), F.col("r.term_id").alias("term_id2"), F.col("l.key_word").alias("key_word1"), F.col("r.key_word").alias("key_word2")]
    return scored(pairs, by)


def with_document_norm(insights: DataFrame, *more: str) -> DataFrame:
    """``score_normalized``: percent of the highest score of the document (and of ``more``)."""
    return insights.withColumn("score_normalized", F.col("score") * 100 / F.max("score").over(W.partitionBy("document_id", *more)))


def spots(insights: DataFrame, places: DataFrame, terms: list[str]) -> DataFrame:
    """Distinct places of the terms that each insight names in the columns ``terms``, under the insight's ids."""
    ids = insights.select("document_id", *terms)
    named = ids.withColumn("term_id", F.explode(F.array(*terms)))
    return named.join(places.select("document_id", "term_id", "pos"), ["document_id", "term_id"]).select("document_id", *terms, "pos").distinct()


def _named(pairs: DataFrame, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    by = [F.col("l.document_id").alias("document_id")] + [F.col(f"l.{c}").alias(n) for c, n in left.items()] + [F.col(f"r.{c}").alias(n) for c, n in right.items()]
    return scored(pairs, by)


def exposure_internalization(exposures: DataFrame, internals: DataFrame, places: DataFrame) -> DataFrame:
    """All pairs of an exposure and an internalization insight of a document with a normalised score above 0."""
    e = spots(exposures.filter("score_normalized > 0"), places, ["term_id1", "term_id2"])
    i = spots(internals.filter("score_normalized > 0"), places, ["term_id1", "term_id2"])
    return _named(near(e, i, ["document_id"]), {"term_id1": "exp_term_id1", "term_id2": "exp_term_id2"}, {"term_id1": "int_term_id1", "term_id2": "int_term_id2"})


def with_mitigation(insights: DataFrame, places: DataFrame, terms: list[str]) -> DataFrame:
    """Insights (``terms`` name their places) paired with the mitigation terms near them."""
    m = places.filter("dictionary_type = 1002").select("document_id", "term_id", "pos")
    s = spots(insights, places, terms)
    return _named(near(s, m, ["document_id"]), {t: t for t in terms}, {"term_id": "mitigation_term_id"})


def neighbour_factor(places: DataFrame) -> DataFrame:
    """For each place the number of places of its dictionary within the radius, itself included, and the sum of 1/d over the others."""
    own = places.select("document_id", "dictionary_type", "dictionary_id", "term_id", "key_word", "pos")
    pairs = near(own, own, ["document_id", "dictionary_type", "dictionary_id"])
    by = [F.col(f"l.{c}").alias(c) for c in ("document_id", "dictionary_type", "dictionary_id", "key_word", "pos")]
    return pairs.groupBy(*by).agg(F.count("*").alias("neighbours"), F.coalesce(F.sum(1 / F.nullif(F.col("d"), F.lit(0))), F.lit(0.0)).alias("fd_factor"))
