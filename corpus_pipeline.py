"""A corpus pipeline of five stages, each on all that its predecessor kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import materialize, table
from veinstone.llm.decontamination import decontaminate
from veinstone.llm.jaccard_join import jaccard_join
from veinstone.llm.language_id import identify, train
from veinstone.llm.packing import pack
from veinstone.llm.queries import vocabulary
from veinstone.llm.secret_scan import redact

#: Least share of a text's n-grams that its language must contain.
LEAST_SCORE = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: not ``und``, and a score of at least ``LEAST_SCORE``. Null and letterless texts go."""
    columns = docs.columns
    marked = identify(docs, train(docs), keep=tuple(c for c in columns if c != "doc_id"))
    return marked.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*columns)


def row_key() -> Column:
    """128 bits of id and text: rows with both equal, and no others, share it, whatever is null."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("null"))
    return F.unhex(F.md5(F.concat(part("doc_id"), part("text")).cast("binary")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each group of linked ones, a null id last and of equal ids the least ``row_key``. Rows that share the id and the text stay once."""
    keyed = docs.withColumn("key__", row_key())
    ids = materialize(keyed.groupBy("key__").agg(F.first("doc_id").alias("id"), F.count("*").alias("n")))
    linked = jaccard_join(keyed.select("key__", "text"), id_col="key__").select("key__", "component_id").distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key__"))
    kept = materialize(linked.join(ids, "key__").groupBy("component_id").agg(least.alias("least")).select(F.col("least.key__").alias("kept__")))
    own = keyed.join(kept, F.col("key__") == F.col("kept__"), "left_semi")
    own = own if ids.filter("n > 1").isEmpty() else own.dropDuplicates(["key__"])
    return own.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in whose text a window of a benchmark item occurs. Nothing but the text decides, so its 128-bit hash names it."""
    keyed = docs.withColumn("key__", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = decontaminate(keyed.select("key__", "text"), table(spark, sf_dir, "benchmark"), id_col="key__").filter("contaminated").select(F.col("key__").alias("found__")).distinct()
    return keyed.join(found, F.col("key__") == F.col("found__"), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; ``n_chars`` follows the text. No document goes."""
    made = redact(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; a row for each piece."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: Language identification, components and tokens aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; stages in between are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = materialize(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
