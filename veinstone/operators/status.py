"""Work lists, counters and changes of documents' processing states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: 0 pending, 1 done, 2 failed; of validations 0 open, 2 words to be reviewed, 1 completed.
PENDING, DONE, FAILED = 0, 1, 2
OPEN, REVIEW, COMPLETED = 0, 2, 1
SMALL_BYTES = 10_000
FLAGS = ("exposure", "internalization", "mitigation")
#: Stages that make keyword hits and those that make insights, and for each of the latter the stages that it needs.
SEARCHES = tuple(f"{f}_search" for f in FLAGS)
INSIGHTS = ("exposure_insights", "internalization_insights", "exp_int_insights", "mit_exp_insights", "mit_int_insights", "mit_exp_int_insights")
NEEDS = {
    "mit_exp_insights": ("exposure_insights", "mitigation_search"),
    "mit_int_insights": ("internalization_insights", "mitigation_search"),
    "exp_int_insights": ("exposure_insights", "internalization_insights"),
    "mit_exp_int_insights": ("exposure_insights", "internalization_insights", "mitigation_search"),
}
#: Kinds of documents.
DOCUMENT_TYPES = [(1, "Sustainability Report"), (2, "10-K")]


def review_flags(docs: DataFrame, least: int = SMALL_BYTES) -> DataFrame:
    """Texts of fewer than ``least`` bytes are flagged for review."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.select("document_id", size.cast("long").alias("n_bytes"), (size < least).cast("int").alias("flagged_for_review"))


def counters(docs: DataFrame) -> DataFrame:
    """Pending and failed documents of each stage, in one pass."""
    counts = [F.count_if(F.col(f"{f}_ind") == s).alias(f"{f}_{n}") for f in FLAGS for n, s in (("pending", PENDING), ("failed", FAILED))]
    return docs.agg(F.count("*").alias("documents"), *counts)


def all_counters(docs: DataFrame) -> DataFrame:
    """Pending documents of all nine stages and failed ones of the searches, in one pass. A search is pending once its validation is completed."""
    pending = {s: (F.col(s) == PENDING) & (F.col(f"{f}_validation") == COMPLETED) for s, f in zip(SEARCHES, FLAGS, strict=True)} | {s: F.col(s) == PENDING for s in INSIGHTS}
    return docs.agg(*(F.count_if(c).alias(f"{s}_pending") for s, c in pending.items()), *(F.count_if(F.col(s) == FAILED).alias(f"{s}_failed") for s in SEARCHES))


def gated(docs: DataFrame) -> DataFrame:
    """``stage, document_id``: what the stages that need others may run on now. One pass, a row for each stage that is open."""
    ready = lambda s, needs: (F.col(s) == PENDING) & _all(F.col(n) == DONE for n in needs)
    open_ = F.array_compact(F.array(*(F.when(ready(s, needs), F.lit(s)) for s, needs in NEEDS.items())))
    return docs.select(F.explode(open_).alias("stage"), "document_id")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def pending(docs: DataFrame, flag: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """Documents that a stage is still to run on (or again, after a failure), whose stages ``needs`` are done."""
    return docs.filter(F.col(f"{flag}_ind").isin(PENDING, FAILED) & _all(F.col(f"{n}_ind") == DONE for n in needs))


def validation_generated(docs: DataFrame, documents: DataFrame, flag: str) -> DataFrame:
    """``docs`` whose validation of ``flag`` waits for a review, if they are among ``documents``."""
    return _set(docs, documents, f"{flag}_validation", REVIEW)


def validation_failed(docs: DataFrame, documents: DataFrame, flag: str) -> DataFrame:
    """``docs`` whose validation of ``flag`` is open again, if they are among ``documents``."""
    return _set(docs, documents, f"{flag}_validation", OPEN)


def _set(docs: DataFrame, documents: DataFrame, column: str, value: int) -> DataFrame:
    hit = documents.select(F.col("document_id").alias("hit__")).distinct()
    rows = docs.join(hit, F.col("document_id") == F.col("hit__"), "left")
    return rows.withColumn(column, F.when(F.col("hit__").isNotNull(), F.lit(value)).otherwise(F.col(column))).drop("hit__")


def validation_completed(docs: DataFrame) -> DataFrame:
    """Completes all validations that are open or reviewed of documents whose search is pending: what a review, or none to do, ends in."""
    done = lambda f: F.when(F.col(f"{f}_validation").isin(OPEN, REVIEW) & (F.col(f"{f}_search") == PENDING), F.lit(COMPLETED)).otherwise(F.col(f"{f}_validation"))
    return docs.withColumns({f"{f}_validation": done(f) for f in FLAGS})


def batch_ids(docs: DataFrame, by: list[str], last: int = 1000) -> DataFrame:
    """Batches (values of ``by``) numbered from ``last`` + 1. The window sees a row for each batch, not for each document."""
    return docs.groupBy(*by).agg(F.count("*").alias("documents")).withColumn("batch_id", (F.row_number().over(W.orderBy(*by)) + last).cast("long"))


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``current`` with its rows of ``new``'s keys replaced."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def load(current: DataFrame, new: DataFrame, stages: tuple[str, ...], batch: int) -> DataFrame:
    """``new`` documents in the place of those with their ids, all stages pending, under a batch number."""
    fresh = new.withColumns({s: F.lit(PENDING) for s in stages} | {"batch_id": F.lit(batch)})
    return upsert(current, fresh, "document_id")


def pending_sources(sources: DataFrame, types: DataFrame) -> DataFrame:
    """Sources that aren't processed yet, with the name that their document will have."""
    rows = sources.filter(F.col("processed_ind") == PENDING).join(F.broadcast(types), "content_type")
    return rows.withColumn("document_name", F.concat(F.concat_ws(" ", "company_name", F.col("year").cast("string"), "document_type"), F.lit(".txt")))


def source_view(sources: DataFrame) -> DataFrame:
    """The columns of a source under the names that it is shown by."""
    return sources.select(F.col("unique_id").alias("id"), "document_name", "source_type", "source_url")


def company_ids(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """``docs`` with ``company_id``, found by name and reporting year; null for companies that aren't known."""
    ids = companies.select(F.col("conformed_name").alias("company_name"), F.col("reporting_year").alias("year"), "company_id")
    return docs.join(ids, ["company_name", "year"], "left")


def unmapped(docs: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """``docs`` whose ``by`` isn't in ``known``: the errors of a look-up, as rows."""
    return docs.join(known.select(by).distinct(), by, "left_anti")
