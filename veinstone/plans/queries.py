"""Queries by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from veinstone.functions import text as T
from veinstone.operators import aggregates as A
from veinstone.operators import dictionary as D
from veinstone.operators import filings as X
from veinstone.operators import keywords as K
from veinstone.operators import mlprep as M
from veinstone.operators import proximity as P
from veinstone.operators import serving as V
from veinstone.operators import status as U
from veinstone.sources import edgar, sinks, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Small inputs of queries without a table.
CONTEXT = [("THE", "THEM", "EXCLUDE"), ("THE", "OTHER", "INCLUDE"), ("WITH", "WITHIN", "INCLUDE"), ("DIE", "DIENST", "INCLUDE"), ("DIE", "DIENST", "EXCLUDE"), ("WAS", "WASH", "INCLUDE"), ("THE", "THEIR", "INCLUDE"), ("THE", "THERE", "EXCLUDE")]
NESTED = [(1000, 1, 101, "THE,THED,THTION,ING"), (1001, 3, 201, "IN,INING"), (1002, 4, 301, "ER,ERE,WAS")]
CASED = [(1000, 1, 101, "IT,I"), (1000, 2, 102, "THE"), (1001, 3, 201, "Is")]
REVIEW = ["the:them:exclude", "the:other:INCLUDE", "THE:OTHER:EXCLUDE", " die : dienst : include ", "bad:line", "was:wash:no:more", "x:y:INCLUDE"]
CURRENT = [("THE", "OTHER", "INCLUDE"), ("THE", "WEATHER", "INCLUDE"), ("WITH", "WITHIN", "EXCLUDE")]
INDEX = ["Description: Master Index", "--------", "1000045|NAME, INC|10-K|2022-01-31|edgar/data/1000045/x-22-1.txt", "1000046|OTHER|8-K|2022-02-01|edgar/data/1000046/y.txt", "CIK|Company|Form 10-K|Date|File", "1000047|THIRD|10-K405|2022-03-01|edgar/data/1000047/z-9.txt", "7|a|b|10-K|2022|x"]
FILINGS = [
    (1, "COMPANY CONFORMED NAME:\t\tACME WIDGET CORP\nSTANDARD INDUSTRIAL CLASSIFICATION:  OIL & GAS [1311]\nSTATE:\tDE\nZIP: 12345\n<DOCUMENT>\nIndex.\nItem 1. Business\nItem 1A. Risks\nItem 7. Talk\n.\nItem 1. We sell\nwidgets.\nItem 1A. Risk &amp; more.\nItem 7. Growth.\n</DOCUMENT>"),
    (2, "COMPANY CONFORMED NAME: BETA\nCOMPANY CONFORMED NAME: BETA HOLDING\nFORM TYPE: 10-K\nACCESSION NUMBER: 9\nNo items here."),
    (3, "IRS NUMBER: 55\nCITY:\t SAN JOSE\n<DOCUMENT><p>a.</p>\nItem 7A. Only\nCITY: BODY\n</DOCUMENT>"),
    (4, "CITY: REAL\n<DOCUMENT>\nx.\nItem 2. a\nItem 2. b.\nItem 2. c.\n</DOCUMENT>"),
    (5, "<DOCUMENT>\nx.\nItem 9B. Other.\nItem 9C. Foreign.\nItem 1. a.\nItem 1. b.\nItem 1. c.\nItem 8. d.\nItem 8. e.\nItem 8. f.\nItem 3. g.\nItem 3. h.\nItem 3. i.\n</DOCUMENT>"),
]
#: Industries by code, and the names of financial metrics.
INDUSTRIES = [(1000, "Oil and Gas"), (1001, "Oil Refining"), (1002, "Banks"), (1003, "Hospitals")]
METRICS = ("assets", "liabilities", "equity", "revenue", "operating_expenses", "operating_income_ebitda", "net_income", "eps", "cash_flow_operations", "cash_flow_investing", "free_cash_flow", "cash_flow_financing", "stock_price_calender_year_end", "pe_ratio", "return_on_asset", "beta_calender_year_end", "sharpe_ratio")
_hits: dict[tuple, DataFrame] = {}
_kept: dict[str, DataFrame] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all terms, kept in memory and on disk while they are used: the texts are read and split once for all queries of a table.

    Only the last table's are kept, until its files change. Lost blocks come back from the texts.
    """
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, changed(spark, f"{sf_dir}/documents.parquet"))
    if key not in _hits:
        forget_places()
        docs = star.documents(spark, sf_dir)
        _hits[key] = K.positions(spread(spark, docs), star.terms(spark)).persist(StorageLevel.MEMORY_AND_DISK)
    return _hits[key]


def changed(spark: SparkSession, path: str) -> int:
    """When the file or folder ``path`` changed last."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getModificationTime()


def forget_places() -> None:
    for kept in (_hits, _kept):
        for old in kept.values():
            old.unpersist()
        kept.clear()


def spread(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A table that lies in few files is dealt out to all cores before its texts are split; one in many files stays where it is."""
    n = spark.sparkContext.defaultParallelism
    return docs.repartition(n) if docs.select(F.input_file_name()).distinct().limit(n).count() < n else docs


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure and internalization insights, normalised by document; kept beside the places that they come from."""
    places(spark, sf_dir)
    if "insights" not in _kept:
        _kept["insights"] = _insights(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _kept["insights"]


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_document_norm(P.two_factor(places(spark, sf_dir).filter("dictionary_type <> 1002")), "dictionary_type")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights(spark, sf_dir).filter("dictionary_type = 1000").withColumn("exposure_path_id", F.col("path_id"))
    return rows.join(F.broadcast(star.pathways(spark)), "exposure_path_id")


def internals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights(spark, sf_dir).filter("dictionary_type = 1001").withColumn("internalization_id", F.col("path_id"))
    return rows.join(F.broadcast(star.internalizations(spark)), "internalization_id").join(F.broadcast(star.pathways(spark)), "exposure_path_id")


def exp_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.exposure_internalization(exposures(spark, sf_dir), internals(spark, sf_dir), places(spark, sf_dir))
    return P.with_document_norm(rows)


def mit_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = exposures(spark, sf_dir).filter("score_normalized > 0")
    return P.with_document_norm(P.with_mitigation(source, places(spark, sf_dir), ["term_id1", "term_id2"]))


def mit_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = internals(spark, sf_dir).filter("score_normalized > 0")
    return P.with_document_norm(P.with_mitigation(source, places(spark, sf_dir), ["term_id1", "term_id2"]))


def mit_exp_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = exp_int(spark, sf_dir).filter(F.col("score_normalized") > P.SOURCE_THRESHOLD)
    rows = P.with_mitigation(source, places(spark, sf_dir), ["exp_term_id1", "exp_term_id2", "int_term_id1", "int_term_id2"])
    return P.with_document_norm(rows.filter(F.col("score") > P.RESULT_THRESHOLD))


def about(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rows.join(star.documents(spark, sf_dir, text=False), "document_id")


def of_path(spark: SparkSession, rows: DataFrame, term: str, path: str) -> DataFrame:
    """``path``: the path id of the term in column ``term``."""
    t = star.terms(spark).select(F.col("term_id").alias(term), F.col("path_id").alias(path))
    return rows.join(F.broadcast(t), term)


def exp_mit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_path(spark, about(spark, sf_dir, mit_exp(spark, sf_dir)), "term_id1", "exposure_path_id").join(F.broadcast(star.pathways(spark)), "exposure_path_id")


def int_mit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_path(spark, about(spark, sf_dir, mit_int(spark, sf_dir)), "term_id1", "internalization_id")
    return rows.join(F.broadcast(star.internalizations(spark)), "internalization_id").join(F.broadcast(star.pathways(spark)), "exposure_path_id")


def exp_int_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_path(spark, of_path(spark, about(spark, sf_dir, exp_int(spark, sf_dir)), "exp_term_id1", "exposure_path_id"), "int_term_id1", "internalization_id")
    names = star.internalizations(spark).select("internalization_id", "internalization_name")
    return rows.join(F.broadcast(star.pathways(spark)), "exposure_path_id").join(F.broadcast(names), "internalization_id")


def exp_int_mit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_path(spark, of_path(spark, about(spark, sf_dir, mit_exp_int(spark, sf_dir)), "exp_term_id1", "exposure_path_id"), "int_term_id1", "internalization_id")
    return rows.join(F.broadcast(star.pathways(spark)), "exposure_path_id").join(F.broadcast(star.internalizations(spark)), ["internalization_id", "exposure_path_id"])


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order: measures are returned with 6 digits."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- keywords


@query
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = K.tokens(spread(spark, star.documents(spark, sf_dir).select("document_id", "text")))
    return t.groupBy("document_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("word") == "").alias("n_empty"), F.countDistinct(F.upper("word")).alias("n_distinct"))


def _hit_rows(df: DataFrame) -> DataFrame:
    return df.select("document_id", "dictionary_type", "dictionary_id", "key_word", "frequency", F.array_join("locations", ",").alias("locations"))


@query
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_rows(K.hits(places(spark, sf_dir)))


@query
def keyword_hits_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hit_rows(K.hits(K.positions(star.documents(spark, sf_dir), star.terms(spark, CASED))))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.related_words(spread(spark, star.documents(spark, sf_dir).select("document_id", "text")), star.terms(spark))
    return K.resolve(found, star.frame(spark, CONTEXT, "key_word string, related string, action string"))


@query
def related_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).groupBy("dictionary_id", "key_word", "status").agg(F.countDistinct("related").alias("n_related"), F.sum(F.size("locations")).alias("n_places"))


@query
def related_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _related(spark, sf_dir).filter("status = 'UNKNOWN'")
    return rows.select(F.concat_ws(":", "key_word", "related", F.lit("INCLUDE")).alias("line")).distinct()


@query
def validation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.failed_documents(_related(spark, sf_dir))


@query
def keyword_hits_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.include(places(spark, sf_dir), _related(spark, sf_dir))
    return rows.groupBy("document_id", "dictionary_type", "dictionary_id", "key_word").agg(F.count("*").alias("frequency"), F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("locations"))


@query
def keyword_hits_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = star.terms(spark, NESTED)
    found = K.hits(K.positions(spread(spark, star.documents(spark, sf_dir).select("document_id", "text")), terms))
    return K.merged(found, terms).select("document_id", "dictionary_id", "key_word", "merged_with", "frequency", F.array_join("locations", ",").alias("locations"))


# ---- insights


@query
def insight_two_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(insights(spark, sf_dir).select("document_id", "dictionary_type", "dictionary_id", "key_word1", "key_word2", "factor1", "factor2", "score", "score_normalized"))


@query
def insight_exp_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exp_int(spark, sf_dir))


@query
def insight_mit_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mit_exp(spark, sf_dir))


@query
def insight_mit_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mit_int(spark, sf_dir))


@query
def insight_mit_exp_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mit_exp_int(spark, sf_dir))


@query
def fd_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.neighbour_factor(places(spark, sf_dir)))


# ---- sectors and reports


@query
def sector_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sector_stats(exposures(spark, sf_dir), star.documents(spark, sf_dir, text=False), ["esg_category_name", "exposure_path_id", "exposure_path_name"]))


@query
def exposure_sector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exposures(spark, sf_dir).select("document_id", "sector_id", "year", "key_word1", "key_word2", "score")
    return rounded(A.percent_of_most_rows(rows, "sector_id", "year"))


@query
def mit_exp_sector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = about(spark, sf_dir, mit_exp(spark, sf_dir)).select("document_id", "sector_id", "year", "term_id1", "term_id2", "mitigation_term_id", "score")
    return rounded(A.percent_of_most_rows(rows, "sector_id", "year"))


@query
def sector_exp_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sector_stats(exp_int_rows(spark, sf_dir), star.documents(spark, sf_dir, text=False), ["esg_category_name", "exposure_path_name", "internalization_name"]))


@query
def sector_exp_mit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = star.mitigations(spark).select(F.col("dictionary_id").alias("mitigation_dictionary"))
    t = star.terms(spark).select(F.col("term_id").alias("mitigation_term_id"), F.col("dictionary_id").alias("mitigation_dictionary"))
    # the mitigation rows of a dictionary multiply its insights, as they always did
    rows = exp_mit_rows(spark, sf_dir).join(F.broadcast(t), "mitigation_term_id").join(F.broadcast(m), "mitigation_dictionary")
    return rounded(A.sector_stats(rows, star.documents(spark, sf_dir, text=False), ["esg_category_name", "exposure_path_id", "exposure_path_name"]))


@query
def sector_exp_int_mit(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["esg_category_name", "exposure_path_id", "exposure_path_name", "internalization_id", "internalization_name"]
    return rounded(A.sector_stats(exp_int_mit_rows(spark, sf_dir), star.documents(spark, sf_dir, text=False), by))


@query
def report_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.report_exposure(exposures(spark, sf_dir)))


@query
def report_unique_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unique_keywords(insights(spark, sf_dir).filter("dictionary_type = 1000"))


@query
def dash_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.averages(exposures(spark, sf_dir), ["company_name", "year", "content_type", "esg_category_name", "exposure_path_name"], content_type=1))


@query
def dash_sector_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exposures(spark, sf_dir).join(F.broadcast(star.sectors(spark)), "sector_id")
    return rounded(A.averages(rows, ["sector_name", "year", "esg_category_name", "exposure_path_name"], year=2016))


@query
def dash_internalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.averages(exp_int_rows(spark, sf_dir), ["company_name", "year", "exposure_path_name", "internalization_name"]))


@query
def dash_mitigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = star.mitigations(spark).select(F.col("dictionary_id").alias("mitigation_dictionary"), "class_name", "sub_class_name")
    t = star.terms(spark).select(F.col("term_id").alias("mitigation_term_id"), F.col("dictionary_id").alias("mitigation_dictionary"))
    rows = exp_mit_rows(spark, sf_dir).join(F.broadcast(t), "mitigation_term_id").join(F.broadcast(m), "mitigation_dictionary")
    return rounded(A.averages(rows, ["company_name", "year", "exposure_path_name", "class_name", "sub_class_name"]))


@query
def sector_vs_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exposures(spark, sf_dir)
    company = A.averages(e, ["company_name", "year", "exposure_path_name"]).select(F.lit("company").alias("kind"), F.col("company_name").alias("name"), "year", "exposure_path_name", "pathways", "score")
    sector = A.averages(e.join(F.broadcast(star.sectors(spark)), "sector_id"), ["sector_name", "year", "exposure_path_name"])
    return rounded(company.unionAll(sector.select(F.lit("sector"), "sector_name", "year", "exposure_path_name", "pathways", "score")))


# ---- charts and ranks


@query
def chart_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.chart_yoy(exposures(spark, sf_dir)))


@query
def chart_yoy_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounded(V.chart_yoy(exposures(spark, sf_dir))).filter("sector_id = 1")
    return V.top_by(rows, ["year"], [F.desc("exposure_score"), F.col("company_name"), F.col("exposure_path_name")], 5)


@query
def chart_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.chart_top10(exposures(spark, sf_dir), exp_mit_rows(spark, sf_dir)))


@query
def chart_exposure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.chart_top10(exposures(spark, sf_dir), exp_mit_rows(spark, sf_dir)).filter("company_control > 0")
    return rows.select("company_name", "year", "exposure_path_name", F.round("company_exposure", 4).alias("company_exposure"), F.round("company_control", 4).alias("company_control"), T.control_colour(F.round("company_control", 4)).alias("colour"))


@query
def chart_yoy_of_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = V.chart_top10(exposures(spark, sf_dir), exp_mit_rows(spark, sf_dir)).select("company_name", "year", "exposure_path_name")
    return rounded(V.chart_yoy(exposures(spark, sf_dir)).join(ten, ["company_name", "year", "exposure_path_name"]).select("company_name", "year", "exposure_path_name", "exposure_score"))


@query
def chart_triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.triangulation(exp_int_rows(spark, sf_dir), exp_mit_rows(spark, sf_dir), int_mit_rows(spark, sf_dir)))


@query
def top10_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounded(A.averages(exposures(spark, sf_dir), ["company_name", "year", "exposure_path_name"]))
    return V.top(rows, [F.desc("score"), F.col("company_name"), F.col("year"), F.col("exposure_path_name")], 10)


@query
def avg_rank_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.average_rank(exposures(spark, sf_dir), "company_name", "exposure_path_name")


@query
def score_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.chart_yoy(exposures(spark, sf_dir)).groupBy("company_name", "exposure_path_name", "year").agg(F.avg("exposure_score").alias("score"))
    return rounded(V.pct_change(rows, ["company_name", "exposure_path_name"], "year", "score"))


# ---- states and lookups


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star.documents(spark, sf_dir, text=False)
    flags = [(F.floor(F.col("document_id") / k) % 3).cast("int").alias(f"{f}_ind") for f, k in zip(U.FLAGS, (1, 3, 9), strict=True)]
    return d.select("document_id", "company_name", "year", "sector_id", *flags)


@query
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.counters(_flagged(spark, sf_dir))


@query
def pending_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pending(_flagged(spark, sf_dir), "mitigation", ("exposure", "internalization")).join(F.broadcast(star.sectors(spark)), "sector_id").select("document_id", "company_name", "year", "sector_name", "mitigation_ind")


@query
def sector_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pending(_flagged(spark, sf_dir), "exposure").groupBy("sector_id", "year").agg(F.count("*").alias("documents"), F.countDistinct("company_name").alias("companies"))


@query
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.batch_ids(star.documents(spark, sf_dir, text=False), ["year", "sector_id"])


@query
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.review_flags(star.documents(spark, sf_dir))


STAGES = (*U.SEARCHES, *U.INSIGHTS)


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with nine stages and three validations, made up from their ids."""
    d = star.documents(spark, sf_dir, text=False)
    state = lambda k: (F.floor(F.col("document_id") / k) % 3).cast("int")
    stages = {s: state(i + 1) for i, s in enumerate(STAGES)} | {f"{f}_validation": state(20 + i) for i, f in enumerate(U.FLAGS)}
    return d.select("document_id", "company_name", "year", "sector_id").withColumns(stages)


@query
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document is loaded again: its stages are pending, its batch is the next one."""
    current = _staged(spark, sf_dir).withColumn("batch_id", F.lit(7)).drop(*(f"{f}_validation" for f in U.FLAGS))
    return U.load(current, current.filter("document_id % 7 = 0").drop("batch_id", *STAGES), STAGES, 8)


@query
def all_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.all_counters(_staged(spark, sf_dir))


@query
def gated_worklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.gated(_staged(spark, sf_dir))


@query
def validation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New words are written for every fourth document, every tenth fails, and then the review ends."""
    docs = _staged(spark, sf_dir)
    waiting = U.validation_generated(docs, docs.filter("document_id % 4 = 0"), "exposure")
    failed = U.validation_failed(waiting, docs.filter("document_id % 10 = 0"), "mitigation")
    done = U.validation_completed(failed)
    before = failed.select("document_id", *(F.col(f"{f}_validation").alias(f"{f}_before") for f in U.FLAGS))
    return before.join(done.select("document_id", *(f"{f}_validation" for f in U.FLAGS)), "document_id")


def _types(spark: SparkSession) -> DataFrame:
    return star.frame(spark, U.DOCUMENT_TYPES, "content_type int, document_type string")


@query
def pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star.documents(spark, sf_dir, text=False)
    kinds = F.get(F.array(F.lit("pdf"), F.lit("webpage"), F.lit("file")), (F.col("document_id") % 3).cast("int"))
    sources = d.withColumns({"unique_id": F.col("document_id"), "processed_ind": (F.col("document_id") % 4).cast("int"), "source_type": kinds, "source_url": F.concat(F.lit("https://example.org/"), F.col("document_id").cast("string"))})
    return U.source_view(U.pending_sources(sources, _types(spark)))


@query
def company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of even years are known, numbered by name and year."""
    d = star.documents(spark, sf_dir, text=False)
    known = d.filter("year % 2 = 0").select(F.col("company_name").alias("conformed_name"), F.col("year").alias("reporting_year"))
    companies = U.batch_ids(known, ["conformed_name", "reporting_year"]).withColumnRenamed("batch_id", "company_id")
    return U.company_ids(d, companies).select("document_id", "company_id")


@query
def unmapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.unmapped(star.documents(spark, sf_dir, text=False), star.sectors(spark).filter("sector_id <> 3"), "sector_id").select("document_id", "sector_id")


@query
def filings_by_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    industries = star.frame(spark, INDUSTRIES, "sic_code int, industry_title string")
    d = star.documents(spark, sf_dir, text=False).withColumns({"sic_code": F.col("sector_id") + 1000, "quarter": (1 + F.col("document_id") % 4).cast("int")})
    rows = d.filter("year = 2016 AND content_type = 2 AND quarter = 2").join(F.broadcast(industries.filter(F.startswith("industry_title", F.lit("Oil")))), "sic_code")
    return rows.select("document_id", "sic_code", "industry_title", "company_name")


@query
def sector_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sector_companies(star.documents(spark, sf_dir, text=False), star.sectors(spark), "Finance")


@query
def first_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entries of the look-up table, by id."""
    rows = star.sectors(spark).select(F.col("sector_id").alias("lookup_id"), F.col("sector_name").alias("description"))
    return rows.union(_types(spark).select(F.col("content_type") + 100, "document_type")).orderBy("lookup_id").limit(5)


@query
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day: the day as a number, and the file name that an export of it has."""
    day = F.date_format("ts", "yyyyMMdd")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(day.alias("day")).agg(F.count("*").alias("events"))
    return rows.select(F.col("day").cast("int").alias("day"), F.concat(F.lit("events_"), F.col("day"), F.lit(".csv")).alias("file_name"), "events")


@query
def lookup_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star.documents(spark, sf_dir, text=False)
    rows = d.join(F.broadcast(star.sectors(spark)), "sector_id")
    lists = [rows.select(F.lit("sector").alias("list"), F.col("sector_name").alias("entry")), rows.select(F.lit("year"), F.col("year").cast("string")), rows.select(F.lit("company"), F.concat_ws("/", "sector_name", "company_name"))]
    kinds = d.select(F.lit("document type"), F.when(F.col("content_type") == 1, "Sustainability Report").otherwise("10-K"))
    return lists[0].union(lists[1]).union(lists[2]).union(kinds).distinct()


@query
def sectors_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by sector; those of a sector without a name are reported as unmapped."""
    d = star.documents(spark, sf_dir, text=False)
    return d.join(F.broadcast(star.sectors(spark).filter("sector_id <> 3")), "sector_id", "left").groupBy(F.coalesce("sector_name", F.lit("unmapped")).alias("sector_name")).agg(F.countDistinct("company_name").alias("companies"), F.countDistinct("year").alias("years"))


# ---- dictionaries, filings, pages


@query
def dictionary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = D.parse_review(star.frame(spark, [(x,) for x in REVIEW], "line string"))
    return D.merge(star.frame(spark, CURRENT, "key_word string, related string, action string"), reviewed)


@query
def dictionary_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.review(D.parse_review(star.frame(spark, [(x,) for x in REVIEW], "line string")))


@query
def edgar_index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgar.parse_index(star.frame(spark, [(x,) for x in INDEX], "line string"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some filings as constants, and one around the text of each document."""
    d = star.documents(spark, sf_dir)
    i = F.col("document_id").cast("string")
    toc = F.lit("\n<DOCUMENT>\nIndex.\nItem 1. Business\nItem 1A. Risks\nItem 9C. Other\n.\nItem 1. ")
    end = F.when(F.col("document_id") % 5 == 0, F.lit(".\nItem 9A. a.\nItem 9A. b.\nItem 9A. c.\nCITY: BODY\n</DOCUMENT>")).otherwise(F.lit(".\n</DOCUMENT>"))
    content = F.concat(F.lit("COMPANY CONFORMED NAME:\t"), "company_name", F.lit("\nCITY: C"), i, toc, F.coalesce("text", F.lit("")), F.lit(".\nITEM 1A. Risk of "), i, end)
    return star.frame(spark, FILINGS, "filing_id long, content string").union(d.select(F.col("document_id") + 1000, content))


@query
def tenk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, written to their table and read back."""
    path = sinks.scratch(spark)
    sinks.write_headers(X.header_fields(_filings(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query
def tenk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(_filings(spark, sf_dir)).select("filing_id", "status", "item", "start", F.md5("section").alias("section_md5"))


@query
def tenk_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.wide(X.sections(_filings(spark, sf_dir)))
    return rows.select("filing_id", *(F.md5(c).alias(c) for c in rows.columns[1:]))


@query
def tenk_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = _filings(spark, sf_dir)
    return X.assembled(X.header_fields(filings), X.sections(filings)).select("filing_id", F.char_length("xml").cast("long").alias("n_chars"), F.md5("xml").alias("xml_md5"))


@query
def tenk_last_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.last_items(_filings(spark, sf_dir))


@query
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.status_counts(X.sections(_filings(spark, sf_dir)))


@query
def dictionary_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review lines in a file, merged into a dictionary that has a version already; the file is gone then."""
    base = sinks.scratch(spark)
    star.frame(spark, CURRENT, "key_word string, related string, action string").write.parquet(f"{base}/dictionary/version={1:09d}")
    star.frame(spark, [(x,) for x in REVIEW], "line string").coalesce(1).write.text(f"{base}/inbox")
    applied = D.apply_files(spark, f"{base}/dictionary", f"{base}/inbox")
    again = D.apply_files(spark, f"{base}/dictionary", f"{base}/inbox")
    return D.read(spark, f"{base}/dictionary").withColumns({"applied": F.lit(applied), "again": F.lit(again)})


@query
def review_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.listing(D.parse_review(star.frame(spark, [(x,) for x in REVIEW], "line string")))


@query
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.html_text(F.col("html"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.alias("text"))
    return rows.select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), F.char_length(T.xml_escape(T.ascii_only(F.col("text")))).cast("long").alias("n_escaped"))


# ---- features


def _change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company, year and pathway with an exposure score and a made-up change that is the same for a company and year."""
    rows = V.chart_yoy(exposures(spark, sf_dir)).groupBy("company_name", "year", "exposure_path_name").agg(F.avg("exposure_score").alias("ei"))
    return rows.withColumn("change", ((F.col("year") % 7) - 3).cast("double") + F.length("company_name"))


@query
def factorize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.factorize(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id")


@query
def stock_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.allocate(_change(spark, sf_dir), ["company_name", "year"], "change", "ei"))


@query
def group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_change(spark, sf_dir).groupBy("company_name").agg(F.sum("change").alias("change"), F.sum("ei").alias("ei")))


@query
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.standardize(_change(spark, sf_dir), "ei"))


@query
def melt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.melt(_change(spark, sf_dir), ["company_name", "year", "exposure_path_name"], ["ei", "change"]))


@query
def pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.melt(_change(spark, sf_dir), ["company_name", "year", "exposure_path_name"], ["ei", "change"]).withColumn("metric", F.concat_ws(" - ", "exposure_path_name", "metric"))
    names = [f"{p} - {m}" for p in ("Emissions", "Safety") for m in ("ei", "change")]
    return rounded(M.pivot(rows, ["company_name", "year"], names, "value"))


@query
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.errors(_change(spark, sf_dir), "ei", "change"))


@query
def telemetry_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type: how many, over how long, and the rate's band. An hour stands for a second, the events are sparse."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("records"), (F.max(ts) - F.min(ts)).alias("seconds"))
    rate = F.try_divide("records", "seconds")
    return rounded(rows.withColumns({"per_second": rate, "ms_per_record": F.try_divide(F.col("seconds") * 1000, F.col("records")), "rating": T.rating(rate)}))


@query
def train_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.linear_fit(_change(spark, sf_dir), "ei", "change", ["company_name", "year", "exposure_path_name"]))


@query
def tune_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and candidates there were, and whether the errors are numbers; what they are depends on the models."""
    rows = _change(spark, sf_dir).withColumn("place", F.crc32("exposure_path_name") % 2)
    made = M.tune_regression(rows, ["ei", "year", "place"], "change", ["company_name", "year", "exposure_path_name"])
    return made.select("model", "n_train", "n_test", "candidates", ((F.col("mae") <= F.col("rmse")) & (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) < 1e-6)).alias("consistent"))


# ---- sinks


@query
def hits_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents; a second run replaces every third document's exposure hits by those in its first 50 words."""
    table = sinks.hits_table(spark, sinks.scratch(spark))
    table.write(1, K.hits(places(spark, sf_dir)))
    again = star.documents(spark, sf_dir, text=False).filter("document_id % 3 = 0").select("document_id", F.lit(1000).alias("dictionary_type"))
    table.write(2, K.hits(places(spark, sf_dir).filter("document_id % 3 = 0 AND dictionary_type = 1000 AND pos <= 50")), again)
    return _hit_rows(table.read())


@query
def insight_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six insight tables, after every fifth document is deleted from them. Documents without a name aren't saved with exposure-internalization pairs."""
    store = sinks.InsightStore(spark, sinks.scratch(spark))
    named = F.when(F.col("document_id") % 11 != 0, F.concat_ws(" ", F.lit("document"), F.col("document_id").cast("string")))
    rows = {
        "exposure": insights(spark, sf_dir).filter("dictionary_type = 1000"), "internalization": insights(spark, sf_dir).filter("dictionary_type = 1001"),
        "mitigation_exposure": mit_exp(spark, sf_dir), "mitigation_internalization": mit_int(spark, sf_dir),
        "exposure_internalization": exp_int(spark, sf_dir).withColumn("document_name", named), "mitigation_exposure_internalization": mit_exp_int(spark, sf_dir),
    }
    for name, df in rows.items():
        store.save(1, name, df)
    store.delete_documents(2, star.documents(spark, sf_dir, text=False).filter("document_id % 5 = 0"))
    sums = [store.read(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"), F.round(F.sum("score"), 3).alias("score")) for n in rows]
    return reduce(DataFrame.unionAll, sums)


@query
def csv_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year-over-year chart written as CSV; two of its columns read back under other names."""
    path = sinks.scratch(spark)
    sinks.write_csv(rounded(V.chart_yoy(exposures(spark, sf_dir))), path)
    schema = "company_name string, sector_id int, year int, exposure_path_name string, exposure_score double, exposure_score_normalized double"
    return sinks.read_csv(spark, path, schema, {"company_name": "company", "year": "year", "exposure_score": "ei"})


@query
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets of a file-backed dashboard, stacked."""
    path = sinks.scratch(spark)
    yoy = rounded(V.chart_yoy(exposures(spark, sf_dir)))
    sinks.write_csv(yoy.select("company_name", "year", F.col("exposure_score").alias("value")), f"{path}/yoy")
    sinks.write_csv(yoy.select("company_name", "year", F.col("exposure_score_normalized").alias("value")), f"{path}/normalized")
    sheets = sinks.read_workbook(spark, path, dict.fromkeys(("yoy", "normalized"), "company_name string, year int, value double"))
    return reduce(DataFrame.unionAll, (df.withColumn("sheet", F.lit(n)) for n, df in sheets.items()))


@query
def archived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch(spark)
    sinks.archive(star.documents(spark, sf_dir).select("document_id", "text"), path)
    return sinks.read_archive(spark, path, "document_id long, text string").select("document_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts with a form feed between turns, split into pages."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\f").alias("text"))
    return edgar.pages(texts, "conv_id").select("conv_id", "page", F.char_length("text").cast("long").alias("n_chars"))


# ---- more reads


@query
def report_exposure_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.report_exposure_all(exposures(spark, sf_dir), _types(spark)))


@query
def exposure_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company's report rows of a kind of document, by score."""
    rows = rounded(A.report_exposure(exposures(spark, sf_dir)).filter("company_name = 'src1' AND content_type = 2"))
    order = [F.desc("score_normalized"), F.col("document_id"), F.col("exposure_path_id")]
    return V.top_by(rows.select("company_name", "year", "document_id", "exposure_path_id", "cluster_count", "score_normalized"), ["company_name"], order, 1 << 30)


@query
def sector_exposure_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_sector(spark, sector_exposure(spark, sf_dir)).select("esg_category_name", "exposure_path_name", "cluster_count", "score_normalized")


def _of_sector(spark: SparkSession, rows: DataFrame, sector: str = "Finance", year: int = 2016) -> DataFrame:
    return rows.filter(F.col("year") == year).join(F.broadcast(star.sectors(spark).filter(F.col("sector_name") == sector)), "sector_id")


@query
def sector_internalization_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_sector(spark, sector_exp_int(spark, sf_dir)).select("esg_category_name", "exposure_path_name", "internalization_name", "cluster_count", "score_normalized")


@query
def sector_mitigation_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the mitigation's class and sub-class, which multiply a dictionary's insights."""
    m = star.mitigations(spark).select(F.col("dictionary_id").alias("mitigation_dictionary"), "class_name", "sub_class_name")
    t = star.terms(spark).select(F.col("term_id").alias("mitigation_term_id"), F.col("dictionary_id").alias("mitigation_dictionary"))
    rows = exp_int_mit_rows(spark, sf_dir).join(F.broadcast(t), "mitigation_term_id").join(F.broadcast(m), "mitigation_dictionary")
    by = ["esg_category_name", "exposure_path_name", "internalization_name", "class_name", "sub_class_name"]
    stats = rounded(A.sector_stats(rows, star.documents(spark, sf_dir, text=False), by))
    return _of_sector(spark, stats).select(*by, "cluster_count", "score_normalized")


def _financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up metrics of companies and years, from the number of their documents."""
    rows = star.documents(spark, sf_dir, text=False).groupBy("company_name", F.col("year").alias("reporting_year")).agg(F.count("*").alias("n"))
    return rows.select("company_name", "reporting_year", *((F.col("n") * (i + 1) / 4).alias(m) for i, m in enumerate(METRICS)), F.concat(F.lit("X"), F.col("n").cast("string")).alias("exchange_ref"))


@query
def financial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.metrics(_financials(spark, sf_dir), "src1", 2016)


@query
def top10_versus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On three pages the ten highest rows of a company, a competitor and their sector, with ranks."""
    m = star.mitigations(spark).select(F.col("dictionary_id").alias("mitigation_dictionary"), "class_name", "sub_class_name")
    t = star.terms(spark).select(F.col("term_id").alias("mitigation_term_id"), F.col("dictionary_id").alias("mitigation_dictionary"))
    classed = exp_mit_rows(spark, sf_dir).join(F.broadcast(t), "mitigation_term_id").join(F.broadcast(m), "mitigation_dictionary")
    path = ["esg_category_name", "exposure_path_name", "year"]
    pages = {"exposure": (exposures(spark, sf_dir), path), "internalization": (exp_int_rows(spark, sf_dir), [*path, "internalization_name"]), "mitigation": (classed, [*path, "class_name", "sub_class_name"])}
    made = []
    for page, (rows, by) in pages.items():
        company, sector = (rounded(A.averages(rows, [*k, *by])) for k in (["company_name"], ["sector_id"]))
        made.append(V.versus(company, sector.filter("sector_id = 1"), {"company": "src1", "competitor": "src5"}, by).withColumn("page", F.lit(page)))
    return reduce(DataFrame.unionAll, made)


@query
def complete_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from 2016 on with their company's id, without rows that lack any value."""
    return V.complete(company_ids(spark, sf_dir).join(star.documents(spark, sf_dir, text=False), "document_id"), F.col("year") >= 2016)


@query
def dash_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.shown(dash_exposure(spark, sf_dir))


@query
def api_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the in-process interface gives for a company and year, as (chart, pathway, measure, value)."""
    from veinstone.plans import api

    charts = {"triangle": api.triangle(spark, sf_dir, 2016, "src1"), "yoy": api.yoy(spark, sf_dir, "src1"), "control": api.exposure_control(spark, sf_dir, 2016, "src1"), "top10": api.top10(spark, sf_dir, 2016, "src1")}
    long = lambda df: df.unpivot([c for c, t in df.dtypes if t != "double"], [c for c, t in df.dtypes if t == "double"], "measure", "value")
    rows = [long(df.select("exposure_path_name", "year", *(c for c, t in df.dtypes if t == "double"))).select(F.lit(n).alias("chart"), "exposure_path_name", "year", "measure", "value") for n, df in charts.items()]
    return reduce(DataFrame.unionAll, rows)


@query
def escape_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sources escaped for XML and for SQL, and as they are."""
    html = F.coalesce("html", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(T.xml_escape(html)).alias("xml_md5"), F.md5(T.sql_escape(html)).alias("sql_md5"), F.md5(html).alias("text_md5"))
