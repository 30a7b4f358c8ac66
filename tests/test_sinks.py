"""Versioned tables, files for exchange, dictionary files, states and filings."""

import pytest
from pyspark.sql import functions as F

from veinstone.operators import dictionary, filings, keywords, mlprep, serving, status
from veinstone.sources import edgar, sinks

HIT = "document_id long, dictionary_type int, dictionary_id int, key_word string, frequency long, locations array<int>"


def hit(doc, kind, word, at=(1,)):
    return (doc, kind, 1, word, len(at), list(at))


def test_hits_of_other_documents_stay(spark, tmp_path):
    table = sinks.hits_table(spark, f"file://{tmp_path}/hits")
    assert table.read().count() == 0
    table.write(1, spark.createDataFrame([hit(1, 1000, "A"), hit(2, 1000, "A"), hit(2, 1001, "B"), hit(None, 1000, "N")], HIT))
    table.write(2, spark.createDataFrame([hit(3, 1000, "A"), hit(2, 1000, "C", (4, 5))], HIT))
    rows = lambda: {(r["document_id"], r["dictionary_type"], r["key_word"]) for r in table.read().collect()}
    assert rows() == {(1, 1000, "A"), (2, 1000, "C"), (2, 1001, "B"), (3, 1000, "A")}
    table.write(2, spark.createDataFrame([hit(3, 1000, "D")], HIT))  # a batch that runs again replaces itself
    assert rows() == {(1, 1000, "A"), (2, 1000, "A"), (2, 1001, "B"), (3, 1000, "D")}
    table.delete(3, spark.createDataFrame([(1, 1000)], "document_id long, dictionary_type int"))
    kept = {(2, 1000, "A"), (2, 1001, "B"), (3, 1000, "D")}
    assert rows() == kept
    table.compact(4)
    assert rows() == kept and [f.rsplit("/", 1)[1] for f in sinks.listed(spark, f"file://{tmp_path}/hits/rows")] == ["sink_batch=4"]


def test_insight_store(spark, tmp_path):
    store = sinks.InsightStore(spark, f"file://{tmp_path}")
    four = "exp_term_id1 int, exp_term_id2 int, int_term_id1 int, int_term_id2 int, factor1 long, factor2 double, score double, score_normalized double"
    rows = spark.createDataFrame([(1, "a", 1, 2, 3, 4, 1, 0.5, 2.0, 100.0), (2, None, 1, 2, 3, 4, 1, 0.5, 2.0, 100.0), (None, "c", 1, 2, 3, 4, 1, 0.5, 2.0, 100.0)], f"document_id long, document_name string, {four}")
    store.save(1, "exposure_internalization", rows)
    assert [r["document_id"] for r in store.read("exposure_internalization").collect()] == [1]
    store.delete_documents(2, spark.createDataFrame([(1,)], "document_id long"))
    assert all(store.read(n).count() == 0 for n in sinks.INSIGHTS)


def test_csv_keeps_quotes_commas_and_line_ends(spark, tmp_path):
    rows = [("a, b", 'say "x"', 1.5), ("line\\end", "", None), (None, "é", -2.0)]
    df = spark.createDataFrame(rows, "name string, note string, v double")
    sinks.write_csv(df, f"file://{tmp_path}/t")
    got = sinks.read_csv(spark, f"file://{tmp_path}/t", "name string, note string, v double", {"v": "value", "name": "name"})
    assert got.columns == ["value", "name"] and {tuple(r) for r in got.collect()} == {(1.5, "a, b"), (None, "line\\end"), (-2.0, None)}


def test_archive(spark, tmp_path):
    rows = {(1, "x\ny é"), (2, None), (3, "")}
    sinks.archive(spark.createDataFrame(list(rows), "id long, text string"), f"file://{tmp_path}/a")
    assert {tuple(r) for r in sinks.read_archive(spark, f"file://{tmp_path}/a", "id long, text string").collect()} == rows
    assert any(f.endswith(".gz") for f in sinks.listed(spark, f"file://{tmp_path}/a"))


def test_dictionary_files(spark, tmp_path):
    current, inbox = f"file://{tmp_path}/dictionary", f"file://{tmp_path}/inbox"
    assert dictionary.apply_files(spark, current, inbox) == 0 and dictionary.read(spark, current).count() == 0
    for lines in (["a:b:include", "a:c:no"], ["a:b:INCLUDE", "x:y:include"]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(inbox)
        assert dictionary.apply_files(spark, current, inbox) == 1
    assert {tuple(r) for r in dictionary.read(spark, current).collect()} == {("A", "B", "INCLUDE"), ("A", "C", "EXCLUDE"), ("X", "Y", "INCLUDE")}
    assert dictionary.apply_files(spark, current, inbox) == 0


def test_validation_states(spark):
    docs = spark.createDataFrame([(i, *[s] * 3, *[v] * 3) for i, (s, v) in enumerate([(0, 0), (0, 2), (1, 0), (2, 2), (0, 1)])], "document_id long, " + ", ".join(f"{f}_search int" for f in status.FLAGS) + ", " + ", ".join(f"{f}_validation int" for f in status.FLAGS))
    some = spark.createDataFrame([(0,), (0,), (2,), (None,)], "document_id long")
    waiting = status.validation_generated(docs, some, "mitigation")
    assert [r[0] for r in waiting.orderBy("document_id").select("mitigation_validation").collect()] == [2, 2, 2, 2, 1]
    assert [r[0] for r in status.validation_failed(waiting, some, "mitigation").orderBy("document_id").select("mitigation_validation").collect()] == [0, 2, 0, 2, 1]
    assert [r[0] for r in status.validation_completed(waiting).orderBy("document_id").select("mitigation_validation").collect()] == [1, 1, 2, 2, 1]


def test_pages(spark):
    df = spark.createDataFrame([(1, "a\fb\f"), (2, ""), (3, None), (4, "x")], "id long, text string")
    assert sorted(map(tuple, edgar.pages(df, "id").collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, ""), (3, 1, ""), (4, 1, "x")]


def test_filings(spark):
    rows = [(1, "CITY: REAL\n<DOCUMENT>\nx.\nItem 9B. o.\nItem 9C. f.\nCITY: BODY\n</DOCUMENT>"), (2, "CITY: ALL"), (3, "<DOCUMENT>\na.\nItem 2. a.\nItem 2. b.\nItem 2. c.\n</DOCUMENT>"), (4, None)]
    df = spark.createDataFrame(rows, "filing_id long, content string").filter("content IS NOT NULL")
    assert {r["filing_id"]: r["city"] for r in filings.header_fields(df).collect()} == {1: "REAL", 2: "ALL", 3: None}
    parts = filings.sections(df)
    got = {(r["filing_id"], r["item"]): (r["status"], r["section"]) for r in parts.collect()}
    assert got[(1, "9C")][1].startswith("ITEM9C. f.") and got[(1, "9B")][1] == "ITEM9B. o." and got[(2, "0")][0] == filings.ZERO and got[(3, "0")][0] == filings.FAILED
    assert {r["status"]: r["filings"] for r in filings.status_counts(parts).collect()} == {"full": 1, "item zero": 1, "failed": 1}
    assert "form_item9c" in filings.wide(parts).columns and len(filings.wide(parts).columns) == 24


def test_containing_and_merged(spark):
    terms = spark.createDataFrame([(1000, 1, w) for w in ("A", "AB", "ABC", "X", "XX")] + [(1000, 2, "A"), (1000, 2, "Q")], "dictionary_type int, dictionary_id int, key_word string")
    words = spark.createDataFrame([(w,) for w in ("ABC", "A", "", "ZAZ", "XX")], "w string")
    assert {tuple(r) for r in keywords.containing(words, "w", terms.select("key_word").distinct(), "key_word").select("w", "key_word").collect()} == {("ABC", "A"), ("ABC", "AB"), ("ZAZ", "A"), ("XX", "X")}
    found = spark.createDataFrame([(1, 1000, 1, "A", [1]), (1, 1000, 1, "AB", [2]), (1, 1000, 1, "ABC", [3]), (1, 1000, 1, "X", [9]), (1, 1000, 2, "A", [1])], "document_id long, dictionary_type int, dictionary_id int, key_word string, locations array<int>")
    got = {(r["dictionary_id"], r["key_word"], r["merged_with"], tuple(r["locations"])) for r in keywords.merged(found, terms).collect()}
    assert got == {(1, "A", "AB", (1, 2)), (1, "A", "ABC", (1, 3)), (1, "AB", "ABC", (2, 3)), (1, "X", None, (9,)), (2, "A", None, (1,))}


def test_average_rank_and_factorize(spark):
    df = spark.createDataFrame([("g", x, i) for i, x in enumerate(["b", "a", "b", "c"])], "by string, value string, at long")
    assert {r["value"]: r["average_rank"] for r in serving.average_rank(df, "by", "value").collect()} == {"a": 1.0, "b": 2.5, "c": 4.0}
    many = spark.range(1000).select((F.col("id") * 7 % 50).alias("v"), "id")
    got = {r["v"]: r["code"] for r in mlprep.factorize(many, "v", "id").collect()}
    assert got == {i * 7 % 50: i for i in range(50)}


def test_linear_fit_is_repeatable(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 17).cast("double").alias("x")).withColumn("y", 3 * F.col("x") + 1)
    a, b = (mlprep.linear_fit(d, "x", "y", ["k"]).first() for d in (df, df.repartition(7)))
    assert a["n_train"] + a["n_test"] == 300 and (a["n_train"], a["n_test"]) == (b["n_train"], b["n_test"])
    assert a["slope"] == pytest.approx(3) and a["intercept"] == pytest.approx(1) and a["rmse"] == pytest.approx(0, abs=1e-9)
    made = {r["model"]: r for r in mlprep.tune_regression(df, ["x"], "y", ["k"]).collect()}
    assert made["linear"]["rmse"] < 0.2 and made["trees"]["candidates"] == 4
