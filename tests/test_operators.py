"""Hand-made inputs with known results."""

import pytest
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import aggregates, dictionary, filings, keywords, mlprep, proximity, serving, status
from veinstone.sources import edgar, sinks, star

PLACE = "document_id long, company_name string, year int, content_type int, sector_id int, dictionary_type int, dictionary_id int, path_id int, key_word string, term_id int, pos int"


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "document_id long, text string")


def place_rows(spark, **terms):
    """Places of terms of one dictionary of one document."""
    rows = [(1, "c", 2020, 1, 0, 1000, 1, 101, k, i, p) for i, (k, at) in enumerate(sorted(terms.items())) for p in at]
    return spark.createDataFrame(rows, PLACE)


def scores(df):
    return [(r["factor1"], round(r["factor2"], 9), round(r["score"], 9)) for r in df.collect()]


@pytest.mark.parametrize("p,q,want", [([10], [12, 40], [(1, 0.5, 2.0)]), ([1], [26, 27], [(1, 0.04, 25.0)]), ([5], [5, 7], [(1, 0.5, 2.0)]), ([5], [5], []), ([25, 50], [24, 51, 76], [(6, None, None)])])
def test_two_factor(spark, p, q, want):
    got = scores(proximity.two_factor(place_rows(spark, a=p, b=q)))
    if want and want[0][1] is None:
        d = [abs(x - y) for x in p for y in q if 0 < abs(x - y) <= 25]
        f2 = sum(1 / x for x in d) / len(d)
        want = [(len(d), round(f2, 9), round(len(d) / f2, 9))]
    assert got == want


def test_mitigation_counts_shared_places_once(spark):
    places = place_rows(spark, a=[7], b=[7, 5]).union(spark.createDataFrame([(1, "c", 2020, 1, 0, 1002, 4, 301, "m", 9, 5)], PLACE))
    insight = spark.createDataFrame([(1, 0, 1)], "document_id long, term_id1 int, term_id2 int")
    assert scores(proximity.with_mitigation(insight, places, ["term_id1", "term_id2"])) == [(2, 0.5, 4.0)]
    assert scores(proximity.with_mitigation(insight, places.filter("not (term_id = 1 and pos = 5)"), ["term_id1", "term_id2"])) == [(1, 0.5, 2.0)]


def test_range_join_equals_plain(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (sorted({int(x) for x in rng.integers(1, 400, 60)}) for _ in "ab")
    mk = lambda xs: spark.createDataFrame([(1, x) for x in xs], "k int, pos int")
    got = sorted((r[0], r[1]) for r in proximity.near(mk(a), mk(b), ["k"]).select("l.pos", "r.pos").collect())
    assert got == sorted((x, y) for x in a for y in b if abs(x - y) <= 25)


def test_tokens(spark):
    got = keywords.tokens(texts(spark, "café?bar", "a -- ! b", None, "", "x\x1cy  #\n", "co-op/x A.B")).orderBy("document_id", "pos").collect()
    assert [(r["document_id"], r["pos"], r["word"]) for r in got] == [(0, 1, "caf"), (0, 2, "bar"), (1, 1, "a"), (1, 2, "--"), (1, 3, ""), (1, 4, "b"), (4, 1, "x"), (4, 2, "y"), (4, 3, ""), (5, 1, "co-op/x"), (5, 2, "AB")]


def test_case_and_phrases(spark):
    terms = star.terms(spark, [(1000, 1, 1, "IT, climate change ,risk")])
    got = keywords.hits(keywords.positions(texts(spark, "it IT It climate change RISK risk."), terms)).collect()
    assert {(r["key_word"], tuple(r["locations"]), r["frequency"]) for r in got} == {("IT", (2,), 1), ("RISK", (6, 7), 2)}


def test_related_words(spark):
    terms = star.terms(spark, [(1000, 1, 1, "risk,risks,it")])
    found = keywords.related_words(texts(spark, "risky Risks brisk risky biting"), terms)
    context = star.frame(spark, [("RISK", "RISKY", "INCLUDE"), ("RISK", "BRISK", "INCLUDE"), ("RISK", "BRISK", "EXCLUDE")], "key_word string, related string, action string")
    done = keywords.resolve(found, context)
    assert {(r["key_word"], r["related"], tuple(r["locations"]), r["status"]) for r in done.collect()} == {("RISK", "RISKY", (1, 4), "INCLUDE"), ("RISK", "BRISK", (3,), "EXCLUDE")}
    assert keywords.failed_documents(done).count() == 0
    assert keywords.failed_documents(keywords.resolve(found, context.limit(0))).first()["unknown_words"] == 2


def test_merge(spark):
    row = lambda k, at: (1, 1000, 1, k, at)
    mk = lambda *rows: spark.createDataFrame(list(rows), "document_id long, dictionary_type int, dictionary_id int, key_word string, locations array<int>")
    terms = spark.createDataFrame([(1000, 1, w) for w in ("RISK", "RISKS", "X", "A", "AB", "ABC")], "dictionary_type int, dictionary_id int, key_word string")
    got = keywords.merged(mk(row("RISK", [1]), row("RISKS", [4]), row("X", [9])), terms).collect()
    assert {(r["key_word"], tuple(r["locations"]), r["frequency"]) for r in got} == {("RISK", (1, 4), 2), ("X", (9,), 1)}
    got = keywords.merged(mk(row("A", [1]), row("AB", [2]), row("ABC", [3])), terms).collect()
    assert sorted(tuple(r["locations"]) for r in got) == [(1, 2), (1, 3), (2, 3)]


def test_normalised(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "document_id long, score double")
    assert sorted(r["score_normalized"] for r in proximity.with_document_norm(df).collect()) == [50.0, 100.0]


def test_cluster_count_is_whole(spark):
    rows = spark.createDataFrame([(0, 2020, "p", 1.0)] * 7, "sector_id int, year int, p string, score double")
    docs = spark.createDataFrame([(0, 2020)] * 2, "sector_id int, year int")
    r = aggregates.sector_stats(rows, docs, ["p"]).first()
    assert (r["cluster_count_all"], r["cluster_count"], r["score_normalized"]) == (7, 3, 100.0)


def test_changes_and_shares(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in ((1, 100.0), (2, 110.0), (3, 99.0))] + [("b", 1, 0.0), ("b", 2, 5.0)], "k string, y int, v double")
    got = [r["pct_change"] for r in serving.pct_change(df, ["k"], "y", "v").orderBy("k", "y").collect()]
    assert [None if x is None else round(x, 9) for x in got] == [None, 0.1, -0.1, None, None]
    df = spark.createDataFrame([(1, 10.0, 30.0), (1, 10.0, 70.0), (2, 5.0, 0.0), (2, 5.0, 0.0)], "g int, c double, w double")
    assert sorted(r["allocated"] for r in mlprep.allocate(df, ["g"], "c", "w").collect()) == [0.0, 0.0, 3.0, 7.0]
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "g int, v string")
    assert sorted((r["v"], r["average_rank"], r["n"]) for r in serving.average_rank(df, "g", "v").collect()) == [("a", 1.0, 1), ("b", 2.5, 2)]
    assert mlprep.standardize(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v").filter("standardized is not null").count() == 0


def test_review_and_index(spark):
    lines = star.frame(spark, [("k:v:include",), ("K:V:EXCLUDE",), ("short:line",)], "line string")
    assert [tuple(r) for r in dictionary.review(dictionary.parse_review(lines)).collect()] == [("K", "V", "INCLUDE")]
    r = edgar.parse_index(star.frame(spark, [("1000045|NAME|10-K|2022-01-31|edgar/data/1000045/x-22-1.txt",), ("header",)], "line string")).collect()
    assert [(x["cik"], x["filing_date"], x["file_name"]) for x in r] == [(1000045, 20220131, "1000045-x-22-1.txt")]


def test_item_starts():
    b = filings.BREAK
    one = f"x{b}ITEM1 a{b}ITEM1A b{b}ITEM1 real{b}ITEM1A real{b}ITEM1B z{b}ITEM1 later"
    taken = filings.starts(one)
    assert taken["1"] == one.index(f"{b}ITEM1 real") and taken["1A"] == one.index(f"{b}ITEM1A real")
    many = "".join(f"{b}ITEM7 {i}" for i in range(3))
    assert filings.starts(many) is None
    assert filings.starts(f"{b}ITEM1 x" + many)["7"] > 0
    assert filings.starts("nothing") == {}


def test_status(spark):
    docs = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 0, 2), (3, 1, 1, 2), (4, 1, 1, 1)], "document_id long, exposure_ind int, internalization_ind int, mitigation_ind int")
    assert [r["document_id"] for r in status.pending(docs, "mitigation", ("exposure", "internalization")).orderBy("document_id").collect()] == [1, 3]
    assert status.counters(docs).first()["mitigation_failed"] == 2
    new = spark.createDataFrame([(2, 9, 9, 9)], docs.schema)
    assert sorted(r["exposure_ind"] for r in status.upsert(docs, new, "document_id").collect()) == [1, 1, 1, 9]


def test_text_functions(spark):
    r = spark.range(1).select(T.html_text(F.lit("<p>a&amp;b<script>x<y</script><!-- c -->&nbsp;d</p>")).alias("h"), T.xml_escape(F.lit("<a & 'b'>")).alias("x"), T.sic_code(F.lit("OIL [1311]")).alias("s"), T.sic_code(F.lit("none")).alias("z")).first()
    assert tuple(r) == ("a&b d", "&lt;a &amp; &apos;b&apos;&gt;", 1311, 0)


def test_files_and_stream(spark, tmp_path):
    from veinstone.streaming.incremental import stream_hits

    (tmp_path / "one.txt").write_text("page one\fpage two")
    assert edgar.read_texts(spark, str(tmp_path / "one.txt")).first()["pages"] == ["page one", "page two"]
    terms = star.terms(spark, [(1000, 1, 1, "risk")])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, t in enumerate(("risk a", "b risk risk")):
        spark.createDataFrame([(i, t)], "document_id long, text string").write.mode("append").parquet(src)
        stream_hits(spark, src, spark.read.parquet(src).schema, terms, out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r["document_id"], r["frequency"]) for r in got.collect()) == [(0, 1), (1, 2)]
    found = keywords.hits(keywords.positions(texts(spark, "risk"), terms))
    table = sinks.hits_table(spark, f"file://{tmp_path}/hits")
    for _ in range(2):
        table.write(1, found)
    assert table.read().count() == 1
