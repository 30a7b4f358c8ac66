"""Every query with SQL against DuckDB, and anchors that were found independently."""

import math
import os

import duckdb
import pytest

from veinstone.plans.oracle import ORACLE_SQL
from veinstone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sections(spark):
    from veinstone.operators import filings
    from veinstone.plans import queries

    few = queries._filings(spark, SF).filter("filing_id < 1000")
    got = {(r["filing_id"], r["item"]): r["section"] for r in filings.sections(few).collect()}
    assert got[(1, "1A")] == "ITEM1A. Risk & more." and "widgets." in got[(1, "1")]
    assert got[(2, "0")].startswith("ACCESSION NUMBER: 9") and got[(3, "7A")].startswith("ITEM7A. Only")
    assert got[(5, "9C")].startswith("ITEM9C. Foreign.") and got[(5, "1")].startswith("ITEM1. b.") and got[(5, "3")].startswith("ITEM3. g.") and (4, "0") in got
    head = {r["filing_id"]: r for r in QUERIES["tenk_header"](spark, SF).collect()}
    assert head[1]["conformed_name"] == "ACME WIDGET CORP" and head[1]["state"] == "DE" and head[1]["sic_code_4_digit"] == 1311
    assert head[2]["conformed_name"] == "BETA HOLDING" and head[3]["city"] == "SAN JOSE"


@pytest.mark.parametrize("name,rows,total", [("insight_two_factor", 775, 21292.457492 + 8789.106883), ("insight_exp_int", 257, 90782.877098), ("insight_mit_exp", 777, 102690.673327), ("insight_mit_int", 366, 26017.440017), ("insight_mit_exp_int", 361, 94666.872534)])
def test_anchors(spark, name, rows, total):
    got = [r["score"] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select("score").collect()]
    assert len(got) == rows and abs(sum(got) - total) < 0.01
