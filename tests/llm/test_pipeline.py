import zlib
from collections import Counter

import numpy as np
import pytest

from veinstone.llm.queries import vocabulary

try:
    import corpus_pipeline
except ModuleNotFoundError:
    corpus_pipeline = None
pytestmark = pytest.mark.skipif(corpus_pipeline is None, reason="the pipeline has been removed")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, name, docs, sf="/root/testdata/sf0.001"):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf)


def test_stages(spark):
    import duckdb

    item = duckdb.connect().execute("select text from '/root/testdata/sf0.001/benchmark.parquet' order by length(text) desc limit 1").fetchone()[0]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = stage(spark, "language", docs)
    assert first.columns == docs.columns and first.count() >= 0.97 * docs.count()
    rows = [(1, None, "en", "a", 0), (2, "123", "en", "a", 3), (3, "the thing and the other thing of this", "en", "a", 1)]
    kept = stage(spark, "language", docs.unionByName(spark.createDataFrame([(i + 10**6, *r) for i, *r in rows], SCHEMA)))
    assert {r["doc_id"] - 10**6 for r in kept.collect() if r["doc_id"] > 10**5} == {3}
    rows = [(1, "a b c d e f g", None, "a", 0), (2, "A b c d e f g", None, None, 0), (2, "A b c d e f g", None, None, 0), (3, "", "x", "a", 0), (4, None, "x", "a", 0), (5, "else", "x", "a", 0), (5, "else", "x", "a", 0), (None, "lone words", "x", "a", 0)]
    unique = stage(spark, "near_duplicates", spark.createDataFrame(rows, SCHEMA))
    assert Counter(r["doc_id"] for r in unique.collect()) == Counter([1, 3, 4, 5, None]) and unique.columns == docs.columns
    rows = [(1, item, "en", "a", 0), (2, "x " + item.upper() + " y", "en", "a", 0), (3, "clean words", "en", "a", 0), (None, "also clean", "en", "a", 0), (4, None, "en", "a", 0)]
    clean = stage(spark, "decontamination", spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, None} and clean.columns == docs.columns
    safe = {r["doc_id"]: r for r in stage(spark, "secrets", spark.createDataFrame([(1, "x password=abcdefghijklm y", "en", "a", 9), (2, "fine", "en", "a", 4)], SCHEMA)).collect()}
    assert (safe[1]["text"], safe[1]["n_chars"], safe[2]["text"]) == ("x [SECRET] y", 12, "fine")


def test_rows_of_one_id_are_judged_apart(spark):
    import duckdb

    item = duckdb.connect().execute("select text from '/root/testdata/sf0.001/benchmark.parquet' order by length(text) desc limit 1").fetchone()[0]
    make = lambda rows: spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    rows = [(None, "x " + item), (None, "clean one"), (None, "clean two"), (None, "clean two"), (None, None), (7, item), (7, "clean three")]
    assert texts(stage(spark, "decontamination", make(rows))) == Counter([*rows[1:5], rows[6]])
    near = " ".join(f"w{i}" for i in range(60))
    alone, other = "some words that stand alone here", "quite another text without a copy"
    rows = [(None, near), (None, near + " more"), (None, alone), (None, alone), (None, other + " and id"), (8, other), (8, near + " again and"), (9, "one of nine"), (9, "two of nine")]
    rows += [(3, "k " + near.replace("w", "v")), (None, near.replace("w", "v")), (4, near.replace("w", "u")), (4, near.replace("w", "u") + " u")]
    got = texts(stage(spark, "near_duplicates", make(rows)))
    fixed = [(None, alone), (None, other + " and id"), (8, other), (8, near + " again and"), (9, "one of nine"), (9, "two of nine"), rows[9]]
    assert all(got[r] == 1 for r in fixed) and sum(got.values()) == len(fixed) + 1
    assert sum(got[r] for r in rows[-2:]) == 1 and not got[rows[0]] and not got[rows[1]]


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    left = {}
    for r in rows:
        left.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for parts in left.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_against_a_plain_run(spark):
    """The stages over a whole table against plain code: kept rows, texts and ids."""
    from tokenizers import Tokenizer

    from tests.llm.test_joins_warc_language import plain_set
    from tests.llm.test_native import plain_decontaminate, plain_spans

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = frame[name] = spark.createDataFrame(f(spark, docs, sf).collect(), docs.schema)
    got = {n: {r["doc_id"]: r["text"] for r in df.collect()} for n, df in frame.items()}

    letters = lambda t: bool(t) and any(map(str.isalpha, t))
    assert got["language"].items() <= rows.items() and all(letters(t) for t in got["language"].values())
    assert len(got["language"]) >= 0.95 * sum(letters(t) for t in rows.values())

    sets, group = {i: plain_set(t) for i, t in got["language"].items()}, {i: i for i in got["language"]}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    kept = {i: t for i, t in got["language"].items() if group[i] == i}
    assert got["near_duplicates"] == kept

    kept = {i: t for i, t in kept.items() if not plain_decontaminate(t, items)[1]}
    assert got["decontamination"] == kept

    def redacted(t):
        out, at = "", 0
        for s, _, e in plain_spans(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        return out + t[at:]

    kept = {i: redacted(t) for i, t in kept.items()}
    assert got["secrets"] == kept

    tokens = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = corpus_pipeline.packing(spark, docs, sf).collect()
    packed = {i: np.array([*tokens.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in kept.items()}
    assert {r["doc_id"] for r in pieces} == set(kept)
    for i, ids in packed.items():
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()] and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
