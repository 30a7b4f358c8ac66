"""Jaccard join, components, WARC archives, language filters and the pipeline against plain versions."""

import base64
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest

from veinstone.llm import jaccard_join, language_id, warc
from veinstone.llm.common import shared_dir
from veinstone.llm.components import components
from veinstone.llm.shingles import shingle_sets


def plain_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_components(docs):
    sets, parent = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets)))


def families(seed, groups=6, each=25):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdé"), 3)) for _ in range(300)]
    passage = " ".join(rng.choice(vocab, 30))
    docs = []
    for g in range(groups):
        base = list(rng.choice(vocab, int(rng.integers(20, 120))))
        for _ in range(each):
            words = list(base)
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
            docs.append(" ".join(words) + (" " + passage if g % 2 else ""))
    docs += [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(0, 60, 40)] + [passage] * 3
    order = rng.permutation(len(docs))
    return [(int(i) + 7, docs[int(k)]) for i, k in enumerate(order)]


EDGES = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one two three"), (1006, "a b c d e"), (1007, "A b C d E"), (1007, "A b C d E"), (None, "a b c d e"), (None, None), (1008, "x " * 9000), (1009, "q" * 60_000), (1010, "É b c d e"), (1011, "é b c d e")]


@pytest.mark.parametrize("seed,chunk", [(1, jaccard_join.CHUNK), (2, 500), (3, 500)])
def test_jaccard(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    docs = families(seed) + EDGES
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n int, node string").repartition(3)
    got = Counter(tuple(r) for r in jaccard_join.jaccard_join(df).collect())
    assert got == plain_components(docs)


def test_hot_shingles_of_unlinked_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4000)
    rng = np.random.default_rng(12)
    passage = " ".join(f"common{i}" for i in range(14))
    own = lambda n: " ".join("".join(x) for x in rng.choice(list("abcdefgh"), (n, 6)))
    docs = [(i, f"{own(30)} {passage}") for i in range(500)] + [(1000 + i, f"{passage} {passage} x{i % 3}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in jaccard_join.jaccard_join(df).collect()) == plain_components(docs)


def test_packed_chunks_round_trip():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), int(n))) for n in rng.integers(1, 60, 50)]
    rows = list(jaccard_join._packed(sets, [bytes([i]) * 16 for i in range(len(sets))], 7))
    names = ["kind", "group", "chunk", "a", "b", "c"]
    kinds = [jaccard_join.pa.int32(), jaccard_join.pa.int32(), jaccard_join.pa.int64(), *[jaccard_join.pa.binary()] * 3]
    table = jaccard_join.pa.table({n: jaccard_join.pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
    assert any(r[0] == jaccard_join.SHARED for r in rows)
    made = jaccard_join._shared(80, 100)(jaccard_join._answers(table)).to_pylist()
    count = Counter(int(x) for s in sets for x in s)
    for r in made:
        s = sets[r["node"][0]]
        want = sorted((count[int(x)], int(x)) for x in s if count[int(x)] > 1)
        got = [x % 2**64 for x in r["tokens"]]
        assert r["n"] == len(s) and got == [x for _, x in want]
        for i, rest in enumerate(r["rest"]):
            assert rest == [sum(x % jaccard_join.CLASSES == c for x in got[i + 1 :]) for c in range(jaccard_join.CLASSES)]
        assert len(r["rest"]) == min(len(got), len(s) - -(-len(s) * 80 // 100) + 1 - (len(s) - len(got)))


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_join(df).count() == 0
    one = spark.createDataFrame([(5, None), (6, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_join(one).collect())) == [(5, 0, 5), (6, 0, 6)]


def test_shingle_sets():
    texts = [t for _, t in families(4) + EDGES]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(plain_set(t))
    a, b = shingle_sets(["x", "a b  c\nd e f\x0b"]), shingle_sets(["A b c D e f"])
    assert (a[1] == b[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def page_rows():
    decoy = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://x/{i}", f"<p>{'long ' * (i * 37 % 211)}{i % 7 if i % 3 else ''}</p>") for i in range(120)]
    rows += [(200, "http://d/", decoy * 40), (201, None, None), (202, "http://e/\r\nInjected: 1", ""), (5, "http://again/", "same"), (3, "http://b/", "same"), (3, "http://b/", "same"), (None, "u", "same"), (None, "v", "null only"), (None, "w", "null only"), (203, "x", "é日本\r\n\r\n" * 50), (204, "y", "z" * 300_000), (-4, "q", decoy)]
    return rows


@pytest.mark.parametrize("size,least", [(warc.RANGE, 0), (1000, 0), (5000, 10)])
def test_warc_round_trip(spark, size, least):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = shared_dir(spark)
    warc.write_warc(df, path, least)
    got = Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_id"], r["digest_ok"]) for r in warc.read_warc(spark, path, range_bytes=size).collect())
    first, counts = {}, Counter(h or "" for _, _, h in rows)
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want, name = Counter(), lambda i: "<urn:x-page-without-id>" if i is None else f"<urn:x-page:{i}>"
    for i, _, h in rows:
        h = h or ""
        data = h.encode()
        again = len(data) >= least and counts[h] > 1 and h in first and first[h] != i
        want[(name(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", name(first[h]) if again else None, None if again else True)] += 1
    assert got == want
    payloads = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, path, True, size).collect() if r["record_type"] == "response"}
    assert payloads[name(204)] == b"z" * 300_000 and payloads[name(203)] == ("é日本\r\n\r\n" * 50).encode()


@pytest.mark.parametrize("size", [warc.RANGE, 1000, 70_000])
def test_warc_long_urls(spark, size):
    urls = {i: f"http://x/{i}" for i in range(40)} | {10: "data:," + "a" * 65_600, 20: "data:," + "WARC/1.1 b:" * 30_000, 30: "data:," + "c" * 65_300, 39: "data:," + "d" * 140_000}
    df = spark.createDataFrame([(i, u, f"payload {i} WARC/1.1\r\na: b\r\n" + "x: WARC/1.1\r\n" * 30) for i, u in urls.items()], "page_id long, url string, html string").coalesce(1)
    path = shared_dir(spark)
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path, range_bytes=size).collect()
    assert sorted((r["record_id"], r["target_uri"], r["digest_ok"]) for r in got) == sorted((f"<urn:x-page:{i}>", u, True) for i, u in urls.items())


def test_range_edges_many_decoys():
    record = lambda n, url="u": b"WARC/1.1\r\nWARC-Target-URI: " + url.encode() + b"\r\nContent-Length: %d\r\n\r\n" % n
    payload = b"x: WARC/1.1\r\n" * 200_000
    data = record(len(payload)) + payload + b"\r\n\r\n" + record(1, "v" * 100_000) + b"z\r\n\r\n"
    edges = dict(warc.range_edges(data, 0, len(data), len(data)))
    assert edges[0] == len(data) and edges[len(record(len(payload))) + len(payload) + 4] == len(data)
    head = record(5, "v" * 100_000)
    assert warc.goes_on(head[:70_000], 10) and warc.goes_on(head[:9], 10) and not warc.goes_on(head, 10) and not warc.goes_on(b"WARC/1.1\r\nno field\r\n" + b"x" * 70_000, 10)


def test_warc_cut_off_and_empty(spark):
    path = shared_dir(spark)
    warc.write_warc(spark.createDataFrame([(i, "u", "payload " * 50 + str(i)) for i in range(20)], "page_id long, url string, html string").coalesce(1), path)
    assert warc.broken(spark, path, warc.read_warc(spark, path, range_bytes=700)).isEmpty()
    local = path.removeprefix("file:")
    local = "/" + local.lstrip("/")
    part = next(os.path.join(local, f) for f in os.listdir(local) if f.startswith("part-"))
    with open(part, "rb") as f:
        data = f.read()
    for f in os.listdir(local):
        if f.endswith(".crc"):
            os.remove(os.path.join(local, f))
    with open(part, "wb") as f:
        f.write(data[: len(data) // 2])
    got = warc.read_warc(spark, path, range_bytes=700)
    last = max(r["end"] for r in got.collect())
    assert 5 < got.count() < 15
    assert [(r["length"], r["end"]) for r in warc.broken(spark, path, got).collect()] == [(len(data) // 2, last)] and 0 < last < len(data) // 2
    with open(part, "wb") as f:
        f.write(b"no archive")
    assert [(r["length"], r["end"]) for r in warc.broken(spark, path, warc.read_warc(spark, path)).collect()] == [(10, 0)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language(spark):
    import duckdb

    rows = duckdb.connect().execute("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    extra = [(10_000, None, "en"), (10_001, "", "fr"), (10_002, "12 !! \n", "de"), (None, "the of and the", "en"), (10_003, "а б в", None), (10_004, "the thing " * 300_000, None), (10_005, "x", None), (10_006, "the thing", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    for i in (10_000, 10_001, 10_002):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[None]["held_out"] and got[10_004]["lang_pred"] == "en" and got[10_003]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.language_id(df.limit(0)).count() == 0
    nothing = language_id.language_id(df, df.limit(0)).filter("lang_pred <> 'und'")
    assert nothing.count() == 0


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        words = ["".join(chr(0x4E00 + 20 * k + int(c)) for c in rng.integers(0, 20, 4)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 30)), f"l{k:03}") for i in range(12 if k % 2 else 8)]
    got = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.5 for i, _, lang in rows)
    assert language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).cells.shape[0] == 3


def test_language_counts_exact():
    grams = [language_id.ngrams([t])[0] for t in ("the thing other", "une chose autre")]
    f = language_id.Filters.build(["a", "b"], grams)
    total, hits = f.count(["the thing", "autre", "zzz"])
    assert total.tolist() == [float(len(language_id.ngrams([t])[0])) for t in ("the thing", "autre", "zzz")]
    assert abs(hits[0][0] - total[0]) < 0.01 and hits[1][1] >= total[1] - 0.01 and hits[:, 2].max() < 0.01
    big = "word " * 500_000
    assert f.count([big])[0][0] == pytest.approx(f.count(["word " * 5])[0][0] * 100_000, rel=0.001)


def test_filters_against_plain_sets():
    """Counts and decisions of the bit-sliced filters against sets of n-grams, where no cell is shared by chance."""
    rng = np.random.default_rng(31)
    texts = {x: [" ".join("".join(rng.choice(list(letters), int(n))) for n in rng.integers(1, 9, 40)) for _ in range(6)] for x, letters in {"aa": "abcdeé", "bb": "cdefgh", "cc": "xyzab"}.items()}

    def grams(text):
        out = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out += [padded[i : i + n] for n in language_id.ORDERS for i in range(len(padded) - n + 1)]
        return out

    hashes = {x: np.unique(language_id.ngrams(t)[0]) for x, t in texts.items()}
    sets = {x: {g for s in t for g in grams(s)} for x, t in texts.items()}
    assert {x: len(h) for x, h in hashes.items()} == {x: len(s) for x, s in sets.items()}
    filters = language_id.Filters.build(list(texts), list(hashes.values()))
    asked = [t for ts in texts.values() for t in ts] + ["abc xyz 12 cde", "", None, "123", "日本", "é"]
    total, hits = filters.count(asked)
    langs, scores = filters.decide(asked)
    for i, t in enumerate(asked):
        own = grams(t or "")
        assert total[i] == len(own)
        plain = [sum(g in sets[x] for g in own) for x in texts]
        assert np.allclose(hits[:, i], plain, atol=0.01 * len(own) + 1e-9)
        if not re.search(r"[^\W\d_]", t or ""):
            assert (langs[i], scores[i]) == ("und", 0.0)
        elif sorted(plain)[-1] > sorted(plain)[-2] + 0.02 * len(own):
            assert langs[i] == list(texts)[int(np.argmax(plain))] and abs(scores[i] - max(plain) / len(own)) < 0.02


def test_warc_ids_of_any_text(spark):
    ids = ["a\r\nWARC-Type: x", "null", None, "", "é >b", "<urn:x-page:1>", "100%", "a+b c"]
    rows = [(x, f"http://h/{i}", "same" if i % 2 else f"own {i}") for i, x in enumerate(ids)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert Counter(r["page_id"] for r in got) == Counter(ids) and all(r["digest_ok"] in (True, None) for r in got)
    first = min(x for i, x in enumerate(ids) if i % 2 and x is not None)
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(x, first) for i, x in enumerate(ids) if i % 2 and x != first}


def test_rows_of_copies_are_spread(spark):
    """One text has all rows: no range gets much more of them than another, and all come back."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two three four five six' AS text").repartition(3)
    rows = jaccard_join._rows(docs, "doc_id", "text", 5, 40, 1000).filter(f"kind = {jaccard_join.DOC}")
    sizes = [r["count"] for r in rows.groupBy("group").count().collect()]
    assert len(sizes) == 40 and sum(sizes) == 4000 and max(sizes) <= 104
    got = jaccard_join.jaccard_join(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4000)) and {(r["n_shingles"], r["component_id"]) for r in got} == {(2, 0)}
