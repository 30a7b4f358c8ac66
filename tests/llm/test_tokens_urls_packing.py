import zlib

import numpy as np
import pytest

from veinstone.llm import packing, token_counts, url_filters
from veinstone.llm.queries import URL_RULES, vocabulary

TEXTS = [None, "", " ", "\n", "a", " a", "a ", "\na", "a\n", "a\nb", "a \nb", "a\n b", "a  b", "\n\nword\n\nword", "word.\nNext one's 123 x", "▁x ▁", "tab\there", "a\t \nb", "nbsp\xa0 x", "\x1c.\x1ca",
         "<s> </s> <unk>", "x<|endoftext|>y <|endoftext|>", "日本語 テキスト é à", "word " * 3000, "z" * 5000, "🙂🙂 ok", "\r\nline\r\n", "  \n\n  two", "a\x85b", "\x00 x"]


def corpus():
    import duckdb

    return TEXTS + [r[0] for r in duckdb.connect().execute("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]


def test_counts_equal_library():
    import sentencepiece

    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    proof = token_counts.prove(model)
    assert proof.cuts and len(proof.words) > 10_000
    counter, sp = token_counts.Counter(model, proof), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in corpus() * 2:
        assert counter.count(text) == len(sp.encode(text or "")), repr(text)[:80]
    whole = token_counts.Counter(model, token_counts.Proof(False, frozenset()))
    assert whole.count("a b") == len(sp.encode("a b"))


def test_counts_query_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "x"), (1, "a b", "x"), (2, "", None)], "doc_id long, text string, n_tokens string")
    rows = token_counts.token_counts(df, vocabulary("piece_bpe_32k.model"), limit=1).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 3, 2, True), (None, 0, 0, False), (1, 3, 2, True), (2, 0, 0, False)], key=str)
    assert token_counts.token_counts(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_ids_equal_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(open(path, "rb").read())
    for text in corpus() * 2:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == (tok.encode(text, add_special_tokens=False).ids if text else []), repr(text)[:80]


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(0, [5, 300, 2049, 9000, 3, 2][seed], 400)] + [2048, 4096, 1, 0]
    seen, windows = {i: [] for i in range(len(lengths))}, packing.plan(lengths)
    for w in windows:
        assert 0 < w.used <= w.size and w.used == sum(p[2] for p in w.pieces)
        for doc, start, n in w.pieces:
            seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[doc]):
            assert start == at and m > 0
            at += m
        assert at == n
    assert sum(w.used < w.size for w in windows) <= 1 + sum(lengths) // 2048 // 50
    ids = sum(lengths)
    assert sum(w.size if w.used == w.size else 2048 for w in windows) - ids <= 4096


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, offset int").repartition(3)
    rows = [r.asDict() for r in packing.pack(df, path, with_ids=True).collect()]
    seqs = {}
    for i, text in enumerate(TEXTS):
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == (tok.encode(text, add_special_tokens=False).ids if text else []) + [1]
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= s[0]["tier"] <= 2048
    again = packing.pack(df, path, with_ids=True).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in packing.pack(df, path, with_ids=True).collect())
    assert packing.pack(df.limit(0), path).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Org/x", "http://example.org/es/1", "http://sub.example.org/en/123?x", "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/fr", "http://com/de/#a", "http://x.net/de/",
            "http://x.org", "http://x.org?u=http://y.com/de/", "http://ÀB.com/de/", "http://user@x.com:80/de/", "a://b://c.com/de/", "http://.org/", "http://a..org/"]
    df = spark.createDataFrame([(i, u, "allow") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filters.url_filters(df, URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        body = rest.split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in body.split("/")[0])
        path = body[len(host) :]
        best = max((r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == ((best[1] + best[2], best[0]) if best else (None, "allow")), u


def test_url_collisions(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda s: len(s))
    stem, _ = url_filters.build([("block", "ab.c", "/"), ("allow", "xy.z", "/"), ("block", "q.rs", "/")], str(tmp_path))
    array = url_filters.DigestArray(str(tmp_path / stem))
    assert [array.string(int(k)) if k >= 0 else None for k in array.find([b"xy.z/", b"q.rs/", b"no.o/", b"a"])] == [b"xy.z/", b"q.rs/", None, None]


def test_merges_are_proved(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = open(vocabulary("byte_bpe_50k.json"), "rb").read()
    assert packing.plain(spec)
    conf = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None}
    conf["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    letters = list(packing._byte_letters())
    vocab = {c: i for i, c in enumerate(letters)}
    make = lambda merges: json.dumps(conf | {"model": model | {"vocab": vocab | {a + b: 256 + i for i, (a, b) in enumerate(merges)}, "merges": [list(m) for m in merges]}}).encode()
    good, bad = make([("a", "b"), ("b", "c"), ("ab", "c")]), make([("b", "c"), ("a", "b"), ("ab", "c")])  # "abc" never comes out of the second
    assert packing.plain(good) and not packing.plain(bad)
    library = Tokenizer.from_str(bad.decode())
    assert np.frombuffer(packing.Library(bad).encode("abc abab"), "<u4").tolist() == library.encode("abc abab").ids
    assert packing.Encoder(good).encode("abc abab") == packing.Library(good).encode("abc abab")
    assert not packing.plain(json.dumps(json.loads(good) | {"normalizer": {"type": "Lowercase"}}).encode())


def test_pack_with_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "plain", lambda spec: False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:20])], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, packing.pack(df, vocabulary("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    slow = rows()
    monkeypatch.undo()
    assert rows() == slow


def test_url_edges(spark):
    schema = "page_id long, url string, host int"
    long = "https://a.Example.ORG/en/" + "x" * 1_000_000
    rows = [(1, long, 1), (1, long, 1), (None, "http://b.com/fr/", 1), (2, None, 1), (3, "", 1), (4, "://", 1), (5, "x://." + "a." * 300 + "org/", 1)]
    got = url_filters.url_filters(spark.createDataFrame(rows, schema), URL_RULES).collect()
    assert sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in got if r["rule"]) == [("1", "org/", "allow"), ("1", "org/", "allow"), ("5", "org/", "allow"), ("None", "com/fr/", "allow")]
    assert len(got) == len(rows) and url_filters.url_filters(spark.createDataFrame([], schema), URL_RULES).count() == 0


def test_url_rules_of_very_many_lengths(spark):
    rules = [("block", "a.org", "/" + "p" * n) for n in range(2000)]
    rows = [(n, f"http://a.org/{'p' * n}{'q' * (n % 2)}") for n in (0, 1, 2, 700, 1999, 2500)]
    got = {r["page_id"]: r["rule"] for r in url_filters.url_filters(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {n: "a.org/" + "p" * min(n, 1999) for n, _ in rows}


def test_urls_of_very_long_hosts(spark):
    long = "http://" + "a." * 400_000
    urls = [long + "org/x", long + "example.org/en/12", long + "org", long, "http://" + "." * 400_000 + "com/de/", "http://" + "b" * 800_000 + ".com/fr/1", "http://example.org" + "/es" * 300_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.url_filters(df, URL_RULES).select("page_id", "rule", "verdict").collect()}
    assert [got[i] for i in range(7)] == [("org/", "allow"), ("example.org/en/1", "block"), (None, "allow"), (None, "allow"), ("com/de/", "block"), ("com/fr/", "allow"), ("example.org/es/", "block")]


@pytest.mark.parametrize("longest", [0, 3, 6, 100])
def test_candidates_up_to_a_length(longest):
    for host in ("", "a", ".a", "a.", "a..b", "ab.c.de", "abc.de.f.", "..."):
        ends = [host[i:] for i in range(len(host)) if not i or host[i - 1] == "."]
        want = [(h + "/xyz"[:n]).encode() for h in ends for n in (3, 1, 0) if len(h) + n <= longest]
        assert list(url_filters.candidates(host, "/xyz", [0, 1, 3, 9], longest)) == want
