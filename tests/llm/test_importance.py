"""Importance resampling against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.llm import importance
from veinstone.llm.queries import QUERIES


def plain_grams(t):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[0-9a-z_\x80-\U0010FFFF]+|[^0-9a-z_\x80-\U0010FFFF\x20\x09-\x0D]+", folded)
    return w + list(zip(w, w[1:]))


def plain_weights(docs, good):
    """Log weights with a bucket for each gram: the operator's, if no two grams share one."""
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(plain_grams(t))
        target.update(plain_grams(t) if i in good else [])
    return raw, target


def test_grams(monkeypatch):
    texts = ["Ab ab, c!! d", None, "", " \n", "é日本 x_1\tAB", "one " * 50]
    bucket, owner = importance.ngrams(texts, 1 << 40)
    assert [int((owner == i).sum()) for i in range(len(texts))] == [len(plain_grams(t)) for t in texts]
    want, got = [[g for g in plain_grams(t) if isinstance(g, str)] + [g for g in plain_grams(t) if not isinstance(g, str)] for t in texts], {}
    for i, grams in enumerate(want):
        for g, b in zip(grams, bucket[owner == i], strict=True):
            assert got.setdefault(g, b) == b
    assert len(set(got.values())) == len(got)
    data = ("alpha beta, gamma\n" * 300 + "z" * 500).encode()
    whole, cut = importance.tokens(data), importance.tokens(data, 100)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_importance(spark):
    rng = np.random.default_rng(2)
    clean, junk = ["the", "river", "Runs", "by", "town", "é"], ["$$$", "win!!", "click", "free", "now", "the"]
    text = lambda words, n: " ".join(rng.choice(words, n))
    docs = [(i, text(clean if i % 4 else junk, int(rng.integers(5, 60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, " \n"), (None, text(clean, 30)), (None, text(junk, 30)), (303, text(clean, 20)), (303, text(junk, 20)), (304, "the " * 200_000)] + [(305, text(clean, 10))] * 3
    labels = [(i, int(i % 4 > 0)) for i in range(0, 100)] + [(1, None), (None, 1), (9999, 1), (5, 0), (5, 1)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, log_weight double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    good = {i for i in range(100) if i % 4 and i != 5}
    got = importance.importance_resampling(df, lab, buckets=1 << 20).collect()
    raw, target = plain_weights(docs, good)
    a, b = math.log(sum(target.values()) + (1 << 20)), math.log(sum(raw.values()) + (1 << 20))
    want = Counter((i, len(plain_grams(t)), round(sum(math.log(target[g] + 1) - a - math.log(raw[g] + 1) + b for g in plain_grams(t)), 2)) for i, t in docs)
    assert Counter((r["doc_id"], r["n_grams"], round(r["log_weight"], 2) + 0.0) for r in got) == Counter({(i, n, w + 0.0): c for (i, n, w), c in want.items()})
    # 74 of 100 labelled documents are good, and three rows have no token
    held = [r for r in got if r["n_grams"]]
    k = round((len(docs) - 3) * 74 / 100)
    assert sum(r["kept"] for r in got) == k and not any(r["kept"] for r in got if not r["n_grams"])
    assert {r["gumbel_key"] for r in held if r["kept"]} == set(sorted((r["gumbel_key"] for r in held), reverse=True)[:k])
    assert len({r["gumbel_key"] for r in got if r["doc_id"] == 305}) == 3
    again = importance.importance_resampling(df.repartition(7), lab, buckets=1 << 20).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sum(r["kept"] for r in importance.importance_resampling(df, lab, k=7).collect()) == 7
    nothing = importance.importance_resampling(df, lab.limit(0)).collect()
    assert all(r["log_weight"] == 0 and r["kept"] == (r["n_grams"] > 0) for r in nothing)
    assert importance.importance_resampling(df.limit(0), lab).count() == 0


def test_noise_is_gumbel(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    keys = [r["gumbel_key"] for r in importance.importance_resampling(df, spark.createDataFrame([], "doc_id long, quality int")).collect()]
    assert np.mean(keys) == pytest.approx(0.5772, abs=0.04) and np.var(keys) == pytest.approx(math.pi**2 / 6, abs=0.1)


@pytest.mark.parametrize("k", [1, 500, 999, 1700, 3000])
def test_kth_largest(spark, k):
    values = [0.5] * 1000 + [float(x) for x in np.random.default_rng(1).normal(0, 1, 1999)] + [1e9]
    got = importance.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k)
    v = sorted(values, reverse=True)[k - 1]
    assert got == (v, sum(x > v for x in values), values.count(v))


def test_registered(spark):
    made = QUERIES["op2_importance_resampling"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = made.join(labels, "doc_id").collect()
    keeps = [np.mean([r["kept"] for r in rows if r["quality"] == q]) for q in (0, 1)]
    assert keeps[1] > keeps[0] + 0.2
