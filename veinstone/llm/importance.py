"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens of one and of two are hashed to buckets. Target text (documents labelled as good) and raw text (all documents) each
have a generative model, the shares of the buckets. A document's log weight is the sum over its n-grams of the log of
target share by raw share. Gumbel noise added to log weights makes the k largest sums a sample without replacement in
proportion to the weights. The k-th largest is found by histograms, each inside one bin of the last, so nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import copied, materialize
from veinstone.llm.shingles import _BASE, _FOLD, _powers, mix

#: Buckets of n-grams, bytes that are hashed together, bins of a histogram, and ids of good documents up to which they are broadcast.
BUCKETS, CHUNK, BINS, BROADCAST_ROWS = 10_000, 1 << 21, 1024, 500_000
SPACES = b" \t\n\x0b\x0c\r"
#: 0 white space, 1 letters and digits (all beyond ASCII are), 2 other characters.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of letters and digits, or of other characters; A-Z in lower case) of ``data`` and where each starts."""
    kind = _KIND[data]
    edges = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]))
    starts, ends = edges[:-1], edges[1:]
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(_FOLD[data].astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), dtype=np.uint64)))
    back = _powers(len(data) + 1, pow(_BASE, -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def tokens(data: bytes, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of all tokens of ``data``, of which about ``chunk`` bytes, cut at white space, are looked at together."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(at + chunk, len(data))
        while end < len(data) and data[end] not in SPACES:
            end += 1
        h, s = _hashed(np.frombuffer(data, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of one or two tokens, and the place of its text; repeated ones repeat."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    single, starts = tokens(b"\n".join(encoded))
    owner = np.searchsorted(np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1), starts, "right")
    within = owner[1:] == owner[:-1]
    double = mix(mix(single[:-1] * np.uint64(_BASE)) + single[1:])[within]
    return (np.concatenate((single, double)) % np.uint64(buckets)).astype(np.int64), np.concatenate((owner, owner[:-1][within]))


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in order, in groups of about ``CHUNK`` characters."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "") + 16
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all ``texts`` (one column) are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in _groups(batch.column(0)):
                total += np.bincount(ngrams(held, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target's by the raw text's share of each bucket, one added to each count; zeros if there is no target."""
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda n: np.log(n + 1) - np.log(n.sum() + len(n))
    return share(target) - share(raw)


def kth_largest(rows: DataFrame, col: str, k: int) -> tuple[float, int, int]:
    """The ``k``-th largest of ``col`` (doubles, none null), how many are larger and how many are equal to it. Each round counts the bins of one bin."""
    low, high, n = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    above = 0
    while low < high:
        place = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        held = rows.filter(F.col(col).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()
        for r in sorted(held, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    return low, above, n


def importance_resampling(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """``id_col, n_grams, log_weight, gumbel_key, kept`` of every row: ``kept`` are the ``k`` rows with the largest keys.

    The target is every document none of whose labels is below 1; labels that are null, or of no document, don't count.
    ``k`` is by default the share of the labelled documents that are good, of all rows with a token; without any label
    weights are 1 and all such rows are kept. Null texts and those without a token have a log weight of 0, no key, and
    aren't kept. Noise is a hash of ``seed``, id, text and the number of the copy: repeated rows and null ids are drawn
    each on its own, and the same rows give the same result however they are dealt out.

    Whole texts are read for the raw model and for the weights, and those of good documents for the target; texts are only
    shuffled if there are more than ``BROADCAST_ROWS`` good ids. The driver gets ``buckets`` counts and ``BINS`` bins.
    """
    text = F.col(text_col).cast("string")
    judged = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("q"))
    judged = materialize(judged)
    good = judged.filter("q >= 1").select("label_id")
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    target = counts(rows.join(good, F.col("id") == F.col("label_id"), "left_semi").select("text"), buckets)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(target, counts(rows.select("text"), buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [np.empty(0, np.int64)], [np.empty(0)]
            for held in _groups(batch.column(0)):
                bucket, owner = ngrams(held, buckets)
                sizes.append(np.bincount(owner, minlength=len(held)))
                sums.append(np.bincount(owner, ratios.value[bucket], len(held)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums))], names=["id", "print", "n_grams", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    weighed = rows.select("text", "id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")).mapInArrow(weigh, f"id {kind}, print long, n_grams long, log_weight double")
    copies = weighed.groupBy("id", "print", "n_grams").agg(F.first("log_weight").alias("log_weight"), F.count("*").alias("copies"))
    draw = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "print", "copy")
    even = (F.shiftrightunsigned("draw", 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    key = F.when(F.col("n_grams") > 0, F.col("log_weight") - F.log(-F.log(even)))
    made = copied(materialize(copies), "copies", "copy").withColumn("draw", draw).select("id", "n_grams", "log_weight", "draw", key.alias("gumbel_key"))

    held = made.filter("gumbel_key IS NOT NULL")
    n = held.count()
    if k is None:
        labelled, well = rows.select("id").join(judged, F.col("id") == F.col("label_id")).agg(F.count("*"), F.count_if(F.col("q") >= 1)).first()
        k = (2 * n * well + labelled) // (2 * labelled) if labelled else n
    k = min(k, n)
    kept = F.lit(False)
    if k > 0:
        least, above, equal = kth_largest(held, "gumbel_key", k)
        kept = F.col("gumbel_key") >= least
        if above + equal > k:  # equal keys: the larger draws
            last = held.filter(F.col("gumbel_key") == least).orderBy(F.desc("draw")).limit(k - above).agg(F.min("draw")).first()[0]
            kept = (F.col("gumbel_key") > least) | ((F.col("gumbel_key") == least) & (F.col("draw") >= last))
    return made.select(F.col("id").alias(id_col), "n_grams", "log_weight", "gumbel_key", F.coalesce(kept, F.lit(False)).alias("kept"))
