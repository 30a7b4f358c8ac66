"""Language identification by language-bitmask n-gram filters.

The filters of all languages are bit-sliced: one array of cells, and in each cell a bit for every language, so a look-up
of an n-gram's cells and one AND give all languages that may contain it. For each language the bits of a text's n-grams
are counted, the hits that its filter would give by chance are taken off, and the language with most n-grams left wins.

A language contains an n-gram if it is frequent in its learning texts and not much rarer there than in another language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import release

ORDERS = (3, 4)
#: Cells of the filters and look-ups for an n-gram.
CELLS, PROBES = 1 << 20, 2
#: About how many learning texts of each language, the least frequency of an n-gram, and how much rarer than elsewhere it may be.
MAX_TEXTS, LEAST_FREQUENCY, LEAST_RATIO = 3000, 2e-5, 0.2
#: Characters that are looked at together.
CHUNK = 1 << 19
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words in lower case, with a space around each word, and the text of each; repeated ones repeat."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts))
    joined = "  ".join(["", *lowered]) + " "  # at least one space before and after each text
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    owner = np.append(np.repeat(np.arange(len(texts)), sizes + 2), max(len(texts) - 1, 0))
    hashes, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        inner = letter[1 : 1 + last].copy()  # a space may only come first or last
        for i in range(2, n - 1):
            inner &= letter[i : i + last]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(owner[at + 1])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def pieces(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (places, texts) of about ``most`` characters; a longer text goes in several, cut between words where it can be."""
    places: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while t is not None and at < len(t):
            end = min(len(t), at + most)
            if end < len(t) and (cut := t.rfind(" ", at + 1, end)) > 0:
                end = cut
            places.append(i)
            held.append(t[at:end])
            size += end - at
            at = end
            if size >= most:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Filters:
    """Filters of ``langs``: the cells, an array for each 64 languages, and each language's share of set bits to the power of the probes."""

    langs: tuple[str, ...]
    cells: np.ndarray
    chance: np.ndarray

    @staticmethod
    def cells_of(hashes: np.ndarray, count: int) -> list[np.ndarray]:
        mask = np.uint64(count - 1)
        return [(hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)][:PROBES]

    @classmethod
    def build(cls, langs: list[str], grams: list[np.ndarray], count: int = CELLS) -> Filters:
        cells = np.zeros((-(-len(langs) // 64), count), np.uint64)
        for i, g in enumerate(grams):
            for at in cls.cells_of(g, count):
                cells[i // 64, at] |= np.uint64(1 << i % 64)
        share = np.array([float(np.mean(cells[i // 64] >> np.uint64(i % 64) & np.uint64(1))) for i in range(len(langs))])
        return cls(tuple(langs), cells, share**PROBES)

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """For each 64 languages and n-gram the bits of those that may contain it."""
        first, *rest = self.cells_of(hashes, self.cells.shape[1])
        found = self.cells[:, first]
        for at in rest:
            found &= self.cells[:, at]
        return found

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and for each language those in it, less what chance gives."""
        total, hits = np.zeros(len(texts)), np.zeros((len(self.langs), len(texts)))
        for places, held in pieces(texts):
            hashes, owner = ngrams(held)
            whose = np.asarray(places)[owner] if len(owner) else owner
            total += np.bincount(whose, minlength=len(texts))
            found = self.languages(hashes)
            for i in range(len(self.langs)):
                hits[i] += np.bincount(whose[(found[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
        return total, np.maximum(0, hits - total * self.chance[:, None]) / (1 - self.chance[:, None])

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the share of its n-grams that the language contains."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        total, hits = self.count(texts)
        best = hits.argmax(axis=0)
        score = np.clip(hits[best, np.arange(len(texts))] / np.maximum(total, 1), 0, 1)
        known = [has_letter(t) for t in texts]
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> Filters:
    """Learns from the rows with a language whose id has a remainder other than 0.

    Of each language about ``max_texts`` texts are taken, by a hash of their ids. All languages are learned. N-grams are counted where the texts are and summed by Spark; the driver gets those of at least
    ``LEAST_FREQUENCY``, of which a language can have no more than the inverse of that for each order.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & (remainder(F.col(id_col)) != 0)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Filters((), np.zeros((0, 1), np.uint64), np.zeros(0))
    grain = 1 << 30
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(grain, int(grain * max_texts / r["count"]))) for r in sizes], "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", F.lit("learn")), F.lit(grain)) < F.col("share"))
    place = {x: i for i, x in enumerate(langs)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = np.array([place[x] for x in batch.column(1).to_pylist()])
            for places, held in pieces(batch.column(0).to_pylist()):
                hashes, text = ngrams(held)
                lang = owner[np.asarray(places)][text] if len(text) else text
                for bit in np.unique(lang):
                    grams, n = np.unique(hashes[lang == bit], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), bit)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        release()

    grams = sample.select("text", "lang").mapInArrow(counted, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = grams.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("f")).filter(F.col("f") >= LEAST_FREQUENCY).toPandas()
    most = frequent.groupby("gram")["f"].transform("max")
    kept = frequent[frequent["f"] >= LEAST_RATIO * most]
    by = {i: g.to_numpy() for i, g in kept.groupby("lang")["gram"]}
    return Filters.build(langs, [np.asarray(by[i], np.int64).view(np.uint64) if i in by else np.empty(0, np.uint64) for i in range(len(langs))])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, ``lang_pred`` and ``score`` of every row, from whole texts alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Among languages with equally many
    n-grams, also with none, the one with most learning texts wins. Repeated rows and null ids give a row each. No shuffle; the filters are
    broadcast (8 bytes for each of ``CELLS`` and 64 languages).
    """
    known = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = known.value.decide(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "pred__", "score__"])
        release()

    rows = docs.select(F.col(text_col).cast("string").alias("text__"), F.col(id_col).alias("id__"), *(F.col(c).alias(f"keep__{c}") for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", pred__ string, score__ double"
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id__").alias(id_col), *(F.col(f"keep__{c}").alias(c) for c in keep), F.col("pred__").alias("lang_pred"), F.col("score__").alias("score"))


def language_id(docs: DataFrame, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score``; learned from ``learn_from`` (default ``docs``). A null id is never learned from and counts as held out."""
    filters = train(docs if learn_from is None else learn_from, id_col, text_col, lang_col)
    return identify(docs, filters, id_col, text_col).select(id_col, F.coalesce(remainder(F.col(id_col)) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
