"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules come first. The other rules reject a document whose measure lies above a cutoff. In each stratum
(language) labelled good documents are dealt into two halves by a hash of their text. The first half makes a path of
rule sets, from lenient to strict: for each share of ``PATH``, every measure's strictest cutoff of its grid that rejects
at most that share of it. The second half, the holdout, tests the sets in that order while the exact binomial
(Clopper-Pearson) upper bound of the share of good documents that a set rejects, by whichever measure, is at most
``alpha``; the last set before the first failure counts. The path doesn't depend on the holdout, so the order of the
tests needs no correction; the level ``delta`` is divided by the number of strata. So with probability 1 - ``delta``, in
every stratum the cutoffs together reject at most a share ``alpha`` of good documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import let, materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Grids of cutoffs, strict first.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "exclaim_share": (0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "caps_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "mean_word": (5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 14.0),
}
#: Shares of the first half that a measure may reject, lenient first.
PATH = (0.0025, 0.005, 0.01, 0.02)


def _windows(words: Column, size: int) -> Column:
    """Hashes of the windows of ``size`` (a power of two) consecutive words, by doubling."""

    def double(width: int) -> Callable[[Column], Column]:
        return lambda hashes: F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + F.lit(width))))

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < size:
        hashes, width = let(hashes, double(width)), 2 * width
    return hashes


def repeat_words(words: Column, size: int = 8) -> Column:
    """Words in windows of ``size`` words that are found twice or more among ``words``.

    Windows are put next to their equals by sorting (hash, place); places of windows that have an equal neighbour are
    sorted again, and each covers the words up to the next such place, ``size`` at most. n log n of the text's words.
    """

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        equal = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: (F.when(i > 0, equal(x, F.get(pairs, i - 1))).otherwise(False)) | equal(x, F.get(pairs, i + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, places), covered))

    full = let(words, lambda w: let(_windows(w, size), lambda h: F.slice(h, F.lit(1), F.size(w) - F.lit(size - 1))))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(full, count))


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Counts and measures of whole texts: ``id, stratum, print`` (a hash of the text), ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and those of ``GRIDS``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    lines = let(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    per_words = let(
        F.array_remove(F.split("text", SPACES), ""),
        lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeat")),
    )
    caps = F.size(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{3,}"), F.lit(0)))
    out = base.select(
        "id", "stratum", F.md5("text").alias("print"), per_words.alias("w"), lines.alias("l"), caps.alias("caps"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))).alias("exclaims"),
    )
    one = F.lit(1)
    return out.select(
        "id", "stratum", "print", F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"), "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.repeat").cast("long").alias("n_repeat_words"),
        (F.col("n_symbols") / F.greatest("w.chars", one)).alias("symbol_share"), (F.col("exclaims") / F.greatest("w.n", one)).alias("exclaim_share"), (F.col("caps") / F.greatest("w.n", one)).alias("caps_share"),
        (F.col("l.dup") / F.greatest("l.n", one)).alias("dup_line_share"), (F.col("w.repeat") / F.greatest("w.n", one)).alias("repeat_share"), (F.col("w.chars") / F.greatest("w.n", one)).alias("mean_word"),
    )


def allowed(n: Column, alpha: float, level: Column) -> Column:
    """The most rejections among ``n`` good documents at which the exact upper bound of the share is still at most ``alpha``: the
    largest x with P(Binomial(n, alpha) <= x) <= ``level``; -1 if even none is too many."""
    odds = math.log(alpha) - math.log1p(-alpha)
    steps = F.sequence(F.lit(0), F.ceil(n * F.lit(alpha)).cast("int"))
    start = F.struct(F.lit(-1).alias("x"), F.lit(0.0).alias("cdf"), (n * F.lit(math.log1p(-alpha))).alias("log_p"))

    def step(a: Column, k: Column) -> Column:
        cdf = a["cdf"] + F.exp(a["log_p"])
        later = a["log_p"] + F.log(F.greatest((n - k) / (k + F.lit(1)), F.lit(1e-300))) + F.lit(odds)
        return F.struct(F.when(cdf <= level, k).otherwise(a["x"]).alias("x"), cdf.alias("cdf"), later.alias("log_p"))

    return F.aggregate(steps, start, step)["x"]


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """A row for each stratum with good documents in both halves: ``stratum``, ``n_path`` and ``n_held`` (documents of the halves),
    ``allowed``, ``steps`` (sets that are proved) and a cutoff for each measure, null where none is.

    A document counts as good if none of its labels is below 1; labels that are null, or of no document, don't count.
    Equal texts of a stratum count once, since the bound takes documents to be drawn independently.
    """
    good = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("q")).filter("q >= 1").select("id")
    known = measured.join(good, "id").filter(F.col("stratum").isNotNull() & (F.col("n_words") > 0))
    known = materialize(known.dropDuplicates(["stratum", "print"]).select("stratum", "print", *GRIDS))
    hits = [F.count_if(F.col(m) > c).alias(f"{m}_{i}") for m, grid in GRIDS.items() for i, c in enumerate(grid)]
    path = known.filter("print < '8'").groupBy("stratum").agg(F.count("*").alias("n_path"), *hits)
    strictest = lambda m, share: F.coalesce(*(F.when(F.col(f"{m}_{i}") <= share * F.col("n_path"), F.lit(c)) for i, c in enumerate(GRIDS[m])))
    path = materialize(path.select("stratum", "n_path", *(strictest(m, share).alias(f"cut_{m}_{k}") for m in GRIDS for k, share in enumerate(PATH))))
    rejected = lambda k: reduce(lambda a, b: a | b, (F.coalesce(F.col(m) > F.col(f"cut_{m}_{k}"), F.lit(False)) for m in GRIDS))
    held = known.filter("print >= '8'").join(path, "stratum").groupBy("stratum").agg(F.count("*").alias("n_held"), *(F.count_if(rejected(k)).alias(f"x_{k}") for k in range(len(PATH))))
    total = held.agg(F.count("*").alias("n_strata"))
    held = held.join(F.broadcast(total)).withColumn("allowed", allowed(F.col("n_held"), alpha, F.lit(delta) / F.greatest("n_strata", F.lit(1))))
    steps = F.coalesce(*(F.when(F.col(f"x_{k}") > F.col("allowed"), F.lit(k)) for k in range(len(PATH))), F.lit(len(PATH)))
    chosen = [F.get(F.array(*(F.col(f"cut_{m}_{k}") for k in range(len(PATH)))), F.col("steps") - 1).alias(f"cut_{m}") for m in GRIDS]
    return held.withColumn("steps", steps).join(path, "stratum").select("stratum", "n_path", "n_held", "allowed", "steps", *chosen)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.06, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row, with the number of ``cut_rules`` that reject it.

    Null and empty texts have no words and fail the base. Rows of a stratum that is null or has too few labels for any
    proof (less than log(delta / strata) / log(1 - alpha) good texts in the holdout) are judged by the base alone. A measure that
    equals its cutoff passes. Repeated rows give equal rows.

    Measures are computed once and written to the shared folder: narrow rows, read for the cutoffs and for the
    verdicts. Only labelled rows' measures are shuffled; the cutoffs (a narrow
    row for each stratum) are written too, so Spark knows their size when it chooses the join.
    """
    measured = materialize(measures(docs, id_col, text_col, stratum_col))
    cuts = materialize(cutoffs(measured, labels, alpha, delta))
    out = measured.join(cuts, "stratum", "left")
    rejects = [F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False)).cast("int") for m in GRIDS]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), sum(rejects[1:], rejects[0]).alias("cut_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("cut_rules") == 0)).withColumnRenamed("id", id_col)
