"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are the sets to find. The tokens of a window are its shingles of up to three words; all of them must
occur where the window occurs, so one necessary shingle is enough as the prefix, and the rarest over all documents
makes the fewest candidates. Documents' shingles are joined to the prefixes only. A candidate must have room for the
window before and after the shingle (length and positional bounds), then its words are compared with the window's.

Windows have numbers. The join carries those; which items have a window is looked up for what was found, once for each
different set of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import LOWER, UPPER, copied, materialize

#: What separates words in a text whose A-Z have not been lower-cased yet.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window, words of a shingle, and bytes of windows (with ``ROW`` more for each) up to which they are broadcast.
WINDOW, SHINGLE, BROADCAST_BYTES, ROW = 10, 3, 100_000_000, 150
#: Sets of windows, and ids of items in them, up to which they are broadcast (about 150 and 30 bytes each).
BROADCAST_SETS, BROADCAST_IDS = 200_000, 1_000_000


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _key(word: Column, words: Column, pos: Column, k: int) -> Column:
    """Hash of the ``k`` words from ``pos``. ``lower`` folds more than A-Z does: equal windows have equal keys, and the words are compared later."""
    return F.xxhash64(F.lit(k), F.lower(word), *(F.lower(F.get(words, pos + F.lit(i))) for i in range(1, k)))


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, window) of the items: ``item`` (as a string), ``window`` (words joined by a space) and ``len``.

    An item of fewer words than ``size`` is one window, one without words none.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), split_words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    words = words.select("item", F.transform("words", _fold).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), size).alias("w"))
    return each.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).distinct()


def _shingles(wins: DataFrame) -> DataFrame:
    """A row for each window and shingle in it: ``wid, window, len, off, key``."""
    w = wins.withColumn("w", F.split("window", " ")).withColumn("k", F.least("len", F.lit(SHINGLE)))
    w = w.select("wid", "window", "len", "w", "k", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off"))
    keys = [F.when(F.col("k") == k, _key(F.get("w", F.col("off")), F.col("w"), F.col("off"), k)) for k in range(1, SHINGLE + 1)]
    return w.select("wid", "window", "len", "off", F.coalesce(*keys).alias("key"))


def _positions(docs: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """A row for each shingle of a document, with its ``pos`` and ``key``, besides one at ``pos`` -1 without a key for the document itself."""
    at = docs.select(*keep, "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("pos"))
    keys = [F.when(F.col("pos") >= 0, _key(F.get("words", F.col("pos")), F.col("words"), F.col("pos"), k)) for k in sizes]
    if len(keys) == 1:
        return at.select(*keep, "words", "pos", keys[0].alias("key"))
    return at.select(*keep, "words", "pos", F.explode(F.array(*keys)).alias("key"))


def covered(hits: Column) -> Column:
    """Places inside the spans (start, len) of ``hits``: each span counts what is behind the end of those before it."""
    by_start = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["len"]).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, h: Column) -> Column:
        more = F.greatest(h["end"] - F.greatest(h["start"], a["end"]), F.lit(0))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["end"], h["end"]).alias("end"))

    return F.aggregate(by_start, zero, step)["n"]


def _hits(words: DataFrame, ks: list[int], prefixes: DataFrame) -> DataFrame:
    """A row (``id, print, n_words, start, len, wid``) for each place of a window, and for each document one with a null ``start``. Texts aren't moved."""
    base = words.withColumn("n_words", F.size("words"))
    found = _positions(base, ks, ["id", "print", "n_words"]).join(F.broadcast(prefixes), "key", "left")
    start = F.col("pos") - F.col("off")
    fits = F.col("window").isNotNull() & (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = _fold(F.array_join(F.slice("words", start + 1, F.col("len")), " ")) == F.col("window")
    document = F.col("pos") == -1
    found = found.filter(document | (fits & same))
    return found.select("id", "print", "n_words", F.when(~document, start).alias("start"), "len", "wid")


def _hits_by_key(words: DataFrame, ks: list[int], prefixes: DataFrame) -> DataFrame:
    """The same for more prefixes than may be broadcast: narrow rows of the documents' shingles are joined with them by key, and
    what has room comes back to the texts that have it, to have the words compared."""
    base = words.withColumn("n_words", F.size("words"))
    places = _positions(base, ks, ["print", "n_words"]).filter("pos >= 0").select("print", "n_words", "pos", "key")
    room = places.join(prefixes.select("key", "wid", "off", "len"), "key").withColumn("start", F.col("pos") - F.col("off"))
    room = materialize(room.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).select("print", "wid", "start").distinct())
    texts = base.select("print", "words").join(room.select(F.col("print").alias("held")).distinct(), F.col("print") == F.col("held"), "left_semi")
    both = room.join(texts.dropDuplicates(["print"]), "print").join(prefixes.select("wid", "window", "len"), "wid")
    same = _fold(F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ")) == F.col("window")
    found = both.filter(same).select("print", "start", "len", "wid")
    docs = base.select("id", "print", "n_words")
    places = docs.distinct().join(found, "print").select("id", "print", "n_words", "start", "len", "wid")
    return docs.select("id", "print", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("len", "int"), ("wid", "long")))).unionByName(places)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``, and ``items``, the ids found.

    A word is hit inside an occurrence of a window of ``size`` consecutive words of an item. Words are compared with
    A-Z in lower case. Null and empty texts have no words and aren't contaminated. Repeated rows give equal rows, rows
    of one id with different texts are judged apart (by 64-bit hashes of the texts). Items without words have no
    windows; equal items are all named, null ids are not.

    Two passes over the texts, one for the shingles' counts and one for the windows, whatever the number of windows.
    Prefixes of up to ``broadcast_bytes`` are broadcast, and texts stay where they are read; more are joined by key.
    """
    pairs = materialize(windows(items, size, item_id_col, item_text_col))
    found = materialize(pairs.groupBy("window", "len").agg(F.count("*").alias("in_items")).withColumn("wid", F.monotonically_increasing_id()))
    of_items = pairs.filter("item IS NOT NULL").join(found.select("window", "wid"), "window").select("wid", "item")
    sizes = found.groupBy(F.least("len", F.lit(SHINGLE)).alias("k")).agg(F.sum(F.octet_length("window") + ROW).alias("bytes")).collect()
    few, ks = sum(r["bytes"] for r in sizes) <= broadcast_bytes, sorted(r["k"] for r in sizes) or [SHINGLE]
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"), split_words(F.col(text_col)).alias("words"))
    tokens = _shingles(found)

    # the rarest shingle of each window over all documents; a window with a shingle that no document has is nowhere
    asked = tokens.select("key").distinct()
    counts = _positions(words, ks, []).select("key").join(F.broadcast(asked) if few else asked, "key").groupBy("key").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "key", "left").groupBy("wid", "window", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "key")).alias("rarest"))
    prefixes = materialize(ranked.filter("rarest.n > 0").select("wid", "window", "len", "rarest.off", "rarest.key"))

    rows = (_hits if few else _hits_by_key)(words, ks, prefixes)
    # several sizes of shingles give several rows for a document: each has no key, and all are divided out
    each = len(ks) if few else 1
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "len", "wid"))
    made = rows.groupBy("id", "print", "n_words").agg((F.count_if(F.col("start").isNull()) / F.lit(each)).cast("long").alias("copies"), F.collect_set(hit).alias("hits"))
    made = materialize(made.withColumn("wids", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["wid"])))).withColumn("named", F.when(F.size("wids") > 0, F.md5(F.array_join("wids", ",")))))
    # the items of each different set of windows
    sets = made.filter("named IS NOT NULL").groupBy("named").agg(F.first("wids").alias("wids")).select("named", F.explode("wids").alias("wid"))
    named = sets.join(of_items, "wid").groupBy("named").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = materialize(named.select(F.col("named").alias("set"), "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    n_sets, n_ids = named.agg(F.count("*"), F.sum("n_items")).first()
    named = F.broadcast(named) if n_sets <= BROADCAST_SETS and (n_ids or 0) <= BROADCAST_IDS else named
    made = copied(made, "copies", "copy").withColumn("n_hit", covered(F.col("hits")).cast("long")).join(named, F.col("named") == F.col("set"), "left")
    return made.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
