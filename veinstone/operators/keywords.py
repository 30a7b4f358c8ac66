"""Keyword location maps: where the terms of dictionaries stand in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.text import cleaned_word, cleaned_words, is_case_sensitive
from veinstone.sources.sinks import materialize
from veinstone.sources.star import TERMS


def tokens(docs: DataFrame) -> DataFrame:
    """``document_id, pos, word``: cleaned words, case kept, with their 1-based places; other columns of ``docs`` but ``text`` stay."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.posexplode(cleaned_words(F.col("text"))).alias("at", "raw"))
    return rows.select(*rest, (F.col("at") + 1).alias("pos"), cleaned_word(F.col("raw")).alias("word"))


#: Rows of terms, of their pairs and of a context up to which they are broadcast (about 100 bytes each).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def positions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each place of each term. Terms are broadcast if they are few (``BROADCAST_ROWS``), else joined by their key.

    A term is compared with the upper-cased word; ``IT`` and its parts with the word as it is. Words are single, so a
    term of several words has no places.
    """
    case = is_case_sensitive(F.col("key_word"))
    keyed = terms.withColumn("key", F.concat(F.when(case, "=").otherwise("~"), "key_word"))
    has_case = terms.filter(case).limit(1).count() > 0
    found = tokens(docs)
    if has_case:
        found = found.withColumn("key", F.explode(F.array(F.concat(F.lit("~"), F.upper("word")), F.concat(F.lit("="), "word"))))
    else:
        found = found.withColumn("key", F.concat(F.lit("~"), F.upper("word")))
    return found.join(small(keyed), "key").drop("key", "word")


def hits(places: DataFrame) -> DataFrame:
    """Places gathered to a row for each document and term, with sorted ``locations``, ``frequency`` and ``key_word_hit_id``.

    The id is made of the document's and the term's: the same in every run, without numbering rows. A term has at
    most as many locations as its document has words.
    """
    rest = [c for c in places.columns if c != "pos"]
    return places.groupBy(*rest).agg(F.array_sort(F.collect_list("pos")).alias("locations"), F.count("*").alias("frequency")).withColumn("key_word_hit_id", F.col("document_id") * TERMS + F.col("term_id"))


def containing(words: DataFrame, word: str, terms: DataFrame, term: str) -> DataFrame:
    """Pairs of distinct ``words`` and ``terms`` that they strictly contain, joined by equality: each word is cut into its
    parts of the lengths that terms have."""
    lengths = sorted(r[0] for r in terms.select(F.char_length(term)).distinct().collect())
    n = F.char_length(word)
    cuts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col(word), i, F.lit(k)))
    parts = [F.when(n >= k, cuts(k)).otherwise(F.array()) for k in lengths if k]
    cut = words.select(word, F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("part__")) if parts else words.select(word, F.col(word).alias("part__")).limit(0)
    return cut.join(small(terms), (F.col("part__") == F.col(term)) & (F.col(word) != F.col(term))).drop("part__")


def related_words(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``document_id, dictionary_type, dictionary_id, key_word, related, locations``: words that strictly contain a term and
    aren't terms of its dictionary.

    The comparison runs on the distinct words of all documents, not on every token. The pairs that it finds are
    written, and go to the tokens if they are few, so tokens aren't dealt out by word.
    """
    upper = tokens(docs).select("document_id", "pos", F.upper("word").alias("related")).filter("related <> ''")
    vocabulary = upper.select("related").distinct()
    t = terms.filter(~is_case_sensitive(F.col("key_word"))).select("dictionary_type", "dictionary_id", "key_word")
    pairs = containing(vocabulary, "related", t, "key_word")
    own = t.select("dictionary_type", "dictionary_id", F.col("key_word").alias("related"))
    pairs = materialize(pairs.join(small(own), ["dictionary_type", "dictionary_id", "related"], "left_anti"))
    return upper.join(small(pairs), "related").groupBy("document_id", "dictionary_type", "dictionary_id", "key_word", "related").agg(F.array_sort(F.collect_list("pos")).alias("locations"))


def resolve(related: DataFrame, context: DataFrame) -> DataFrame:
    """``related`` with ``status``: EXCLUDE, INCLUDE or UNKNOWN by ``context`` (``key_word, related, action``); exclusion wins."""
    by = context.groupBy("key_word", "related").agg(F.bool_or(F.col("action") == "EXCLUDE").alias("out"))
    status = F.when(F.col("out").isNull(), "UNKNOWN").when(F.col("out"), "EXCLUDE").otherwise("INCLUDE")
    return related.join(small(by), ["key_word", "related"], "left").withColumn("status", status).drop("out")


def failed_documents(resolved: DataFrame) -> DataFrame:
    """Documents with a related word of unknown status, with how many; they wait for a review."""
    return resolved.filter("status = 'UNKNOWN'").groupBy("document_id", "dictionary_type").agg(F.countDistinct("key_word", "related").alias("unknown_words"))


def include(places: DataFrame, resolved: DataFrame) -> DataFrame:
    """Places of terms with those of their included related words."""
    more = resolved.filter("status = 'INCLUDE'").select("document_id", "dictionary_type", "dictionary_id", "key_word", F.explode("locations").alias("pos"))
    own = places.select("document_id", "dictionary_type", "dictionary_id", "key_word", "pos")
    return own.union(more).distinct()


def merged(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of a document and dictionary that contain each other, merged: for A within B the locations of A and those only B has,
    shown as A. A term without such a partner stays as it is; a chain of three gives three rows.

    Which terms contain each other is a fact of the dictionaries, found once; hits then meet their partners in one
    row for each document and dictionary, which holds a list for each term that the document has.
    """
    key = ["document_id", "dictionary_type", "dictionary_id"]
    named = terms.select("dictionary_type", "dictionary_id", "key_word").distinct()
    outer = named.select(F.col("dictionary_type").alias("type"), F.col("dictionary_id").alias("id"), F.col("key_word").alias("b"))
    pairs = containing(outer.select("b").distinct(), "b", named.select(F.col("key_word").alias("a")).distinct(), "a")
    pairs = pairs.join(outer, "b").join(named.withColumnRenamed("key_word", "a"), "a")
    pairs = pairs.filter((F.col("type") == F.col("dictionary_type")) & (F.col("id") == F.col("dictionary_id")))
    partners = pairs.groupBy("dictionary_type", "dictionary_id").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    rows = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("key_word", "locations"))).alias("hits")).join(F.broadcast(partners), ["dictionary_type", "dictionary_id"], "left")
    rows = rows.withColumn("pairs", F.coalesce(F.filter("pairs", lambda p: F.map_contains_key("hits", p["a"]) & F.map_contains_key("hits", p["b"])), F.array().cast("array<struct<a:string,b:string>>")))
    of = lambda w: F.element_at("hits", w)
    both = F.transform("pairs", lambda p: F.struct(p["a"].alias("key_word"), p["b"].alias("merged_with"), F.concat(of(p["a"]), F.array_except(of(p["b"]), of(p["a"]))).alias("locations")))
    partnered = F.concat(F.transform("pairs", lambda p: p["a"]), F.transform("pairs", lambda p: p["b"]))
    alone = F.transform(F.filter(F.map_keys("hits"), lambda w: ~F.array_contains(partnered, w)), lambda w: F.struct(w.alias("key_word"), F.lit(None).cast("string").alias("merged_with"), of(w).alias("locations")))
    out = rows.select(*key, F.explode(F.concat(both, alone)).alias("m")).select(*key, "m.key_word", "m.merged_with", "m.locations")
    return out.withColumn("frequency", F.size("locations").cast("long"))
