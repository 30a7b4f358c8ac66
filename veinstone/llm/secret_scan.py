"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams. The index holds, for each trigram that some query
names, the sorted list of the texts (64-bit hashes) that contain it, in segments of a bounded number of texts. A rule's
candidates are the union, over the alternatives of its query, of the intersections of their trigrams' lists. Only
candidates are verified by the rule's expression; rules without a mandatory trigram scan all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import let, materialize
from veinstone.llm.trigrams import ANY, Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. Patterns are of the part that Java and Python share."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,512}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
)
RULES = BASE + MORE
MARK = "[SECRET]"
#: About how many texts have their postings in one segment of the index, candidates up to which they are broadcast (about 100 bytes each), and characters of a text's blocks.
SEGMENT, BROADCAST_ROWS, BLOCK = 50_000, 500_000, 4096
#: Trigrams of an alternative that the index holds, and letters by how usual they are; others are the least usual.
TERM, LETTERS = 2, "etaoinshrdlcumwfgypbvkjxqz"
#: Elements that a running sum or maximum gathers one by one before it goes on with the next so many.
STRIDE = 256
SPANS = "array<struct<start:int,order:int,end:int>>"


def running(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """Each element of an array of numbers, none below 0, joined with all before it (sum or greatest).

    An array that grows in an aggregate is copied each time, so elements are gathered ``STRIDE`` at a time, and what
    the strides add to the later ones after that.
    """

    def grown(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))

        def step(a: Column, x: Column) -> Column:
            return let(joined(a["last"], x), lambda v: F.struct(v.alias("last"), F.array_append(a["all"], v).alias("all")))

        return F.aggregate(part, zero, step)["all"]

    def strides(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int")), lambda k: grown(F.slice(v, k * STRIDE + 1, STRIDE)))

    def whole(parts: Column) -> Column:
        before = F.array_prepend(grown(F.transform(parts, lambda p: F.element_at(p, -1))), F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.slice(before, F.lit(1), F.size(parts)).alias("b")), lambda x: F.transform(x["p"], lambda v: joined(x["b"], v))))

    return let(values, lambda v: F.when(F.size(v) <= STRIDE, grown(v)).otherwise(let(strides(v), whole)))


def runs(rule: Rule) -> str:
    """The rule's pattern; one that is a run of a single class gets the least length, since longest runs don't overlap."""
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.least and not rule.group and re.fullmatch(r"\[[^][\\]+\]\+", rule.pattern) else rule.pattern


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches, leftmost and not overlapping, in code points.

    Matches and the text between them come from one expression each; ends are running sums of their lengths.
    """
    size = lambda a: F.transform(a, lambda x: F.char_length(x))
    found = lambda g: size(F.regexp_extract_all(text, F.lit(runs(rule)), F.lit(g)))
    between = size(F.split(text, runs(rule), -1))
    each = F.arrays_zip(between.alias("gap"), found(0).alias("all"), *([found(rule.group).alias("part")] if rule.group else []))

    def placed(each: Column) -> Column:
        ends = running(F.transform(each, lambda x: x["gap"] + F.coalesce(x["all"], F.lit(0))), lambda a, b: a + b)
        spans = F.zip_with(each, ends, lambda x, end: F.struct((end - x["all"]).alias("start"), F.lit(order).alias("order"), end.alias("end"), x["part" if rule.group else "all"].alias("part")))
        return F.transform(F.filter(spans, lambda s: s["part"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))

    return let(each, placed)


def index_query(pattern: str) -> Query:
    """The pattern's trigram query with the ``TERM`` trigrams of the least usual letters of each alternative: weaker, and cheaper to index."""
    usual = lambda t: (-sum(LETTERS.find(c) % 30 for c in t), t)
    return frozenset(frozenset(sorted(term, key=usual)[:TERM]) for term in trigram_query(pattern))


def postings(texts: DataFrame, trigrams: list[str], segments: int) -> DataFrame:
    """``segment, trigram, prints``: for each trigram (its place) the sorted ``print``s of a segment's texts that contain it in lower case."""
    holds = let(F.lower("text"), lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)))))
    rows = texts.select("print", F.pmod("print", F.lit(segments)).alias("segment"), F.explode(holds).alias("trigram"))
    return rows.groupBy("segment", "trigram").agg(F.array_sort(F.collect_set("print")).alias("prints"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...], segment: int = SEGMENT) -> DataFrame:
    """``print, rules``: texts (``print, text``) with the places of the rules whose query the posting lists satisfy.

    Hashes that collide only add candidates. A segment's lists come together in one row: their number is bounded by
    ``segment`` and the trigrams. Equal texts count once.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := index_query(r.pattern)) != ANY}
    named = sorted({t for q in queries.values() for term in q for t in term})
    if not named:
        return texts.select("print", F.array().cast("array<int>").alias("rules")).limit(0)
    index = postings(texts, named, max(1, -(-texts.count() // segment)))
    lists = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "prints"))).alias("lists"))
    none = F.array().cast("array<long>")
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(named.index(t))), none)
    docs = lambda q: reduce(F.array_union, (reduce(F.array_intersect, map(of, sorted(term))) for term in sorted(q, key=sorted)))
    each = lists.select(F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), docs(q).alias("prints")) for i, q in queries.items()))).alias("r"))
    return each.select("r.rule", F.explode("r.prints").alias("print")).groupBy("print").agg(F.collect_set("rule").alias("rules"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id``, ``text`` (null: empty), the columns ``keep`` and ``spans``: sorted (start, order, end) of every rule's matches, a row for each row.

    Two passes over the texts, one for the index and one for the matches. Texts stay where they are read if the
    candidates are few (``broadcast_rows``), else they are joined with them by hash.
    """
    base = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("print", F.xxhash64("text"))
    may = materialize(candidates(base.select("print", "text"), rules))
    may = may.select(F.col("print").alias("may_print"), "rules")
    both = base.join(F.broadcast(may) if may.count() <= broadcast_rows else may, F.col("print") == F.col("may_print"), "left")
    none = F.array().cast(SPANS)
    made = []
    for i, rule in enumerate(rules):
        # rules without a query take a first look at the text, which spares most of them the rest
        may_match = F.col("text").rlike(runs(rule)) if index_query(rule.pattern) == ANY else F.coalesce(F.array_contains("rules", i), F.lit(False))
        made.append(F.when(may_match, spans_of(F.col("text"), rule, i)).otherwise(none))
    return both.select("id", "text", *(f"keep_{c}" for c in keep), F.array_sort(F.concat(*made)).alias("spans")).withColumnsRenamed({f"keep_{c}": c for c in keep})


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, a count of spans for each base rule, ``base_sha256`` and ``spans`` of every row.

    A span is written kind:start:end, in code points with the end exclusive; spans are sorted by start, then by the
    rules' order, and joined by commas. Null and empty texts have none; their hash is that of the empty string.
    Repeated rows and null ids give a row each. The other rules only add spans.

    Posting lists are split into segments, so that a common trigram makes no large group.
    """
    found = spans(docs, rules, id_col, text_col)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    number = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    counts = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[: len(BASE)])]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def without(text: Column, spans: Column) -> Column:
    """``text`` with ``MARK`` in the place of sorted ``spans``; what overlaps is one. The text is cut into blocks once, so that no piece is sought from its start."""

    def cut(blocks: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")
        of = lambda i, start, n: F.coalesce(F.substring(F.get(blocks, i), start, n), F.lit(""))
        between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, of(first, low % BLOCK + 1, high - low)).otherwise(F.concat(of(first, low % BLOCK + 1, F.lit(BLOCK)), between, of(last, F.lit(1), high % BLOCK)))

    def groups(reach: Column) -> Column:
        """(start, end) of spans that no other one overlaps, where ``reach`` is the greatest end so far."""
        marked = F.zip_with(spans, reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach")))
        starts = lambda m: F.transform(F.filter(m, lambda x, i: F.coalesce(x["start"] >= F.get(m, i - 1)["reach"], F.lit(True))), lambda x: x["start"])
        ends = lambda m: F.transform(F.filter(m, lambda x, i: F.coalesce(F.get(m, i + 1)["start"] >= x["reach"], F.lit(True))), lambda x: x["reach"])
        return let(marked, lambda m: F.arrays_zip(F.array_append(starts(m), F.char_length(text)).alias("high"), F.array_prepend(ends(m), F.lit(0)).alias("low")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    pieces = let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), groups)
    return F.array_join(let(blocks, lambda b: F.transform(pieces, lambda p: cut(b, p["low"], p["high"]))), MARK)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts, overlapping ones as one, replaced by ``MARK``. Columns and their order stay; null texts become empty."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = spans(docs, rules, id_col, text_col, rest)
    made = found.select(F.col("id").alias(id_col), *rest, F.when(F.size("spans") == 0, F.col("text")).otherwise(let(F.col("spans"), lambda s: without(F.col("text"), s))).alias(text_col))
    return made.select(*docs.columns)
