"""N-gram Jaccard join by rare-first prefix filtering.

A document is the set of its word shingles; documents with equal sets are one node. Shingles are ordered rare first, by
the number of nodes that have them. Sets with a Jaccard similarity of t share a shingle among the first
n - ceil(t n) + 1 of each (the prefix). The steps:

1. Tasks hash texts to sets and deal the postings (shingle, node) out by ranges of the hash, in packed arrays. A chunk sends
   a shingle that many of its own nodes have once, with their number. Each range counts its shingles and answers those
   that more than one node has; the others can't be shared. Nodes whose prefix holds only unshared shingles are
   finished, which are most of them.
2. Prefix postings of the rest are joined on the shingle. Pairs pass a length filter, a positional filter (what can still
   follow the shingle in both) and a suffix filter (what follows in both, in classes of the hash, bounds what they share), and
   are verified once, on the whole sets.
3. Links serve to tell components. So pairs within a component need no look, and groups of copies don't make all
   their pairs: first the nodes of a posting list are paired with a few pivots each, then all pairs whose ends are
   still in different components, and that haven't been tried, are joined.

A node is named by the least id of its rows and its digest, so the least node of a component names it, and no
component is ever gathered or joined by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.llm.common import materialize, release
from veinstone.llm.components import components
from veinstone.llm.shingles import SIZE, shingle_sets

#: Postings that a task packs at once, nodes of a chunk from which a shingle is sent once, texts that are hashed together (characters), pivots of a shingle and of a node, classes of the suffix filter.
CHUNK, HOT, BATCH_CHARS, PIVOTS, PAIRS, CLASSES = 3_000_000, 8, 1 << 20, 3, 2, 16
#: Bytes of text for a range of hashes: the least, the most, and so many ranges in between; postings of a chunk for each range, up to a multiple of ``CHUNK``.
RANGE_BYTES, MOST_RANGE_BYTES, RANGES, ROW, MOST_CHUNK = 4_000_000, 64_000_000, 50_000, 60, 4
DOC, NODES, POSTINGS, SHARED = 0, 1, 2, 3
#: A node is hot with more than this part of all rows, so at most so many are.
HOT_SHARE = 1000
#: An owner from here on is a number of owners.
MANY = 1 << 31


def squeeze(a: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: planes of zeros vanish in Spark's compression."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def needed(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """ceil(n * num / den)"""
    return -(-n * num // den)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))


def _packed(sets: list[np.ndarray], digests: list[bytes], ranges: int) -> Iterator[tuple]:
    """Rows (kind, group, chunk, a, b, c) of a chunk of distinct sets: its nodes and sizes, the shingles of ``HOT`` sets or
    more with their owners, and for each range the sorted shingles with their owner or, of those, the number of owners."""
    nodes, sizes = b"".join(digests), np.array([len(s) for s in sets], np.int32)
    chunk = xxhash.xxh64_intdigest(nodes) - (1 << 63)
    yield NODES, chunk % ranges, chunk, nodes, sizes.tobytes(), b""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens)
    tokens, owners = tokens[order], np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)[order]
    first = _starts(tokens)
    counts = np.diff(np.append(first, len(tokens)))
    hot = counts >= HOT
    if hot.any():
        within = np.repeat(hot, counts)
        yield SHARED, chunk % ranges, chunk, squeeze(np.diff(tokens[first[hot]], prepend=np.uint64(0))), squeeze(counts[hot].astype(np.uint32)), squeeze(owners[within])
        within[first[hot]] = False
        owners[first[hot]] = MANY + counts[hot]
        tokens, owners = tokens[~within], owners[~within]
    cuts = np.searchsorted((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(cuts)):
        part = tokens[cuts[i] : cuts[i + 1]]
        yield POSTINGS, int(i), chunk, squeeze(np.diff(part, prepend=np.uint64(0))), squeeze(owners[cuts[i] : cuts[i + 1]]), b""


def _freed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def freed(group: pa.Table) -> pa.Table:
        out = run(group)
        del group
        release()
        return out

    return freed


def _answers(group: pa.Table) -> pa.Table:
    """Of one range: for each chunk its postings of shingles that are in more than one set, with the number of sets."""
    group = group.combine_chunks()
    kinds = group.column("kind").to_numpy()
    same, rows = group.filter(pa.array(kinds != POSTINGS)), np.flatnonzero(kinds == POSTINGS)
    if not len(rows):
        return same
    a, b, chunks = group.column("a"), group.column("b"), group.column("chunk").to_numpy()
    parts = [np.cumsum(unsqueeze(a[int(i)].as_py(), np.uint64), dtype=np.uint64) for i in rows]
    sizes = np.array([len(p) for p in parts])
    tokens, owners = np.concatenate(parts), np.concatenate([unsqueeze(b[int(i)].as_py(), np.uint32) for i in rows])
    whose = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    del parts
    order = np.argsort(tokens)
    first = _starts(tokens[order])
    number = np.where(owners >= MANY, owners - np.uint32(MANY), np.uint32(1)).astype(np.int64)
    count = np.empty(len(order), np.uint32)
    count[order] = np.repeat(np.add.reduceat(number[order], first), np.diff(np.append(first, len(order))))
    keep = np.flatnonzero(count > 1)
    ends = np.searchsorted(whose[keep], np.arange(len(rows) + 1))
    made: dict[str, list] = {n: [] for n in group.schema.names}
    for k, i in enumerate(rows):
        at = keep[ends[k] : ends[k + 1]]
        if len(at):
            for name in made:
                made[name].append(None)
            for name, value in (("kind", POSTINGS), ("group", int(group.column("group")[int(i)].as_py())), ("chunk", int(chunks[i])), ("a", squeeze(np.diff(tokens[at], prepend=np.uint64(0)))), ("b", squeeze(owners[at])), ("c", squeeze(count[at]))):
                made[name][-1] = value
    return pa.concat_tables([same, pa.Table.from_pydict(made, schema=group.schema)])


def _shared(num: int, den: int):
    """Of one chunk: node, n, the shared shingles, rare first, of the sets that have one in their prefix, and for each shingle of
    the prefix how many of what follows it are in each class."""
    schema = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("rest", pa.list_(pa.list_(pa.int32())))])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        kinds = group.column("kind").to_pylist()
        rows = [i for i, k in enumerate(kinds) if k == POSTINGS]
        if NODES not in kinds or not rows:
            return schema.empty_table()
        blob = lambda name, i, kind: unsqueeze(group.column(name)[i].as_py(), kind)
        own = kinds.index(NODES)
        nodes, sizes = group.column("a")[own].as_py(), np.frombuffer(group.column("b")[own].as_py(), np.int32)
        tokens = np.concatenate([np.cumsum(blob("a", i, np.uint64), dtype=np.uint64) for i in rows])
        owners, counts = np.concatenate([blob("b", i, np.uint32) for i in rows]), np.concatenate([blob("c", i, np.uint32) for i in rows])
        if SHARED in kinds:
            hot = kinds.index(SHARED)
            many, lengths = owners >= MANY, blob("b", hot, np.uint32)
            number = counts[many][np.argsort(tokens[many])]
            tokens = np.concatenate((tokens[~many], np.repeat(np.cumsum(blob("a", hot, np.uint64), dtype=np.uint64), lengths)))
            owners, counts = np.concatenate((owners[~many], blob("c", hot, np.uint32))), np.concatenate((counts[~many], np.repeat(number, lengths)))
        have = np.bincount(owners, minlength=len(sizes))
        prefix = sizes - needed(sizes.astype(np.int64), num, den) + 1
        good = (have > 0) & (sizes - have < prefix)
        mine = good[owners]
        tokens, owners, counts = tokens[mine], owners[mine], counts[mine]
        order = np.lexsort((tokens, counts, owners))
        tokens, owners = tokens[order], owners[order]
        at = np.flatnonzero(good)
        offsets = np.concatenate(([0], np.cumsum(have[at])))
        whose = (np.cumsum(good, dtype=np.int32) - 1)[owners]
        classes = (tokens % np.uint64(CLASSES)).astype(np.int32)
        del order, counts
        total = np.bincount(whose * CLASSES + classes, minlength=len(at) * CLASSES).astype(np.int32).reshape(-1, CLASSES)
        head = np.flatnonzero(np.arange(len(tokens)) - offsets[whose] < (prefix - (sizes - have))[owners])
        seen = np.zeros((len(head), CLASSES), np.int32)
        seen[np.arange(len(head)), classes[head]] = 1
        heads = np.bincount(whose[head], minlength=len(at))
        begin = np.concatenate(([0], np.cumsum(heads)))
        seen = np.cumsum(seen, axis=0, dtype=np.int32)
        before = np.concatenate((np.zeros((1, CLASSES), np.int32), seen))[begin[:-1]]
        rest = total[whose[head]] - (seen - before[whose[head]])
        rest = pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1) * CLASSES, pa.int32()), pa.array(rest.ravel()))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.view(np.int64))), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rest)]
        return pa.Table.from_arrays([pa.array([nodes[16 * i : 16 * i + 16] for i in at], pa.binary()), pa.array(sizes[at], pa.int32()), *lists], schema=schema)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, size: int, ranges: int, chunk: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("kind", pa.int32()), ("group", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("id", to_arrow_type(id_type)), ("node", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        held, turn = 0, TaskContext.get().partitionId() * 7919

        def flush() -> Iterator[pa.RecordBatch]:
            for row in _packed(list(sets.values()), list(sets), ranges):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*row, None, None, None), schema, strict=True)], schema=schema)

        for batch in batches:
            lengths = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            groups = np.flatnonzero(np.diff(lengths // BATCH_CHARS, prepend=-1)).tolist() + [batch.num_rows]
            for a, b in zip(groups, groups[1:], strict=False):
                part = batch.slice(a, b - a)
                made = shingle_sets(part.column(1).to_pylist(), size)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in made]
                fixed = {"kind": DOC, "group": 0, "chunk": 0, "a": None, "b": None, "c": None}
                columns = [pa.array([x] * len(made), schema.field(n).type) for n, x in fixed.items()]
                # rows of documents ride along with any range, in turn, so that a group of copies makes no large one
                columns[1] = pa.array((np.arange(len(made)) + turn) % ranges, pa.int32())
                turn += len(made)
                yield pa.RecordBatch.from_arrays([*columns, part.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in made], pa.int32())], schema=schema)
                for digest, s in zip(digests, made, strict=True):
                    if len(s) and digest not in sets:
                        sets[digest] = s
                        held += len(s)
                if held >= chunk:
                    yield from flush()
                    sets.clear()
                    held = 0
        if sets:
            yield from flush()
        sets.clear()
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("size"))
    return rows.mapInArrow(run, f"kind int, group int, chunk long, a binary, b binary, c binary, id {id_type.simpleString()}, node binary, n int")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (``u, v``) the ones that are similar enough, verified once each on the shared shingles of both."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}"))
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("t_u", "t_v"))
    both = both.select("u", "v", "n_u", "n_v", common.alias("common"))
    return both.filter(den * F.col("common") >= num * (F.col("n_u") + F.col("n_v") - F.col("common"))).select("u", "v")


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``node, component`` of the nodes of ``sets`` (``node, n, tokens, rest``) that are linked to another one."""
    n, shared = F.col("n"), F.size("tokens")
    heads = sets.select("node", "n", "tokens", (shared / n).alias("shared"), F.posexplode("rest").alias("i", "rest"))
    heads = heads.select(F.get("tokens", F.col("i")).alias("token"), "node", "n", "shared", "rest", (n - shared + F.col("i")).alias("place"))
    several = heads.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("token")
    heads = materialize(heads.join(several, "token"))

    def passing(rows: DataFrame, *more: Column) -> DataFrame:
        """Of rows with columns of two postings of one shingle, p and q, the pairs that the filters leave, a row for each shingle."""
        least = F.expr(f"(cast(p.n + q.n as bigint) * {num} + {num + den - 1}) div {num + den}")  # what similar sets share at least
        length = F.lit(den) * F.least("p.n", "q.n") >= F.lit(num) * F.greatest("p.n", "q.n")
        rest = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
        # of the first shingle that both have: itself and what follows in both
        suffix = F.aggregate(F.zip_with("p.rest", "q.rest", lambda x, y: F.least(x, y)), F.lit(1), lambda a, x: a + x)
        ends = [F.least("p.node", "q.node").alias("u"), F.greatest("p.node", "q.node").alias("v")]
        return rows.filter(length & (rest >= least) & (suffix >= least)).select(*more, *ends)

    posting = F.struct("node", "n", "place", "rest", "component")
    # the node that shares most of its shingles, and those that hashes put first, the same ones for all shingles of a group
    ranks = [F.struct(-F.col("shared"), F.col("node"))] + [F.struct(F.xxhash64("node", F.lit(i)), F.col("node")) for i in range(1, PIVOTS)]
    rows = heads.withColumn("component", F.col("node"))
    pivots = rows.groupBy("token").agg(F.array_distinct(F.array(*(F.min_by(posting, r) for r in ranks))).alias("q")).select("token", F.explode("q").alias("q"))
    pairs = passing(rows.select("token", posting.alias("p")).join(pivots, "token").filter("p.node <> q.node"), F.col("p.node").alias("node"))
    # each node is paired with the pivots that it shares most with; what this leaves out is looked at below
    best = W.partitionBy("node").orderBy(F.desc("shared"), "u", "v")
    pairs = pairs.groupBy("node", "u", "v").agg(F.count("*").alias("shared")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= PAIRS).select("u", "v")
    tried = materialize(pairs.distinct())
    found = materialize(_verified(tried, sets, num, den))
    labels = materialize(components(found))

    # all pairs that are still apart have an end outside the component that is most frequent among a shingle's postings
    rows = heads.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = rows.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.count("*").alias("k")).filter("k > 1").select("token", "most")
    rows = materialize(rows.join(most, "token"))
    p = rows.filter("component <> most").select("token", posting.alias("p"))
    q = rows.select(F.col("token").alias("token_q"), F.struct("node", "n", "place", "rest", "component", "most").alias("q"))
    apart = (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.most")) | (F.col("p.node") < F.col("q.node")))
    near = F.lit(den) * F.least("p.n", "q.n") >= F.lit(num) * F.greatest("p.n", "q.n")
    pairs = passing(p.join(q, (F.col("token") == F.col("token_q")) & apart & near))
    more = materialize(_verified(pairs.join(tried, ["u", "v"], "left_anti"), sets, num, den))
    return labels if more.isEmpty() else materialize(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)))


def jaccard_join(docs: DataFrame, num: int = 80, den: int = 100, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of every row: the least id among rows that links reach.

    Two rows are linked when ``den`` times the shingles that both have are at least ``num`` times those that either has.
    Words are what ASCII white space leaves, with A-Z in lower case; a text of fewer than ``size`` words is one shingle, one
    without words (or null) has none, is linked with nothing and is its own component. Equal texts are linked, so repeated rows
    are too. Null ids count for nothing in the least id. Sets are compared by 64-bit hashes of shingles and equal ones
    recognised by 128-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = -(-total // min(max(RANGE_BYTES, total // RANGES), MOST_RANGE_BYTES))
    ranges = max(ranges, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // 1_000_000))
    rows = _rows(docs, id_col, text_col, size, ranges, min(max(CHUNK, ROW * ranges), MOST_CHUNK * CHUNK))
    schema = rows.schema
    answered = materialize(rows.groupBy("group").applyInArrow(_freed(_answers), schema))
    named = answered.filter(F.col("kind") == DOC).select("id", "node", "n")
    nodes = materialize(named.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    sets = answered.filter(F.col("kind") != DOC).select("kind", "chunk", "a", "b", "c").groupBy("chunk").applyInArrow(_freed(_shared(num, den)), "node binary, n int, tokens array<long>, rest array<array<int>>")
    name = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("node").alias("digest"))
    sets = materialize(sets.dropDuplicates(["node"]).join(nodes, "node").withColumn("node", name).drop("least", "rows"))
    labels = links(sets, num, den).select(F.col("node.digest").alias("node"), F.col("component.id").alias("component_id"), F.lit(True).alias("linked"))
    # rows without an equal or a linked one are their own component
    known = nodes.join(labels, "node", "left").filter("linked OR rows > 1").select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("known"))
    # nodes with more than a HOT_SHARE-th of the rows are few, and are found without a shuffle
    rows = nodes.agg(F.sum("rows")).first()[0] or 0
    hot = known.join(nodes.filter(F.col("rows") * HOT_SHARE > rows).select("node"), "node", "left_semi")
    hot = materialize(hot)
    rest = named.join(F.broadcast(hot.select("node")), "node", "left_anti").join(known, "node", "left")
    out = named.join(F.broadcast(hot), "node").unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
