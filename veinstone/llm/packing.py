"""Hierarchical packing of documents into sequences of several context sizes.

Each document's ids are cut into full windows of the longest size and a remainder. Remainders are routed to the
smallest tier that holds them, each tier fills windows of its own size, the gaps that are left (longest windows
first) take documents of shorter tiers, whole where one fits and cut to size otherwise. Windows of a tier are a
power of two long and full; what remains of a block of documents makes at most one partly filled sequence.
Sequences of equal length are dealt to step groups of equal token budgets.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import release

#: Remembered encodings of a worker, ids packed together before they are written, and sequences' tokens in a step group.
MEMORY, BLOCK_IDS, STEP_TOKENS = 250_000, 4_000_000, 16_384
TIERS = (2048, 1024, 512, 256)
#: White space other than space and line feed; texts with it are encoded as a whole.
_ODD = tuple(map(chr, (9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ready: dict[int, "Encoder | Library"] = {}


def merges_by_rank(spec: bytes) -> bool:
    """Proves that merging by vocabulary ids gives what the merge list gives.

    That holds if the merges' results have growing ids, and every piece of the vocabulary comes out of the model as just
    itself: two neighbours whose union is a piece are then the last merge of that piece's own derivation.
    """
    from tokenizers import Tokenizer

    conf = json.loads(spec)
    model, special = conf["model"], {t["content"] for t in conf["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or (made and made[0] < 0):
        return False
    bpe = Tokenizer.from_str(spec.decode()).model
    return all([t.id for t in bpe.tokenize(piece)] == [i] for piece, i in model["vocab"].items() if piece not in special)


def plain(spec: bytes) -> bool:
    """Whether a ``tokenizer.json`` is a byte-level BPE without normalisation, prefix, dropout or anything else that ``Encoder`` doesn't know."""
    conf = json.loads(spec)
    pre, model = conf.get("pre_tokenizer") or {}, conf["model"]
    known = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not conf.get("normalizer")
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    strict = all(not t.get(k) for t in conf["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    return bool(known and not odd and strict and merges_by_rank(spec))


class Library:
    """Ids as the library gives them, for tokenizers of which ``plain`` proves nothing."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit numbers, as a byte-level BPE ``tokenizer.json`` of which ``plain`` holds gives them.

    White space opens a pre-token and never follows another character in one, so a text is cut before each run
    of it, and each part has the same ids alone as in the text. Ids of parts are remembered.
    """

    def __init__(self, spec: bytes, memory: int = MEMORY):
        import tiktoken

        conf = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in conf["model"]["vocab"].items() if piece not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.memory = memory
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pack(self, part: str) -> bytes:
        ids = np.array(self.plain(part), "<u4").tobytes()
        if len(self.known) < self.memory and len(part) < 64:
            self.known[part] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return np.array(self.plain(text), "<u4").tobytes()
        parts = _UNIT.findall(text)
        packed = list(map(self.known.get, parts))
        if None in packed:
            packed = [self.pack(p) if b is None else b for p, b in zip(parts, packed, strict=True)]
        return b"".join(packed)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._ordinary(p) for p in self.cut.split(text) if p)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Window:
    """One sequence: the size of its tier and its pieces (document's place, start, length)."""

    size: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    used: int = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.pieces.append((doc, start, length))
        self.used += length


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows that hold documents of these lengths. All but the last are full; each is as long as its tier."""
    longest = tiers[0]
    done: list[Window] = []
    rest: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # by tier: (length, document, start)
    for doc, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            done.append(Window(longest, [(doc, start, longest)], longest))
        if left := n % longest:
            rest[min(t for t in tiers if t >= left)].append((left, doc, n - left))
    for t in tiers:
        rest[t].sort()
    last: list[Window] = []
    for at, t in enumerate(tiers):
        while rest[t]:
            window = Window(t)
            while rest[t] and rest[t][-1][0] <= t - window.used:
                n, doc, start = rest[t].pop()
                window.add(doc, start, n)
            for shorter in tiers[at:]:  # the largest of its own and each shorter tier that still fits
                while (gap := t - window.used) and (k := bisect.bisect_right(rest[shorter], (gap, 1 << 62, 0))):
                    n, doc, start = rest[shorter].pop(k - 1)
                    window.add(doc, start, n)
            while (gap := t - window.used) and (source := next((s for s in reversed(tiers[at:]) if rest[s]), None)):
                n, doc, start = rest[source].pop()
                take = min(n, gap)
                window.add(doc, start, take)
                if take < n:  # what is left goes to the tier that now holds it
                    bisect.insort(rest[min(x for x in tiers if x >= n - take)], (n - take, doc, start + take))
            (done if window.used == t else last).append(window)
    tail: list[Window] = []
    for window in last:  # partly filled ones, together less than the longest where that is possible
        if not tail or tail[-1].used + window.used > longest:
            tail.append(Window(longest))
        for piece in window.pieces:
            tail[-1].add(*piece)
    return done + tail


def pack(
    docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", step_tokens: int = STEP_TOKENS, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``tier`` (the sequence's
    padded length), ``step_group`` (sequences of one tier that make ``step_tokens`` tokens together), with ``ids`` if asked for.

    Documents are packed where they are read, in blocks of a bounded number of ids: no shuffle, and no group that
    grows with the data. Sequence ids hold the partition's number, so that a task which is run again gives the same.
    A null or empty text is just ``end_id``. Repeated rows and null ids are documents of their own. Other columns
    are ignored. An empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers are powers of two, longest first")
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    known, key, end = docs.sparkSession.sparkContext.broadcast(spec), hash(spec), np.array([end_id], "<u4").tobytes()
    kind_of_encoder = Encoder if plain(spec) else Library
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def rows(ids: list, packed: list[bytes], base: int, groups: dict[int, list[int]]) -> tuple[pa.RecordBatch, int]:
        out: dict[str, list] = {n: [] for n in [*names, "ids"]}
        windows = plan([len(b) // 4 for b in packed], tiers)
        for number, window in enumerate(windows, base):
            tier = window.size if window.used == window.size else tiers[0]
            room = groups[tier]  # [the group that is being filled, tokens in it]
            if not room or room[1] + tier > step_tokens:
                groups[0][0] += 1
                room[:] = [groups[0][0], 0]
            room[1] += tier
            at = 0
            for doc, start, n in window.pieces:
                part = packed[doc][4 * start : 4 * (start + n)]
                for name, value in zip(names, (ids[doc], start, n, zlib.crc32(part), len(packed[doc]) // 4, number, at, tier, room[0]), strict=True):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int64))
                at += n
        cols = [pa.array(out["id"], id_type)] + [pa.array(out[n], pa.int64()) for n in names[1:]]
        if with_ids:
            cols.append(pa.array(out["ids"], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids), base + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ready:
            _ready.clear()
            _ready[key] = kind_of_encoder(known.value)
        encoder, base = _ready[key], TaskContext.get().partitionId() << 40
        groups: dict[int, list[int]] = defaultdict(list)
        groups[0] = [base]
        ids, packed, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                packed.append(encoder.encode(text.as_py()) + end)
                held += len(packed[-1]) // 4
                if held >= BLOCK_IDS:
                    made, base = rows(ids, packed, base, groups)
                    yield made
                    ids, packed, held = [], [], 0
        if ids:
            yield rows(ids, packed, base, groups)[0]
        del ids, packed
        release()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = out.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def padding(pieces: DataFrame) -> DataFrame:
    """Sequences, ids and padded positions by tier."""
    each = pieces.groupBy("sequence_id", "tier").agg(F.sum("length").alias("used"))
    return each.groupBy("tier").agg(F.count("*").alias("sequences"), F.sum("used").alias("ids"), F.sum(F.col("tier") - F.col("used")).alias("padding"))
