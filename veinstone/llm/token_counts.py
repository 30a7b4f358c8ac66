"""Token counts by the whole-token shortcut.

Before any text is read, two facts about the vocabulary are proved on the driver:

* where a text can be cut. No piece holds the space mark after another character, and none holds a line
  feed, so no merge ever crosses from a character to a following space or across a line feed. The text
  then falls into pre-tokens that are encoded independently of each other.
* which pieces encode alone as just themselves. A pre-token in that set counts one, without any merging.

Only other pre-tokens go through the merges; each worker remembers the counts of a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Pre-tokens whose counts a worker remembers at most.
MEMORY = 300_000
#: Pre-tokens of so many characters aren't remembered.
LONG = 64
_ready: dict[int, "Counter"] = {}


@dataclass(frozen=True)
class Proof:
    """What holds for a vocabulary: whether texts may be cut before spaces and line feeds, and the words that are one token after a space."""

    cuts: bool
    words: frozenset[str]


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> Proof:
    """Proves the cuts and the whole tokens of a SentencePiece BPE model, from its vocabulary alone."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    norm, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type in (1, 4)]
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
    if not plain or crossing or proto.trainer_spec.treat_whitespace_as_suffix:
        return Proof(False, frozenset())
    sp = _processor(model)
    words = [p[1:] for p in pieces if p[0] == SPACE and p[1:] and SPACE not in p[1:]]
    return Proof(True, frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1))


class Counter:
    """Counts the tokens of texts under one model; keeps counts of pre-tokens between texts."""

    def __init__(self, model: bytes, proof: Proof, memory: int = MEMORY):
        self.sp, self.proof, self.memory = _processor(model), proof, memory
        self.known: dict[str, int] = dict.fromkeys(proof.words, 1)
        self.limit = len(self.known) + memory

    def merged(self, part: str) -> int:
        """Tokens of a pre-token that follows a space, or that starts with a line feed which takes the place of one."""
        n = len(self.sp.encode(part)) - part.startswith("\n")
        if len(self.known) < self.limit and len(part) < LONG:
            self.known[part] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        # a line feed gets a space before it, to be split there; a real space beside it leaves an empty part
        parts = text.replace("\n", " \n").split(" ")
        first = text[0] == "\n"  # then the mark before the text stands alone
        if not self.proof.cuts or SPACE in text or "" in parts[1:] or (not parts[0] and not first):
            return len(self.sp.encode(text))
        return 1 + self._sum(parts[1:]) if first else self._sum(parts)

    def _sum(self, parts: list[str]) -> int:
        counts = list(map(self.known.get, parts))
        if None in counts:
            counts = [self.merged(p) if n is None else n for p, n in zip(parts, counts, strict=True)]
        return sum(counts)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row of ``docs``.

    No shuffle; whole texts, one row for each row, repeated rows and null ids included. A null or empty text has
    0 bytes and 0 tokens. Other columns are ignored. ``model_path`` is read on the driver only; its size and that
    of the proved words are bounded by the vocabulary.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    known = docs.sparkSession.sparkContext.broadcast((model, prove(model)))
    key = hash(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ready:
            _ready.clear()
            _ready[key] = Counter(*known.value)
        counter = _ready[key]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            counts = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = out.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
