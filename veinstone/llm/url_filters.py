"""URL rules in a sorted digest array.

The rules' strings (host and path) are hashed to 64-bit xxhash keys and sorted; keys, actions, string offsets and the
strings themselves are files that each executor fetches once and maps into memory, so that its workers share their
pages. A batch of URLs gives the strings that could be a fitting rule (each suffix of the host, each prefix of the path
that is as long as some rule's path); their keys are found by one binary search over the array for the batch, and a
key that is found is confirmed against the stored string, so collisions don't matter.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of candidate strings that are looked up together.
BATCH_BYTES = 16 << 20
_FOLD = {c: c + 32 for c in range(65, 91)}
_open: dict[str, "DigestArray"] = {}
#: Arrays that an application has sent to its executors.
_sent: set[tuple[str, str]] = set()


class DigestArray:
    """Strings with an action each, found by binary search over their digests in files that are mapped into memory."""

    def __init__(self, stem: str):
        read = lambda name: np.load(f"{stem}.{name}.npy", mmap_mode="r")
        self.keys, self.actions, self.ends, self.text, self.lengths, self.longest = map(read, ("keys", "actions", "ends", "text", "lengths", "longest"))

    def string(self, i: int) -> bytes:
        return self.text[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, strings: Sequence[bytes]) -> np.ndarray:
        """The place of each string, -1 where it isn't there."""
        out = np.full(len(strings), -1, np.int64)
        if not len(strings) or not len(self.keys):
            return out
        asked = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, asked)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == asked)
        for i in hit:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == asked[i]:  # strings that share a digest stand side by side
                if self.string(k) == strings[i]:
                    out[i] = k
                    break
                k += 1
        return out


def build(rules: Sequence[tuple[str, str, str]], folder: str) -> tuple[str, list[str]]:
    """Writes the array of ``(action, host, path)`` rules; the common stem of its files, and the files.

    Hosts are taken in lower case. Of rules with equal strings the first counts. ``net/`` is host ``net``, path ``/``.
    """
    first: dict[bytes, int] = {}
    lengths = set()
    for action, host, path in rules:
        first.setdefault((host.translate(_FOLD) + path).encode(), action == "block")
        lengths.add(len(path))
    order = sorted(first, key=lambda s: (xxhash.xxh64_intdigest(s), s))
    parts = {
        "keys": np.array([xxhash.xxh64_intdigest(s) for s in order], np.uint64),
        "actions": np.array([first[s] for s in order], np.uint8),
        "ends": np.cumsum([len(s) for s in order], dtype=np.int64) if order else np.empty(0, np.int64),
        "text": np.frombuffer(b"".join(order), np.uint8),
        "lengths": np.array(sorted(lengths), np.int64),
        "longest": np.array([max((len(s.decode()) for s in order), default=0)], np.int64),
    }
    stem = xxhash.xxh64_hexdigest(b"".join(x.tobytes() for x in parts.values()))
    files = [os.path.join(folder, f"{stem}.{name}.npy") for name in parts]
    for file, part in zip(files, parts.values(), strict=True):
        np.save(file, part)
    return stem, files


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host, path = (rest[:end], "") if slash < 0 else (rest[:slash], rest[slash:end])
    return host.translate(_FOLD), path


def candidates(host: str, path: str, lengths: Sequence[int], longest: int) -> Iterator[bytes]:
    """Strings of all rules of up to ``longest`` characters that would fit, the longest host first, for one host the longest path first."""
    start = 0 if len(host) <= longest else host.find(".", len(host) - longest - 1) + 1 or len(host)
    while start < len(host):
        room = longest - (len(host) - start)
        yield from ((host[start:] + path[:n]).encode() for n in reversed(lengths) if n <= len(path) and n <= room)
        start = host.find(".", start) + 1 or len(host)


def _asked(split: list[tuple[str, str]], lengths: Sequence[int], longest: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """The candidates of URLs with their places, about ``BATCH_BYTES`` at a time."""
    places: list[int] = []
    strings: list[bytes] = []
    held = 0
    for i, (host, path) in enumerate(split):
        for s in candidates(host, path, lengths, longest):
            places.append(i)
            strings.append(s)
            held += len(s)
            if held >= BATCH_BYTES:
                yield places, strings
                places, strings, held = [], [], 0
    yield places, strings


def url_filters(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row.

    A rule fits its host and all subdomains where the path starts with the rule's. The longest rule wins (host and
    path together, in characters; the longer host among equals). Where none fits, ``rule`` is null and the verdict is
    ``default``: the array has no entry for the URL. A null URL, or one without ``://``, has an empty host and fits
    no rule. One row for each row, repeated ones and null ids included, no shuffle; other columns are ignored. An empty
    table gives no rows. The rules' files are mapped, not loaded: executors need disk for them, and pages of what they probe.
    Candidates of a batch are looked up ``BATCH_BYTES`` at a time, so many path lengths take time, not memory. Of a host only
    the end that is as long as the longest rule is looked at.
    """
    folder = tempfile.mkdtemp(prefix="rules-")  # on the driver, which sends the files to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    stem, files = build(rules, folder)
    context = pages.sparkSession.sparkContext
    if (context.applicationId, stem) not in _sent:
        for file in files:
            context.addFile(file)
        _sent.add((context.applicationId, stem))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stem not in _open:
            _open.clear()
            _open[stem] = DigestArray(SparkFiles.get(stem))
        array = _open[stem]
        lengths, longest = array.lengths.tolist(), int(array.longest[0])
        for batch in batches:
            split = [split_url(u.as_py()) for u in batch.column(1)]
            best = np.full(len(split), -1, np.int64)
            for places, strings in _asked(split, lengths, longest):
                found = array.find(strings)
                for i in np.flatnonzero(found >= 0).tolist():
                    k, at = int(found[i]), places[i]
                    if best[at] < 0 or len(array.string(k).decode()) > len(array.string(int(best[at])).decode()):
                        best[at] = k
            names = [array.string(int(k)).decode() if k >= 0 else None for k in best]
            verdicts = [default if k < 0 else "block" if array.actions[k] else "allow" for k in best]
            cols = [pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
