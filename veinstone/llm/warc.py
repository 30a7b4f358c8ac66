"""WARC archives: written by Spark's own writer, read back by verified record chains.

An archive is cut into ranges. Tasks look for the magic of a record in their range and emit the edge from each
candidate to where its record says the next one starts. Within a range the edges are followed at once, so a candidate
points to the first offset beyond the range. Pointer jumping over those edges from offset 0 of each file then finds the
offsets that are reached, in a number of rounds that is the logarithm of a file's ranges. Records are read from reached
offsets only: magic inside a payload starts no record, since no chain leads to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import materialize, shared_dir

MAGIC, END = b"WARC/1.", b"\r\n\r\n"
#: Bytes of a range, bytes that are read behind a header's start at first, and rows of duplicates up to which they are broadcast (100 bytes each).
RANGE, WINDOW, BROADCAST_ROWS = 32 << 20, 1 << 16, 500_000
#: Most tasks that read archives; with more ranges, a task reads several, one after the other.
MAX_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How many records or edges go into one batch of results.
BATCH = 2048


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits are 10 hexadecimal and 8 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record for each row to uncompressed archives in the folder ``path``, one for each task.

    Of equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others are revisits
    of it; smaller payloads are all responses. Ids are written URL-encoded. A null payload is empty. Rows that share the smallest id and the payload
    are all responses, and so are rows of a payload that has null ids only. A null URL writes no target.

    Only digests are shuffled, aggregated before; payloads stay where they are read if the duplicates' first ids are
    few (``BROADCAST_ROWS``), else they move once in a join that adaptive execution splits where a payload is hot.
    The records are lines of Spark's text writer, whose line end is the end of a record, so its commit protocol holds.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    firsts = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    firsts = materialize(firsts.filter("rows > 1 AND first IS NOT NULL").drop("rows"))
    few = firsts.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    again = (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    again = F.coalesce(again, F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:x-page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:x-page-without-id>"))
    block = F.concat(F.col("http"), F.when(F.col("again"), F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    rows.withColumns({"again": again, "http": http}).withColumn("block", block).select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


def _open(path: str):
    """A file by Hadoop's name of it, for random access."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _header(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields of the header at ``at``, where its content starts, and that content's length; None if it isn't a header."""
    end = data.find(END, at)
    if end < 0:
        return None
    first, *lines = data[at:end].split(b"\r\n")
    if not first.startswith(MAGIC) or not first[len(MAGIC) :].isdigit():
        return None
    fields = {}
    for x in lines:
        name, colon, value = x.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return (fields, end + len(END), int(length)) if length.isascii() and length.isdigit() and len(length) < 20 else None


def _candidates(data: bytes, low: int, end: int, cut: bool = False) -> Iterator[tuple[int, int | None]]:
    """(offset, content length) of what may be headers from ``low`` to the header end at ``end``, last first. ``cut``: the last line may go on behind ``end``.

    The lines are walked back once for all of them, so long headers and much magic before one end take time in proportion to their bytes.
    """
    length, known = None, False
    while end > low:
        line = data.rfind(b"\r\n", low, end)
        start = low if line < 0 else line + 2
        at = data.rfind(MAGIC, start, end)
        if at >= 0:
            version = data[at + len(MAGIC) : end]
            if version.isdigit() or cut and not version.rstrip(b"\r").strip(b"0123456789"):
                yield at, length
        colon = data.find(b":", start, end)
        if colon < 0 and not cut:
            return
        if not known and colon >= 0 and data[start:colon].strip().lower() == b"content-length":
            value, known = data[colon + 1 : end].strip(), True
            length = int(value) if value.isdigit() and len(value) < 20 else None
        if line < 0:
            return
        end, cut = line, False


def goes_on(data: bytes, limit: int) -> bool:
    """Whether a candidate before ``limit`` may have a header that ends behind ``data``."""
    last = data.rfind(END)
    low = last + 2 if last >= 0 else 0
    return low < limit and any(at < limit for at, _ in _candidates(data, low, len(data), True))


def range_edges(data: bytes, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """(offset, exit) of the candidates from ``start`` to ``end`` of a file of ``size`` bytes, of which ``data`` begins at ``start``:
    the exit is where the chain first leaves the range. Candidates whose chain breaks off inside it are left out."""
    following: dict[int, int] = {}
    low, close = 0, data.find(END)
    while close >= 0 and low < end - start:
        for at, length in _candidates(data, low, close):
            if at < end - start and length is not None and (after := start + close + length + 2 * len(END)) <= size:
                following[start + at] = after
        low, close = close + 2, data.find(END, close + 1)
    exits: dict[int, int] = {}
    for offset in sorted(following, reverse=True):
        after = following[offset]
        if after >= end:
            exits[offset] = after
        elif after in exits:
            exits[offset] = exits[after]
    return sorted(exits.items())


def _tasks(files: DataFrame, range_bytes: int) -> int:
    """A task for each range, up to ``MAX_TASKS``. The number is given, since adaptive execution would merge tasks by their few bytes of names."""
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0]
    return int(min(max(n or 1, 1), MAX_TASKS))


def reached(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``path, length, offset``: where the verified chains of the archives below ``path`` enter ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start")).repartition(_tasks(files, range_bytes), "path", "start")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["start"] + range_bytes, row["length"])
                with _open(row["path"]) as f:
                    data, more = f.read_at(min(end + WINDOW, row["length"]) - row["start"], row["start"]), WINDOW
                    while row["start"] + len(data) < row["length"] and goes_on(data, end - row["start"]):
                        data, more = data + f.read_at(min(more, row["length"] - row["start"] - len(data)), row["start"] + len(data)), 2 * more
                found = range_edges(data, row["start"], end, row["length"])
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]] * len(found), pa.string()), "length": pa.array([row["length"]] * len(found), pa.int64()), "offset": pa.array([o for o, _ in found], pa.int64()), "exit": pa.array([e for _, e in found], pa.int64())})

    jumps = materialize(ranges.mapInArrow(edges, "path string, length long, offset long, exit long"))
    starts = files.select("path", "length", F.lit(0).cast("long").alias("offset"))
    jumps = jumps.filter("exit < length").select("path", "offset", "exit")
    while not jumps.isEmpty():
        there = starts.join(jumps, ["path", "offset"]).select("path", "length", F.col("exit").alias("offset"))
        starts = materialize(starts.union(there).distinct())
        later = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("then"))
        jumps = materialize(jumps.join(later, ["path", "exit"]).select("path", "offset", F.col("then").alias("exit")))
    return starts


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """A row for each record that a chain reaches: ``path, offset, end`` (where the next one starts), ``record_type, record_id, refers_to_id, target_uri,
    payload_bytes, payload_digest`` (bare base32 SHA-1), ``digest_ok`` (what is stored has that digest; null for revisits),
    ``payload`` if asked for.

    A file that is cut off gives the records up to there; ``broken`` names such files. Files are read by ranges of ``range_bytes`` with pyarrow's file
    systems; a task holds one range and one record. Headers may be of any length. An empty folder's files give no rows.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = min((row["offset"] // range_bytes + 1) * range_bytes, row["length"])
                made: dict[str, list] = {n: [] for n in schema.names}
                with _open(row["path"]) as f:
                    at, held, base = row["offset"], b"", row["offset"]
                    while at < end:
                        if at + WINDOW > base + len(held) and base + len(held) < row["length"]:
                            base, held = at, f.read_at(min(max(WINDOW, range_bytes), row["length"] - at), at)
                        while base + len(held) < row["length"] and held.find(END, at - base) < 0:
                            base, held = at, f.read_at(min(2 * (base + len(held) - at), row["length"] - at), at)
                        head = _header(held, at - base)
                        if head is None:
                            break
                        fields, content, length = head
                        after = base + content + length + len(END)
                        if after > row["length"]:
                            break
                        block = held[content : content + length]
                        if len(block) < length:
                            block = f.read_at(length, base + content)
                        http, _, payload = block.partition(END) if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        revisit, n, own = fields.get("warc-type") == "revisit", len(payload), None
                        if revisit:
                            n = next((int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"), 0)
                        else:
                            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        values = (row["path"], at, after, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), n, digest or own, None if revisit else own == (digest or own), payload)
                        for name, value in zip(schema.names, values, strict=False):
                            made[name].append(value)
                        if len(made["path"]) >= BATCH or with_payload and len(payload) > 1 << 22:
                            yield pa.RecordBatch.from_pydict(made, schema=schema)
                            made = {n: [] for n in schema.names}
                        at = after
                yield pa.RecordBatch.from_pydict(made, schema=schema)

    fields = [("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)
    sql = "path string, offset long, end long, record_type string, record_id string, refers_to_id string, target_uri string, payload_bytes long, payload_digest string, digest_ok boolean" + ", payload binary" * with_payload
    starts = reached(spark, path, range_bytes)
    return starts.repartition(_tasks(starts.dropDuplicates(["path"]), range_bytes), "path", "offset").mapInArrow(records, sql)


def broken(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """``path, length, end`` of the archives below ``path`` whose chain of ``records`` (of ``read_warc``) stops at ``end``, before
    the file does: what lies behind wasn't read. Whole and empty files give no row; one without any record ends at 0.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ends = records.groupBy("path").agg(F.max("end").alias("end"))
    return files.join(ends, "path", "left").select("path", "length", F.coalesce("end", F.lit(0).cast("long")).alias("end")).filter("end < length")


def round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id") -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them and returns
    ``id_col, payload_bytes, payload_digest, record_type, refers_to`` of each record, with ``digest_ok``."""
    path = shared_dir(pages.sparkSession)
    write_warc(pages, path, least, id_col)
    number = lambda c: F.expr(f"CASE WHEN startswith({c}, '<urn:x-page:') THEN try_cast(url_decode(regexp_extract({c}, '^<urn:x-page:(.*)>$', 1)) AS {kind}) END")
    kind = pages.schema[id_col].dataType.simpleString()
    return read_warc(pages.sparkSession, path).select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), "digest_ok")
