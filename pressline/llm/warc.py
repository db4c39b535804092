"""WARC archives of pages and one globally ordered index of their captures.

A page becomes a record in input order: a response with its payload, or a revisit
where an equal payload is kept elsewhere. Records are written by Spark's own
text writer, a record per row and the record end as line separator, in segments
of bounded size, each one gzip stream: a record is reached through its segment.
Reading a segment back gives its index entries; a task sorts those of its
segments, which is one capture run.

Runs are merged externally. Splitters sampled from the runs cut the order of (URL
key, time, page) into ranges; a run sends each range its slice as one block, and
a loser tree merges the blocks of a range. Range numbers and places in ranges
add up to one position over all captures, so each URL's history is in order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_file
from .shared import by_bucket, dealt, staged

#: Bytes of records in a segment before compression; a longer record has a segment of its own.
SEGMENT_BYTES = 16 << 20
#: Sampled keys for each range of the merge, and most entries of a range on average.
SAMPLE_KEYS, RANGE_ENTRIES = 20, 200_000
#: Entries that a task deals to blocks at a time.
DEAL_ENTRIES = 100_000
#: Without a time column, pages count as captured one second apart from here on; the clock returns after ``CLOCK`` seconds.
FIRST_CAPTURE, CLOCK = datetime(2020, 1, 1, tzinfo=UTC), 1 << 31

#: Fixed values of the format.
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.DOTALL)

ENTRY = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, segment string, record_offset long, record_bytes long"
FIELDS = [c.split()[0] for c in ENTRY.split(", ")]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form: host from right to left, port, path and query, without scheme, user and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def record(page: int | None, url: str | None, seconds: int | None, html: str, digest: str, first: int | None) -> str:
    """One record without its end; ``first`` names the response that a revisit refers to."""
    payload = html.encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    date = FIRST_CAPTURE + timedelta(seconds=(seconds or 0) % CLOCK)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        # white space and controls cannot stand in a header
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: {_urn(first)}", f"WARC-Profile: {PROFILE}"]
    length = len(answer) + (len(payload) if first is None else 0)
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(head) + RECORD_END + answer + (html if first is None else "")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with the number of their segment within the task."""
    segment = held = 0
    for batch in batches:
        out: list[tuple[str, int]] = []
        for row in batch.to_pylist():
            html = row["html"]
            text = record(row["page_id"], row["url"], row["seconds"], html, payload_digest(html.encode()), row["first"])
            if held and held + len(text) > SEGMENT_BYTES:
                segment, held = segment + 1, 0
            held += len(text)
            out.append((text, segment))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.large_string()).cast(pa.string()), pa.array([s for _, s in out], pa.int32())], ["value", "segment"])


def write_archives(pages: DataFrame, folder: str, captured: Column | None = None) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``.

    Of equal payloads the row with the smallest page_id is a response and the
    others revisit it; rows that repeat this id and payload are responses too.
    A payload without any id is a response each time. A null payload is empty.
    ``captured``: seconds since 2020; by default the page_id.
    """
    page = F.col("page_id").cast("long")
    rows = pages.select(
        page.alias("page_id"),
        F.col("url").cast("string").alias("url"),
        (page if captured is None else captured).cast("long").alias("seconds"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("key", F.sha2("html", 256))
    # one small row for each repeated payload; a payload of very many pages is combined before the shuffle,
    # and adaptive execution splits its side of the join
    repeated = rows.groupBy("key").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null").select("key", "least")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("least")), F.col("least")).alias("first")
    marked = rows.join(repeated, "key", "left").select("page_id", "url", "seconds", "html", first)
    records = marked.mapInArrow(_records, "value string, segment int")
    records.write.partitionBy("segment").option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, header fields, block) of each record of a segment."""
    at = 0
    while at < len(content):
        head = RECORD.match(content, at)
        if not head:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in head[1].decode().split("\r\n"))
        stop = head.end() + int(fields["Content-Length"])
        if content[stop : stop + 4] != RECORD_END.encode():
            raise ValueError(f"the record at byte {at} does not end at byte {stop}")
        yield at, stop - at, fields, content[head.end() : stop]
        at = stop + 4


def _entry(path: str, at: int, size: int, fields: dict[str, str], block: bytes) -> tuple:
    """Index entry of a record; a payload that is not the one of its digest is an error."""
    answer, payload = block.split(b"\r\n\r\n", 1)
    length = int(re.search(rb"Content-Length: (\d+)", answer)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload in {path} at byte {at}")
    url = fields.get("WARC-Target-URI")
    refers = _page(fields.get("WARC-Refers-To"))
    return (url_key(url), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], refers, length, digest, path, at, size)


def _order(entry: tuple) -> tuple:
    """URL key, time and page, then the place of the record; a missing page comes first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            yield path.as_py(), gzip.decompress(content.as_py())


def _table(entries: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries, strict=True) if entries else [[]] * len(kinds), kinds, strict=True)], FIELDS)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """(path, compressed content) of each segment; a segment's size is bounded when it is written."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) as read back; a revisit gets the payload of its response."""

    def read(batches):
        for path, content in _segments(batches):
            rows = []
            for at, size, fields, block in parse(content):
                entry = _entry(path, at, size, fields, block)
                own = block.split(b"\r\n\r\n", 1)[1].decode() if entry[4] == "response" else None
                rows.append((entry[2], entry[3], own, entry[5]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "own", "refers_to"])

    found = segments(spark, folder).mapInArrow(read, "page_id long, url string, own string, refers_to long")
    kept = found.where("own is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.first("own").alias("kept"))
    return found.join(kept, "refers_to", "left").select("page_id", "url", F.coalesce("own", "kept").alias("html"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a task's segments in order: a capture run."""
    run = sorted((_entry(path, *found) for path, content in _segments(batches) for found in parse(content)), key=_order)
    for a in range(0, len(run), 10_000):
        yield _table(run[a : a + 10_000])


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner moves on."""

    def __init__(self, runs: list[list[tuple]], key=_order):
        self.runs, self.key, self.k = runs, key, max(len(runs), 1)
        self.at = [0] * len(runs)
        self.heads = [self._head(i) for i in range(len(runs))]
        self.losers = [0] * self.k
        self.winner = self._play(1) if runs else 0

    def _head(self, run: int):
        entries = self.runs[run]
        return (self.key(entries[self.at[run]]), run) if self.at[run] < len(entries) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _play(self, node: int) -> int:
        """Winner below ``node``; leaves follow the ``k`` nodes."""
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            node = (run + self.k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merged(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
    bucket, place, held = blocks[0]["bucket"], 0, []
    for entry in LoserTree([[tuple(e) for e in json.loads(b["entries"])] for b in blocks]):
        held.append(entry)
        if len(held) == 10_000:
            yield _placed(held, bucket, place)
            place, held = place + len(held), []
    if held:
        yield _placed(held, bucket, place)


def _placed(entries: list[tuple], bucket: int, place: int) -> pa.RecordBatch:
    out = _table(entries)
    n = len(entries)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array([bucket] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())], [*FIELDS, "bucket", "place"])


def capture_index(spark: SparkSession, folder: str, ranges: int | None = None) -> DataFrame:
    """One entry per record below ``folder``, with its ``position`` in the order of (url_key, captured, page_id).

    There are ``ranges`` (by default the number of shuffle partitions), or more
    where they would exceed ``RANGE_ENTRIES``; the driver holds ``SAMPLE_KEYS``
    sampled keys for each, that is one key for 10,000 records of a large index.
    A task holds the entries of its own segments, or of one range. A URL with very many
    captures is cut by time and page like any other. No archives, or empty ones,
    give no rows.
    """
    runs = staged(segments(spark, folder).mapInArrow(_runs, ENTRY), "capture-runs")
    entries = runs.count()
    ranges = max(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), entries // RANGE_ENTRIES)
    share = min(1.0, SAMPLE_KEYS * ranges / max(entries, 1))
    sample = sorted(_order(tuple(r)) for r in runs.sample(share, 7).collect())
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def deal(batches):
        held: dict[int, list[tuple]] = {}
        count = 0

        def blocks():
            for bucket, slice_ in sorted(held.items()):
                # reading may put several runs, or parts of one, into a task; a block is sorted as a whole
                slice_.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([json.dumps(slice_)])], ["bucket", "entries"])
            held.clear()

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bisect_left(splitters, _order(entry)), []).append(entry)
            count += batch.num_rows
            if count >= DEAL_ENTRIES:
                yield from blocks()
                count = 0
        yield from blocks()

    blocks = runs.mapInArrow(deal, "bucket int, entries string")
    merge = lambda batches: by_bucket(batches, _merged)
    merged = staged(dealt(blocks, ranges).mapInArrow(merge, f"{ENTRY}, bucket int, place long"), "capture-index")
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = merged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", before.alias("begin"))
    return merged.join(F.broadcast(begin), "bucket").select(*FIELDS, (F.col("begin") + F.col("place")).alias("position"))


def captures(pages: DataFrame, captured: Column | None = None, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return their index.

    One row per row of ``pages``; see :func:`write_archives` for nulls, ties and
    repeated rows. Further columns are not archived. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or shared_file(spark, "archives")
    write_archives(pages, folder, captured)
    return capture_index(spark, folder)
