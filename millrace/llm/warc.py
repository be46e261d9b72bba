"""WARC archives of pages, and their captures as one globally ordered history.

Writing: equal payloads of ``least`` bytes and more are one response, that of the smallest id, and revisits of it. Each task
writes archives of bounded size, one gzip member per record, under names of its own attempt; the list of archives
is a table, so what a lost attempt wrote is never read.

Reading: a task reads one archive from front to end, checks each payload against its digest, and gives the captures
sorted by URL key and time: one run. Runs are stored, cut by key ranges, and the pieces of all runs that fall in a range are
merged by a loser tree, so that the ranges one after another are the whole history in order.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import hot_keys, join_apart
from millrace.session import file_store, fresh_dir, stage

LEAST_BYTES = 100
# Uncompressed payload after which a task begins another archive, and captures in one key range.
ARCHIVE_BYTES = 64 << 20
RANGE_ROWS = 200_000
# Fixed value: the time of the capture whose id is 0; a capture is one second later per id where no time is given.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
# About 1,900 years: ids further from 0 are captured at the time of id 0, as years have four digits.
MAX_SECOND = 60_000_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "url_key string, capture_ts string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, archive string, position bigint, run bigint"
)
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: pages of a site and its parts lie together."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return ""
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else ""


def record(page_id: int | None, url: str | None, time: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the HTTP header alone and says how long the payload was."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {time}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_record_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html, time) with ``_digest, _first``; the latter is null where nothing is revisited.

    Payloads under ``least`` bytes take part in no join. Of the others, those that hold a large share of all copies stay where they
    are and meet the broadcast list of their first ids (``hot_keys``, at most 2,000); only the rest are shuffled by their digest.
    """
    html = F.coalesce("html", F.lit(""))
    marked = pages.withColumns({"_digest": F.sha2(html, 256), "_bytes": F.octet_length(html)})
    long, short = marked.where(F.col("_bytes") >= least).drop("_bytes"), marked.where(F.col("_bytes") < least).drop("_bytes")
    # Combined before it is shuffled: one row per payload and task.
    found = long.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = stage(found.where("_n > 1"), "payload-firsts")
    hot = stage(hot_keys(firsts, "_digest", "_n"), "payload-hot")
    return join_apart(long, firsts.drop("_n"), "_digest", hot, "left").unionByName(short.withColumn("_first", F.lit(None).cast("bigint")))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, time`` as archives in ``folder``; returns the stored list ``archive, records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(folder)
        store.create_dir(root, recursive=True)
        out, path, held, n = None, "", 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None or held >= archive_bytes:
                        yield from close()
                        path, held, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{path.rsplit('/', 1)[-1]}", compression=None)
                    payload = (row["html"] or "").encode()
                    first, page = row["_first"], row["page_id"]
                    revisit = first is not None and first != page
                    raw = record(page, row["url"], row["time"], payload, row["_digest"], first, revisit)
                    out.write(gzip.compress(raw, 3, mtime=0))
                    held += len(raw)
                    n += 1
        yield from close()

    rows = with_record_types(pages, least).select("page_id", "url", "html", "time", "_digest", "_first")
    return stage(rows.mapInArrow(write, "archive string, records bigint"), "archives")


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position of the gzip member, header fields in lower case, block) of each record of an archive."""
    inflate, raw, start, at = zlib.decompressobj(31), [], 0, 0
    for chunk in chunks:
        at += len(chunk)
        while chunk:
            raw.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if not inflate.eof:
                break
            whole = b"".join(raw)
            head, _, rest = whole.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no record at {start}")
            fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
            yield start, fields, rest[: int(fields["content-length"])]
            inflate, raw, start = zlib.decompressobj(31), [], at - len(chunk)
    if b"".join(raw):
        raise ValueError(f"cut record at {start}")


def _page(name: str) -> int | None:
    found = name.strip("<>").rsplit(":", 1)[-1]
    return int(found) if found else None


def read_archives(archives: DataFrame) -> DataFrame:
    """The captures of all archives. Each archive is one run: sorted by URL key, time and id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, root = file_store(path)
                run = int.from_bytes(hashlib.sha256(path.encode()).digest()[:7], "big")
                rows = []
                with store.open_input_stream(root, compression=None) as file:
                    for position, fields, block in read_records(iter(lambda: file.read(1 << 20), b"")):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path} at {position}: payload and digest differ")
                        rows.append((
                            url_key(fields.get("warc-target-uri")), fields["warc-date"], _page(fields["warc-record-id"]), size, digest, kind,
                            _page(fields["warc-refers-to"]) if kind == "revisit" else None, path, position, run,
                        ))
                rows.sort(key=_order)
                for at in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 8192]), _TYPES)], _NAMES)

    return archives.select("archive").mapInArrow(read, CAPTURE)


_TYPES = [pa.string() if " string" in c else pa.int64() for c in CAPTURE.split(", ")]


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[9], row[8]


class LoserTree:
    """Merges sorted runs. Each inner place keeps the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        one, two = self.heads[a], self.heads[b]
        if one is None or two is None:
            return two is None and (one is not None or a < b)
        return (_order(one), a) < (_order(two), b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # still being built: the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def ascending(rows: list[tuple]) -> list[list[tuple]]:
    """Rows of one run as they came, cut where their order breaks."""
    out: list[list[tuple]] = []
    for row in rows:
        if out and _order(out[-1][-1]) <= _order(row):
            out[-1].append(row)
        else:
            out.append([row])
    return out


def merged_history(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order: by ``history_part``, then ``history_pos``. Ranges are cut by the whole key, so a hot URL is split."""
    n = runs.count()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(row[9], []).append(row)
        pieces = [piece for run in sorted(held) for piece in ascending(held[run])]
        held.clear()
        out, position = [], 0
        for row in LoserTree([iter(p) for p in pieces]):
            out.append((*row, part, position))
            position += 1
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    types, names = [*_TYPES, pa.int64(), pa.int64()], [*_NAMES, "history_part", "history_pos"]
    ranged = runs.repartitionByRange(max(1, -(-n // range_rows)), "url_key", "capture_ts", "page_id", "run", "position")
    return ranged.mapInArrow(merge, f"{CAPTURE}, history_part bigint, history_pos bigint")


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as ``yyyy-MM-ddTHH:mm:ssZ``, whatever the session's zone; null where they are."""
    clock = F.pmod(seconds, F.lit(86400).cast("bigint"))
    day = F.date_from_unix_date(F.call_function("div", seconds - clock, F.lit(86400)).cast("int")).cast("string")
    parts = [F.call_function("div", clock, F.lit(3600)), F.call_function("div", clock, F.lit(60)) % 60, clock % 60]
    return F.when(seconds.isNotNull(), F.format_string("%sT%02d:%02d:%02dZ", day, *parts))


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    least: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    range_rows: int = RANGE_ROWS,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    time_col: str | None = None,
) -> DataFrame:
    """Write pages as WARC archives, read them back, and give the merged history: one row per page.

    A null html is an empty payload; empty and other payloads under ``least`` bytes are responses each. Where several rows have the
    smallest id of equal payloads, each of them is a response. A null id is never smallest: such a row is a revisit where an
    equal payload has an id, else a response. A null or unreadable url has an empty key and sorts first. Repeated rows are
    captures of their own; no rows give none. Other columns are not passed on. Times are written in UTC; a time column without a
    zone is of the session's, and a null time is empty.
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    if time_col is None:
        page = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))
        seconds = F.lit(int(FIRST_CAPTURE.timestamp())) + F.when(page.between(-MAX_SECOND, MAX_SECOND), page).otherwise(0)
    else:
        seconds = F.unix_seconds(F.col(time_col).cast("timestamp"))
    time = utc_text(seconds.cast("bigint"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(time, F.lit("")).alias("time"))
    archives = write_archives(rows, folder, least, archive_bytes)
    n = archives.count()
    runs = stage(read_archives(archives.repartition(max(1, n))), "capture-runs")
    return merged_history(runs, range_rows)
