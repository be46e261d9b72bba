"""Indexed shard files: many shards in a file, found through an index, as a table and as a stream by shard number.

A store is a folder. ``data`` has the files of all publications, ``index`` tables with one row per shard that say where it is, and
``snapshots`` one small file per publication, numbered without gaps, that names the index files that count. A publication
is there once its snapshot is, so what was not finished is never seen, and readers never list a folder of data.

The stream's offset is ``next``, the number below which all shards are taken, and ``version``, the newest publication
looked at. What lies between two offsets follows from the index alone: the shards from ``next`` on, and those of a lower number that
were published after ``version``. So a micro-batch that runs again, or a restart, takes the same ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.files import qualified
from millrace.schemas import SAMPLE
from millrace.session import file_store

SOURCE = "millrace_shards"
PIECE_BYTES = 2 * 1024 * 1024
PIECES = 16
RAW_SCHEMA = "shard_id bigint, length bigint, words array<bigint>"
INDEX = "shard_id bigint, file string, first bigint, size bigint, n bigint, bytes bigint, last bigint, version bigint, published_us bigint"
INDEX_NAMES = [column.split()[0] for column in INDEX.split(", ")]
_START = {"next": 0, "version": 0}


def snapshot_file(version: int) -> str:
    return f"snapshots/{version}.json"


class Store:
    """A store as tasks and the stream's process see it, through Arrow's file systems."""

    def __init__(self, path: str) -> None:
        self.files, self.root = file_store(path)
        self.held: dict = {}

    def has(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound

    def text(self, name: str) -> str:
        with self.files.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()

    def newest(self) -> dict:
        """The newest snapshot: a few looks from the last one seen, none at a folder."""
        at = self.held.get("version", -1)
        if at < 0:
            # Doubling steps, then halves, for snapshots are numbered without gaps.
            if not self.has(snapshot_file(0)):
                raise FileNotFoundError(f"{self.root} is no store")
            at, step = 0, 1
            while self.has(snapshot_file(at + step)):
                at, step = at + step, 2 * step
            while step:
                if self.has(snapshot_file(at + step)):
                    at += step
                step //= 2
        while self.has(snapshot_file(at + 1)):
            at += 1
        if at != self.held.get("version"):
            self.held = json.loads(self.text(snapshot_file(at)))
        return self.held

    def rows(self, snapshot: dict, low: int, high: int | None, after: int = -1, columns: list[str] | None = None) -> pa.Table:
        """Index rows of the shards from ``low`` to below ``high`` of publications after ``after``, by number."""
        wanted = [
            p for p in snapshot["index"] if p["high"] >= low and (high is None or p["low"] < high) and p["version"] > after
        ]
        held = pa.schema([("shard_id", pa.int64()), ("file", pa.string()), ("first", pa.int64()), ("size", pa.int64()), ("n", pa.int64()),
                          ("bytes", pa.int64()), ("last", pa.int64()), ("version", pa.int64()), ("published_us", pa.int64())])
        parts = [held.empty_table()]
        where = [("shard_id", ">=", low), ("version", ">", after)] + ([("shard_id", "<", high)] if high is not None else [])
        for p in wanted:
            parts.append(pq.read_table(f"{self.root}/{p['file']}", filesystem=self.files, filters=where, schema=held))
        return pa.concat_tables(parts).sort_by("shard_id").select(columns or held.names)

    def held_files(self, low: int, high: int) -> tuple[list[str], bool]:
        """Files that hold the shards from ``low`` to ``high``, both included, and were not retired, and whether they hold no others."""
        rows = self.rows(self.newest(), low, high + 1, columns=["file", "first", "last", "version"])
        gone = json.loads(self.text("retired.json")) if self.has("retired.json") else dict(_START)
        kept = rows.filter(~((pa.compute.field("last") < gone["next"]) & (pa.compute.field("version") <= gone["version"]))).to_pylist()
        files = {row["file"] for row in kept}
        # Shards lie in a file by number, so the first and the last one say what else is in it.
        whole = all(row["last"] <= high for row in kept) and files == {row["file"] for row in kept if row["first"] == 0}
        return sorted(files), whole

    def numbers(self, snapshot: dict, low: int, count: int) -> list[int]:
        """The lowest ``count`` numbers from ``low`` on."""
        found: list[int] = []
        reach = max(4 * count, 1024)
        while len(found) < count:
            above = [p for p in snapshot["index"] if p["high"] >= low]
            if not above:
                break
            low = max(low, min(p["low"] for p in above))
            found += self.rows(snapshot, low, low + reach, columns=["shard_id"])["shard_id"].to_pylist()
            low, reach = low + reach, 2 * reach
        return found[:count]


class Piece(InputPartition):
    """Shards of one file: (file, [(number, first, size)])."""

    def __init__(self, file: str, shards: list[tuple[int, int, int]]) -> None:
        super().__init__((file, shards))
        self.file, self.shards = file, shards


def read_rows(store: Store, file: str, shards: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of some shards of a columnar file, of only those row groups that hold them."""
    numbers = pa.array([s for s, _, _ in shards], pa.int64())
    begin, end = min(f for _, f, _ in shards), max(f + n for _, f, n in shards)
    with store.files.open_input_file(f"{store.root}/{file}") as opened:
        table = pq.ParquetFile(opened)
        sizes = np.array([table.metadata.row_group(g).num_rows for g in range(table.num_row_groups)])
        ends = np.cumsum(sizes)
        groups = [g for g in range(len(sizes)) if ends[g] > begin and ends[g] - sizes[g] < end]
        for batch in table.iter_batches(batch_size=1024, row_groups=groups, columns=[f.name for f in SAMPLE.fields]):
            held = batch.filter(pa.compute.is_in(batch.column("shard_id"), value_set=numbers))
            if held.num_rows:
                yield held


def read_words(store: Store, file: str, shards: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """One row per shard: its bytes out of a file of raw words."""
    with store.files.open_input_file(f"{store.root}/{file}") as opened:
        for number, first, size in shards:
            opened.seek(first)
            words = np.frombuffer(opened.read(size), "<i8")
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), listed], ["shard_id", "length", "words"])


def _cut(shards: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Shards of a file of raw words in runs of PIECE_BYTES, but at most PIECES of them: its bytes are read where they lie, so tasks share them."""
    total = sum(size for *_, size in shards)
    runs: list[list[tuple[int, int, int]]] = []
    room, held = max(PIECE_BYTES, -(-total // PIECES)), 0
    for shard in shards:
        if not runs or held + shard[2] > room and len(runs) < PIECES:
            runs.append([])
            held = 0
        runs[-1].append(shard)
        held += shard[2]
    return runs


class ShardStream(DataSourceStreamReader):
    """Shards by number. ``at`` is where the stream stands; Spark says so again after a restart."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = options["path"]
        self.bound = int(options.get("maxInFlight", 0)) or None
        self.wait = options.get("gaps", "skip") == "wait"
        self.retire = options.get("retire", "false") == "true"
        self.at: dict | None = None
        self.store: Store | None = None

    def _store(self) -> Store:
        if self.store is None:
            self.store = Store(self.path)
        return self.store

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        store, at = self._store(), self.at or dict(_START)
        snapshot = store.newest()
        if snapshot["version"] > at["version"]:
            # What came late is taken first, publication by publication.
            late = store.rows(snapshot, 0, at["next"], at["version"], ["version"])["version"]
            if len(late):
                return {"next": at["next"], "version": pa.compute.min(late).as_py()}
        if self.bound is None:
            highest = max((p["high"] for p in snapshot["index"]), default=-1)
            if highest < at["next"]:
                return at
            if not self.wait:
                return {"next": highest + 1, "version": snapshot["version"]}
        numbers = store.numbers(snapshot, at["next"], self.bound or 1 << 20)
        if self.wait and not snapshot["ended"]:
            there = np.array(numbers, np.int64)
            numbers = numbers[: int((there == at["next"] + np.arange(len(there))).cumprod().sum())]
        return {"next": numbers[-1] + 1, "version": snapshot["version"]} if numbers else at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = dict(end)
        if start == end:
            return []
        store = self._store()
        snapshot = store.newest()
        found = [store.rows(snapshot, start["next"], end["next"])]
        if end["version"] > start["version"]:
            found.append(store.rows(snapshot, 0, start["next"], start["version"]))
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for table in found:
            for row in table.select(["file", "shard_id", "first", "size", "version"]).to_pylist():
                if row["version"] <= end["version"]:
                    pieces.setdefault(row["file"], []).append((row["shard_id"], row["first"], row["size"]))
        return [Piece(file, part) for file, shards in pieces.items() for part in (_cut(shards) if file.endswith(".words") else [shards])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        yield from (read_words if partition.file.endswith(".words") else read_rows)(store, partition.file, partition.shards)

    def commit(self, end: dict) -> None:
        if self.retire:
            retire_taken(self._store(), end)


class ShardSource(DataSource):
    """``spark.readStream.format("millrace_shards")`` with the options path, kind, maxInFlight, gaps and retire."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return RAW_SCHEMA if self.options.get("kind") == "raw" else SAMPLE.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def streamReader(self, schema) -> ShardStream:
        return ShardStream(self.options)


def retire_taken(store: Store, taken: dict) -> int:
    """Delete the files all of whose shards are taken; returns how many. Readers of tables pass them over from then on.

    ``retired.json`` says first what is going to go, so a run that stops half-way is finished by the next one.
    """
    before = json.loads(store.text("retired.json")) if store.has("retired.json") else {"done": dict(_START)}
    done = before["done"]
    _put(store, {"next": taken["next"], "version": taken["version"], "done": done})
    snapshot = store.newest()
    found = [store.rows(snapshot, done["next"], taken["next"], -1, ["file", "shard_id", "last", "version"])]
    found.append(store.rows(snapshot, 0, done["next"], done["version"], ["file", "shard_id", "last", "version"]))
    gone = 0
    for row in pa.concat_tables(found).to_pylist():
        name = f"{store.root}/{row['file']}"
        if row["shard_id"] == row["last"] and row["version"] <= taken["version"]:
            if store.files.get_file_info(name).type != fs.FileType.NotFound:
                store.files.delete_file(name)
                gone += 1
    _put(store, {"next": taken["next"], "version": taken["version"], "done": taken})
    return gone


def _put(store: Store, facts: dict) -> None:
    """Only the one consumer that retires writes this file."""
    temporary = f"{store.root}/retired.json.tmp"
    with store.files.open_output_stream(temporary) as out:
        out.write(json.dumps(facts).encode())
    if store.has("retired.json") and not isinstance(store.files, fs.LocalFileSystem):
        store.files.delete_file(f"{store.root}/retired.json")
    store.files.move(temporary, f"{store.root}/retired.json")


def stream_store(
    spark: SparkSession, path: str, kind: str = "typed", max_in_flight: int | None = None, gaps: str = "skip", retire: bool = False
) -> DataFrame:
    """The shards of a store as a stream, lowest number first, at most ``max_in_flight`` in a micro-batch.

    Numbers that are not there are passed over, and a shard that comes later is taken next, with others of its
    publication; with ``gaps="wait"`` the stream waits for them until the store has ended. ``retire`` deletes a file once all its
    shards are in committed micro-batches.
    """
    spark.dataSource.register(ShardSource)
    reader = spark.readStream.format(SOURCE).option("path", qualified(spark, path)).option("kind", kind).option("gaps", gaps)
    if max_in_flight:
        reader = reader.option("maxInFlight", max_in_flight)
    return reader.option("retire", str(retire).lower()).load()


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The index as a table: one row per shard, with its publication and time; the publish log of the store."""
    path = qualified(spark, path)
    store = Store(path)
    names = [f"{path}/{p['file']}" for p in store.newest()["index"]]
    if not names:
        return spark.createDataFrame([], INDEX)
    rows = spark.read.schema(INDEX).parquet(*names)
    if not store.has("retired.json"):
        return rows
    gone = json.loads(store.text("retired.json"))
    return rows.withColumn("retired", (F.col("last") < gone["next"]) & (F.col("version") <= gone["version"])).where("NOT retired").drop("retired")


def shards_between(spark: SparkSession, path: str, low: int, high: int) -> list[int]:
    """Numbers from ``low`` to ``high``, both included, that have been published, read from the index without a job."""
    store = Store(qualified(spark, path))
    return store.rows(store.newest(), low, high + 1, columns=["shard_id"])["shard_id"].to_pylist()


def read_store(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Typed samples of the shards from ``low`` to ``high``, both included, from just the files that hold them.

    Shards that were retired are not there any more.
    """
    path = qualified(spark, path)
    span = " AND ".join([f"shard_id >= {low}"] * (low is not None) + [f"shard_id <= {high}"] * (high is not None)) or "true"
    if low is not None and high is not None:
        # Few shards, as a rule: their index rows are read here, without a job.
        found, whole = Store(path).held_files(low, high)
        names = [f"{path}/{file}" for file in found]
    else:
        # As many names as there are files of 100 MB and more in the span.
        names, whole = [f"{path}/{r.file}" for r in index_of(spark, path).where(span).select("file").distinct().collect()], False
    if not names:
        return spark.createDataFrame([], SAMPLE)
    rows = spark.read.schema(SAMPLE).parquet(*names)
    # Numbers go into the code that Spark makes, so a filter is a piece of code to compile for each span.
    return rows if whole else rows.where(span)


def read_raw_store(spark: SparkSession, path: str) -> DataFrame:
    """``shard_id, length, words`` of all shards of a store of raw words; a task reads the shards of one file together."""
    path = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(path)
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_words(store, row["file"], [(row["shard_id"], row["first"], row["size"])])

    rows = index_of(spark, path).select("file", "shard_id", "first", "size")
    return rows.repartition("file").sortWithinPartitions("file", "first").mapInArrow(run, RAW_SCHEMA)
