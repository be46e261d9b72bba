"""Publishing shards into indexed files: one switch makes all of a publication visible."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import CAP_BYTES, WORD_BYTES
from millrace.files import publish_text, qualified
from millrace.session import file_store, stage
from millrace.sinks.log import put_rows
from millrace.sources.store import INDEX, INDEX_NAMES, Store, snapshot_file

# Words of 8 bytes; as columns they take a third of that or less, so files come out at 100 MB and more.
FILE_BYTES = 512 * 1024 * 1024
INDEX_ROWS = 4_000_000
# Bytes of a row group, as Parquet writes it: readers of single shards decode the groups that hold them, and no more of a file.
GROUP_BYTES = 1024 * 1024
INDEX_GROUP_BYTES = 256 * 1024
# So many index files of single publications are merged into one table.
MERGE_AT = 16
# Bytes that one task holds of a few shards, and rows of index files that the driver merges.
FEW_BYTES = 64 * 1024 * 1024
MERGE_ROWS = 20_000
PLACES = "shard_id bigint, file string, first bigint, size bigint"
FEW = f"{PLACES}, n bigint, bytes bigint"


def create_store(spark: SparkSession, path: str, kind: str = "typed") -> str:
    """An empty store, for readers that start before the first shard; FileExistsError where there is one."""
    path = qualified(spark, path)
    publish_text(spark, f"{path}/{snapshot_file(0)}", json.dumps({"version": 0, "kind": kind, "ended": False, "index": []}))
    return path


def _next_snapshot(spark: SparkSession, path: str, now: dict, **changes) -> dict:
    """Switch to the next snapshot. Of two that are based on one, the second fails, and what it wrote is never seen."""
    snapshot = {**now, **changes, "version": now["version"] + 1}
    publish_text(spark, f"{path}/{snapshot_file(snapshot['version'])}", json.dumps(snapshot))
    return snapshot


def sizes_of(samples: DataFrame) -> DataFrame:
    """``shard_id, n, bytes``: what each shard takes on the wire."""
    words = (F.size("x").cast("bigint") + 1) * WORD_BYTES
    return samples.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("bytes"))


def publish(
    samples: DataFrame,
    path: str,
    kind: str = "typed",
    cap: int | None = None,
    file_bytes: int = FILE_BYTES,
    merge_at: int = MERGE_AT,
    few: bool = False,
) -> DataFrame:
    """Add the shards of ``shard_id, sample_id, pos_in_shard, x, y`` to a store; returns their index rows, the publish log.

    Sizes are looked at before the first byte is written: a shard of ``cap`` bytes or more (by default for raw words
    only) is refused, and with it the publication. A shard number is published once. Rows of a shard lie together in one file, and a file holds a run of
    shards of about ``file_bytes``. Two publications at once exclude each other: one of them fails. No rows
    publish nothing. ``few`` says that these are a few shards out of many, for which ``publish_few`` tells what it costs.
    """
    spark = samples.sparkSession
    if few:
        index = publish_few(samples, path, kind, cap, file_bytes, merge_at)
        return spark.createDataFrame(index.to_pylist(), INDEX)
    path = qualified(spark, path)
    now = _open(path, kind)
    cap = CAP_BYTES if cap is None and kind == "raw" else cap
    sizes = stage(sizes_of(samples), "publish-sizes")
    low, high, total, most, count = sizes.agg(F.min("shard_id"), F.max("shard_id"), F.sum("bytes"), F.max("bytes"), F.count(F.lit(1))).first()
    if low is None:
        return spark.createDataFrame([], INDEX)
    _refuse(most, cap)
    parts = max(1, -(-total // file_bytes))
    span = -(-(high - low + 1) // parts)
    folder = f"data/{uuid.uuid4().hex}"
    version, when = now["version"] + 1, time.time_ns() // 1000
    group = F.expr(f"cast((shard_id - {low}L) div {span}L as int)")
    dealt = samples.select("shard_id", "sample_id", "pos_in_shard", "x", "y").repartitionById(parts, group).sortWithinPartitions("shard_id", "pos_in_shard")
    places = _write_rows(dealt, path, folder) if kind == "typed" else _write_words(dealt, path, folder)
    # Tasks that ran twice may have left a second file; the index knows only one.
    last = places.groupBy("file").agg(F.max("shard_id").alias("last"))
    rows = places.join(sizes, "shard_id").join(last, "file").select(
        "shard_id", "file", "first", "size", "n", "bytes", "last", F.lit(version).cast("bigint").alias("version"), F.lit(when).cast("bigint").alias("published_us")
    )
    index = [*now["index"], *_write_index(rows, path, low, high, count)]
    if len(index) > merge_at:
        index = _merge_index(spark, path, index)
    _next_snapshot(spark, path, now, index=index)
    newest = [f"{path}/{p['file']}" for p in index if p["version"] >= version]
    return spark.read.schema(INDEX).parquet(*newest).where(F.col("version") == version)


def _open(path: str, kind: str) -> dict:
    """The newest snapshot of a store that takes shards of this kind."""
    now = Store(path).newest()
    if now["ended"] or now["kind"] != kind:
        raise ValueError(f"{path} has ended or holds {now['kind']} shards")
    return now


def _refuse(most: int, cap: int | None) -> None:
    if cap is not None and most >= cap:
        raise ValueError(f"a shard has {most} bytes, allowed are 1 to {cap - 1}")


def _merge_index(spark: SparkSession, path: str, index: list[dict]) -> list[dict]:
    held = spark.read.schema(INDEX).parquet(*[f"{path}/{p['file']}" for p in index])
    return _write_index(held, path, min(p["low"] for p in index), max(p["high"] for p in index), sum(p["rows"] for p in index))


def publish_few(
    samples: DataFrame, path: str, kind: str = "typed", cap: int | None = None, file_bytes: int = FILE_BYTES, merge_at: int = MERGE_AT
) -> pa.Table:
    """``publish`` of a few shards out of many, in one job; returns their index rows.

    One task holds them, looks at their sizes and writes them into one file; the driver indexes it without a job, and merges index files
    of ``MERGE_ROWS`` rows at most itself. Shards of more than ``FEW_BYTES`` or of several files are published as many are.
    """
    spark = samples.sparkSession
    path = qualified(spark, path)
    _open(path, kind)
    places = write_few(samples, path, kind, cap, file_bytes)
    if places["file"].null_count:
        return publish(samples, path, kind, cap, file_bytes, merge_at).toArrow()
    return publish_written(spark, places, path, kind, merge_at)


def write_few(samples: DataFrame, path: str, kind: str = "typed", cap: int | None = None, file_bytes: int = FILE_BYTES) -> pa.Table:
    """The first half of ``publish_few``: a file that is not seen yet. Returns its rows of ``FEW``, without a file where the shards are too many."""
    path = qualified(samples.sparkSession, path)
    cap = CAP_BYTES if cap is None and kind == "raw" else cap
    folder = f"data/{uuid.uuid4().hex}"
    rows = samples.select("shard_id", "sample_id", "pos_in_shard", "x", "y").coalesce(1)
    places = rows.mapInArrow(_few_writer(path, kind, folder, cap, min(file_bytes, FEW_BYTES)), FEW).toArrow()
    _refuse(pa.compute.max(places["bytes"]).as_py() or 0, cap)
    return places


def publish_written(spark: SparkSession, places: pa.Table, path: str, kind: str = "typed", merge_at: int = MERGE_AT) -> pa.Table:
    """The second half of ``publish_few``: from now on the shards of the file are seen. Returns their index rows."""
    path = qualified(spark, path)
    now = _open(path, kind)
    if not places.num_rows:
        return _index_table([])
    version, when = now["version"] + 1, time.time_ns() // 1000
    last = places["shard_id"][-1].as_py()
    found = _index_table([(*row.values(), last, version, when) for row in places.to_pylist()])
    index = [*now["index"], _put_index(path, found)]
    if len(index) > merge_at:
        if sum(p["rows"] for p in index) > MERGE_ROWS:
            index = _merge_index(spark, path, index)
        else:
            index = [_put_index(path, Store(path).rows({"index": index}, min(p["low"] for p in index), None))]
    _next_snapshot(spark, path, now, index=index)
    return found


def _index_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in INDEX_NAMES]
    return pa.Table.from_arrays([pa.array(values, pa.string() if name == "file" else pa.int64()) for name, values in zip(INDEX_NAMES, columns)], INDEX_NAMES)


def _put_index(path: str, rows: pa.Table) -> dict:
    """An index file of ascending rows that the driver holds, and what a snapshot says of it."""
    file = f"index/{uuid.uuid4().hex}/rows.parquet"
    put_rows(rows, f"{path}/{file}")
    low, high = rows["shard_id"][0].as_py(), rows["shard_id"][-1].as_py()
    return {"file": file, "low": low, "high": high, "version": pa.compute.max(rows["version"]).as_py(), "rows": rows.num_rows}


def _few_writer(path: str, kind: str, folder: str, cap: int | None, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What writes a partition of ``most`` bytes at most into one file and says where each shard lies and what it takes, by number.

    Nothing is written, and no file named, where the partition has more or a shard has ``cap`` bytes or more.
    """
    words = _words_writer(path, folder)
    group_bytes = GROUP_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sizes: dict[int, tuple[int, int | None]] = {}
        total = 0
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("shard_id")))
            octets = pa.compute.multiply(pa.compute.add(pa.compute.list_value_length(batch.column("x")).cast(pa.int64()), 1), WORD_BYTES)
            found = pa.table({"shard": batch.column("shard_id"), "octets": octets}).group_by("shard").aggregate([([], "count_all"), ("octets", "sum")])
            for shard, n, size in zip(*[found[c].to_pylist() for c in ("shard", "count_all", "octets_sum")]):
                n0, size0 = sizes.get(shard, (0, None))
                sizes[shard] = (n0 + n, size0 if size is None else size + (size0 or 0))
                total += size or 0
            if total <= most:
                held.append(batch)
            else:
                held.clear()
        if not sizes:
            return
        shards = sorted(sizes)
        figures = [pa.array([sizes[s][k] for s in shards], pa.int64()) for k in (0, 1)]
        names = ["shard_id", "file", "first", "size", "n", "bytes"]
        if total > most or cap is not None and max(size or 0 for _, size in sizes.values()) >= cap:
            none = [pa.nulls(len(shards), t) for t in (pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *none, *figures], names)
            return
        rows = pa.Table.from_batches(held)
        order = [("shard_id", "ascending"), ("pos_in_shard", "ascending")]
        rows = rows.take(pa.compute.sort_indices(rows, order, null_placement="at_start"))
        if kind == "raw":
            (places,) = words(iter(rows.combine_chunks().to_batches()))
            yield pa.RecordBatch.from_arrays([*places.columns, *figures], names)
            return
        store, root = file_store(path)
        store.create_dir(f"{root}/{folder}", recursive=True)
        context = TaskContext.get()
        # A name of its own per attempt: the rows of the attempt that counts name the file that counts.
        file = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}.parquet"
        in_group = max(1, rows.num_rows * group_bytes // max(total, 1))
        pq.write_table(rows, f"{root}/{file}", filesystem=store, row_group_size=in_group)
        ends = np.cumsum(figures[0].to_numpy())
        first = pa.array(ends - figures[0].to_numpy(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([file] * len(shards)), first, figures[0], *figures], names)

    return write


def _write_rows(dealt: DataFrame, path: str, folder: str) -> DataFrame:
    """``shard_id, file, first, size``, in rows, of what Spark's writer has made of sorted partitions."""
    dealt.write.option("maxRecordsPerFile", 0).option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/{folder}")
    written = dealt.sparkSession.read.schema("shard_id bigint").parquet(f"{path}/{folder}")
    file = F.concat(F.lit(f"{folder}/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
    placed = written.select("shard_id", file.alias("file"), F.col("_metadata.row_index").alias("row"))
    return placed.groupBy("shard_id", "file").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))


def _write_words(dealt: DataFrame, path: str, folder: str) -> DataFrame:
    """``shard_id, file, first, size``, in bytes, of files of raw words."""
    return stage(dealt.mapInArrow(_words_writer(path, folder), PLACES), "publish-places")


def _words_writer(path: str, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What writes a sorted partition into a file of raw words, of each shard its rows, then its labels, and says where each shard lies."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(path)
        store.create_dir(f"{root}/{folder}", recursive=True)
        context = TaskContext.get()
        # A name of its own per attempt: the rows of the attempt that counts name the file that counts.
        file = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}.words"
        out, at, held, placed = None, 0, None, []
        x: list[np.ndarray] = []
        y: list[np.ndarray] = []

        def finish() -> None:
            nonlocal at
            words = np.concatenate([*x, *y]).astype("<i8").tobytes()
            out.write(words)
            placed.append((held, file, at, len(words)))
            at += len(words)
            x.clear()
            y.clear()

        for batch in batches:
            number = batch.column("shard_id").to_numpy()
            begin = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(begin, begin[1:]):
                if a == b:
                    continue
                if out is None:
                    out = store.open_output_stream(f"{root}/{file}")
                if held is not None and number[a] != held:
                    finish()
                held = int(number[a])
                part = batch.slice(a, b - a)
                x.append(part.column("x").flatten().to_numpy())
                y.append(part.column("y").to_numpy())
        if out is not None:
            finish()
            out.close()
            shard, name, first, size = zip(*placed)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(name), pa.array(first), pa.array(size)], ["shard_id", "file", "first", "size"])

    return write


def _write_index(rows: DataFrame, path: str, low: int, high: int, count: int) -> list[dict]:
    """Sorted index files of rows, and what a snapshot says of each."""
    parts = max(1, -(-count // INDEX_ROWS))
    span = -(-(high - low + 1) // parts)
    folder = f"index/{uuid.uuid4().hex}"
    dealt = rows.repartitionById(parts, F.expr(f"cast((shard_id - {low}L) div {span}L as int)")).sortWithinPartitions("shard_id")
    dealt.write.option("parquet.block.size", INDEX_GROUP_BYTES).parquet(f"{path}/{folder}")
    written = rows.sparkSession.read.schema(INDEX).parquet(f"{path}/{folder}")
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    found = written.groupBy(name.alias("name")).agg(
        F.min("shard_id").alias("low"), F.max("shard_id").alias("high"), F.max("version").alias("version"), F.count(F.lit(1)).alias("n")
    )
    return [
        {"file": f"{folder}/{r['name']}", "low": r["low"], "high": r["high"], "version": r["version"], "rows": r["n"]}
        for r in found.orderBy("low").collect()
    ]


def end_store(spark: SparkSession, path: str) -> None:
    """The end marker: no shard follows, and a stream that has taken all may stop."""
    path = qualified(spark, path)
    _next_snapshot(spark, path, Store(path).newest(), ended=True)


def store_ended(spark: SparkSession, path: str) -> bool:
    return Store(qualified(spark, path)).newest()["ended"]
