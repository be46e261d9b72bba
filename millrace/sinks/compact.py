"""Merging a log's segments, so that what a reader opens does not grow with the micro-batches behind it.

A checkpoint says which parts hold the merged rows and up to which micro-batch of each run they go. It is a file that is renamed into
place and never replaced, so of two merges at once one fails, and what was not finished is never seen. Segments and parts that a
checkpoint makes needless are deleted by the merge after it, so a reader of the checkpoint before may finish.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.files import publish_text, qualified
from millrace.session import file_store

# Spark's readers pass over names that begin so.
HELD = "_compacted"
# The newest micro-batches of a run stay segments: one may run again, and the state of the one before it is read.
KEEP = 2
# A part is merged with the one before it unless that has so many times its rows: parts are few and a row is seldom rewritten.
TIER = 2


def newest_checkpoint(path: str) -> dict:
    """The last checkpoint of a log; version 0, which covers nothing, where there is none."""
    store, root = file_store(f"{path}/{HELD}/versions")
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".json"))
    if not names:
        return {"version": 0, "covered": {}, "parts": [], "dropped": []}
    with store.open_input_stream(names[-1]) as file:
        return json.loads(file.read())


def is_covered(covered: dict[str, int]) -> Column:
    """Whether a segment's rows are in the checkpoint; of partition columns alone, so covered segments are not opened."""
    if not covered:
        return F.lit(False)
    upto = F.create_map(*[F.lit(v) for pair in covered.items() for v in pair])
    return F.coalesce(F.col("batch_id") <= F.try_element_at(upto, F.col("run_id").cast("string")), F.lit(False))


def read_compacted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a log: those of its parts, and those of the segments after them."""
    now = newest_checkpoint(path)
    rows = spark.read.schema(schema).parquet(path)
    if not now["parts"]:
        return rows
    parts = spark.read.schema(schema).parquet(*[f"{path}/{HELD}/{p['folder']}" for p in now["parts"]])
    return rows.where(~is_covered(now["covered"])).unionByName(parts)


def compact_log(spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None, keep: int = KEEP) -> dict:
    """Merge the segments of a log but for the ``keep`` newest micro-batches of each run; returns the checkpoint.

    ``schema`` holds ``run_id`` and ``batch_id``. With ``keys`` the log is one of updates, of which only the newest row of each run and key
    is kept, so the merged rows grow with the keys alone. Nothing to merge leaves the checkpoint as it is.
    """
    path = qualified(spark, path)
    now = newest_checkpoint(path)
    segments = spark.read.schema(schema).parquet(path).where(~is_covered(now["covered"]))
    # One row a run: its newest micro-batch with rows.
    ends = {r["run_id"]: r["last"] - keep for r in segments.groupBy("run_id").agg(F.max("batch_id").alias("last")).collect()}
    covered = {**now["covered"], **{run: end for run, end in ends.items() if end > now["covered"].get(run, -(2**62))}}
    fresh = segments.where(is_covered(covered))
    n = fresh.count()
    if n == 0:
        return now
    parts = list(now["parts"])
    merged = []
    while parts and (keys or parts[-1]["rows"] < TIER * n):
        merged.append(parts.pop())
        n += merged[-1]["rows"]
    if merged:
        fresh = fresh.unionByName(spark.read.schema(schema).parquet(*[f"{path}/{HELD}/{p['folder']}" for p in merged]))
    if keys:
        rest = [c for c in fresh.columns if c not in {"run_id", *keys}]
        newest = fresh.groupBy("run_id", *keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_row"))
        fresh = newest.select("run_id", *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*schema.names)
    folder = uuid.uuid4().hex
    fresh.write.parquet(f"{path}/{HELD}/{folder}")
    rows = spark.read.schema(schema).parquet(f"{path}/{HELD}/{folder}").count() if keys else n
    _delete_needless(path, now)
    checkpoint = {
        "version": now["version"] + 1, "covered": covered, "parts": [*parts, {"folder": folder, "rows": rows}],
        "dropped": [p["folder"] for p in merged],
    }
    publish_text(spark, f"{path}/{HELD}/versions/{checkpoint['version']:012d}.json", json.dumps(checkpoint))
    return checkpoint


def _delete_needless(path: str, now: dict) -> None:
    """Delete what the checkpoint ``now`` has made needless: its merged parts, and the segments it covers, run by run."""
    store, root = file_store(path)
    for folder in now["dropped"]:
        if store.get_file_info(f"{root}/{HELD}/{folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{HELD}/{folder}")
    for run, end in now["covered"].items():
        for segment in store.get_file_info(fs.FileSelector(f"{root}/run_id={run}", allow_not_found=True)):
            name, _, number = segment.base_name.partition("=")
            if name == "batch_id" and int(number) <= end:
                store.delete_dir(segment.path)
