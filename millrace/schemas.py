"""Explicit schemas: no source infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_LONGS = T.ArrayType(T.LongType())

SAMPLE = T.StructType(
    [
        T.StructField("shard_id", T.LongType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("pos_in_shard", T.LongType()),
        T.StructField("x", _LONGS),
        T.StructField("y", T.LongType()),
    ]
)

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

MODEL_STATE = T.StructType(
    [
        T.StructField("token", T.LongType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("m", T.ArrayType(T.DoubleType())),
        T.StructField("v", T.ArrayType(T.DoubleType())),
    ]
)

SHARD_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("shard_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("correct", T.LongType()),
        T.StructField("acc", T.DoubleType()),
    ]
)
