from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clamp_is_never_negative(spark):
    words = [-1, -(2**63), 2**62, 0, 10000]
    x = F.array(*[F.lit(w).cast("bigint") for w in words])
    assert one(spark, C.clamp_tokens(x)) == [w % 10000 for w in words]
    assert one(spark, C.clamp_labels(F.lit(-3).cast("bigint"))) == 1


def test_names(spark):
    names = ["shard_2.pt", "shard_10.pt", "shard_3.pt.tmp", "DONE", "shard_x.pt", "shard_4.bin", "other"]
    n = F.col("name")
    rows = spark.createDataFrame([(v,) for v in names], "name string").select(
        "name",
        C.shard_index(n).alias("i"),
        C.is_publishable(n).alias("p"),
        C.is_leftover(n).alias("s"),
        C.is_leftover(n, strict=False).alias("l"),
    )
    got = {r["name"]: (r["i"], r["p"], r["s"], r["l"]) for r in rows.collect()}
    assert got["shard_2.pt"] == (2, True, True, True)
    assert got["shard_10.pt"] == (10, True, True, True)
    assert got["shard_3.pt.tmp"] == (3, False, True, True)
    assert got["DONE"] == (None, False, True, True)
    assert got["shard_x.pt"] == (None, False, True, True)
    assert got["shard_4.bin"] == (None, False, False, True)
    assert got["other"] == (None, False, False, False)


@pytest.mark.parametrize("size,fault", [(0, "empty"), (2097151, None), (2097152, "over cap")])
def test_cap(spark, size, fault):
    assert one(spark, C.batch_fault(F.lit(1), size)) == fault


def test_batch_bytes_do_not_wrap(spark):
    assert one(spark, C.batch_bytes(F.lit(2**31 - 1), 2**31 - 1)) == (2**31 - 1) ** 2


@pytest.mark.parametrize(
    "n,text",
    [
        (0, "   0.0 B"),
        (1023, "1023.0 B"),
        (1024, "   1.0 KiB"),
        (524800, " 512.5 KiB"),
        (32 * 1000, "  31.2 KiB"),  # exactly 31.25: to the even digit
        (96 * 1000, "  93.8 KiB"),  # exactly 93.75
        (5 * 1024**5, "5120.0 TiB"),
    ],
)
def test_human_bytes(spark, n, text):
    assert one(spark, C.human_bytes(F.lit(n).cast("bigint"))) == text == _python(n)


def _python(n):
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return format(n, "6.1f") + " " + unit
        n = n / 1024
    return format(n, "6.1f") + " TiB"


def test_fixed_rows_keep_every_token(spark):
    def rows(n):
        ids = F.array(*[F.lit(i + 1).cast("bigint") for i in range(n)]).cast("array<bigint>")
        return one(spark, C.fixed_rows(ids, 4))

    assert rows(0) == [[0, 0, 0, 0]]
    assert rows(3) == [[1, 2, 3, 0]]
    assert rows(4) == [[1, 2, 3, 4]]
    assert rows(9) == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 0, 0, 0]]


def test_tokens_of_a_whole_text(spark):
    import hashlib

    words = [f"w{i}" for i in range(5000)]
    text = " \n".join(words) + "  "
    got = spark.createDataFrame([(text,)], "t string").select(C.token_ids(F.col("t")).alias("x")).first()["x"]
    assert got == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 10000 for w in words]


def test_reshape(spark):
    words = F.array(*[F.lit(i).cast("bigint") for i in [1, 2, 3, 4, 5, 6, 70, 80]])
    shaped = one(spark, C.reshape_words(words, F.lit(2), 3))
    assert (shaped["x"], shaped["y"]) == ([[1, 2, 3], [4, 5, 6]], [70, 80])
    assert one(spark, C.reshape_words(F.slice(words, 1, 7), F.lit(2), 3)) is None


def test_times(spark):
    assert one(spark, C.load_time(F.lit(0.05), F.lit(0.1))) == 0.0
    assert one(spark, C.ratio(F.lit(1.0), F.lit(0.0))) == 0.0
    assert FeedConfig().sample_bytes == 8200 and FeedConfig().shard_bytes == 524800
