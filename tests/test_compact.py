from __future__ import annotations

import pytest

from millrace.files import publish_text, qualified
from millrace.sinks.compact import compact_log, newest_checkpoint
from millrace.sinks.log import append_log, latest, read_log

SCHEMA = "k bigint, v bigint, run_id string, batch_id bigint"


def schema_of(spark):
    return spark.createDataFrame([], SCHEMA).schema


def add(spark, path, run, batch, rows):
    append_log(spark.createDataFrame(rows, "k bigint, v bigint"), path, run, batch)


def found(spark, path):
    return sorted(tuple(r) for r in read_log(spark, path, schema_of(spark)).select("run_id", "batch_id", "k", "v").collect())


def test_a_merged_log_has_the_same_rows_in_few_files(spark, folder):
    path, want, files = f"{folder}/log", [], []
    for batch in range(24):
        rows = [(batch, 10 * batch), (batch, 10 * batch)] if batch != 5 else []
        add(spark, path, "a", batch, rows)
        want += [("a", batch, *r) for r in rows]
        if batch % 4 == 3:
            compact_log(spark, path, schema_of(spark))
            assert found(spark, path) == sorted(want)
            files.append(len(read_log(spark, path, schema_of(spark)).inputFiles()))
    parts = newest_checkpoint(qualified(spark, path))["parts"]
    assert len(parts) <= 4 and sum(p["rows"] for p in parts) == len([w for w in want if w[1] <= 21])
    # Files of the segments behind the checkpoint before are gone, so the last reading lists no more than the one before it.
    assert files[-1] <= files[2] + 8
    before = newest_checkpoint(qualified(spark, path))
    assert compact_log(spark, path, schema_of(spark)) == before


def test_the_newest_micro_batch_may_run_again(spark, folder):
    path = f"{folder}/log"
    for batch in range(6):
        add(spark, path, "a", batch, [(batch, 1)])
    add(spark, path, "b", 0, [(100, 1)])
    compact_log(spark, path, schema_of(spark))
    add(spark, path, "a", 5, [(5, 2)])
    add(spark, path, "b", 0, [])
    compact_log(spark, path, schema_of(spark))
    assert found(spark, path) == [("a", b, b, 2 if b == 5 else 1) for b in range(6)]


def test_a_log_of_updates_grows_with_its_keys(spark, folder):
    path = f"{folder}/log"
    for batch in range(12):
        add(spark, path, "a", batch, [(batch % 3, batch), (7, batch)])
        if batch % 3 == 2:
            compact_log(spark, path, schema_of(spark), ["k"])
    assert sum(p["rows"] for p in newest_checkpoint(qualified(spark, path))["parts"]) == 4
    rows = latest(read_log(spark, path, schema_of(spark)), ["k"], "a").collect()
    assert {r["k"]: r["v"] for r in rows} == {0: 9, 1: 10, 2: 11, 7: 11}


def test_of_two_merges_one_fails_and_an_unfinished_one_is_not_seen(spark, folder, monkeypatch):
    path = f"{folder}/log"
    for batch in range(5):
        add(spark, path, "a", batch, [(batch, 1)])
    want = found(spark, path)
    publish_text(spark, f"{qualified(spark, path)}/_compacted/versions/{1:012d}.json.other", "{}")

    def taken(spark, place, text):
        raise FileExistsError(place)

    with monkeypatch.context() as patch:
        patch.setattr("millrace.sinks.compact.publish_text", taken)
        with pytest.raises(FileExistsError):
            compact_log(spark, path, schema_of(spark))
    assert found(spark, path) == want and newest_checkpoint(qualified(spark, path))["version"] == 0
    assert compact_log(spark, path, schema_of(spark))["version"] == 1 and found(spark, path) == want
