"""Registry of runnable queries, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# -- common table expressions of the SQL side ------------------------------------------------------

# Labelled documents only; ALL_SAMPLES below has every document.
DOC_WORDS = """
doc_words AS (
  SELECT d.doc_id, l.quality::BIGINT AS y,
         list_filter(string_split_regex(d.text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS words
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# One row per (document, part), numbered; and one row per token with its place in that row.
DOC_SAMPLES = (
    DOC_WORDS
    + """,
doc_parts AS (
  SELECT doc_id, y, len(words) AS n_words,
         unnest(range(greatest(1, (len(words) + 1023) // 1024)))::BIGINT AS part
  FROM doc_words),
samples AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, part) - 1 AS sample_id,
         least(1024, n_words - part * 1024)::BIGINT AS n_tokens
  FROM doc_parts),
words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words)))::BIGINT AS pos FROM doc_words),
tokens AS (
  SELECT s.sample_id, s.y, w.pos % 1024 AS pos,
         ('0x' || substr(md5(w.word), 1, 8))::BIGINT % 10000 AS token
  FROM words w JOIN samples s ON s.doc_id = w.doc_id AND s.part = w.pos // 1024)"""
)

ALL_SAMPLES = DOC_SAMPLES.replace("FROM documents d JOIN labels", "FROM documents d LEFT JOIN labels")

LINES = """
lines AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
                               l_extendedprice) - 1 AS sample_id
  FROM lineitem),
batches AS (
  SELECT sample_id // 1000 AS shard_id, count(*) AS n,
         8 * ((sample_id // 1000 * 37) % 512) AS sample_size
  FROM lines GROUP BY ALL)"""

LISTING = (
    LINES
    + """,
listing AS (
  SELECT shard_id AS file_no,
         CASE WHEN shard_id % 7 = 0 THEN 'DONE'
              WHEN shard_id % 11 = 0 THEN 'shard_' || shard_id || '.bin'
              WHEN shard_id % 5 = 0 THEN 'shard_' || shard_id || '.pt.tmp'
              ELSE 'shard_' || shard_id || '.pt' END AS name
  FROM batches)"""
)

ARRIVALS = """
arrivals AS (
  SELECT user_id AS stream, event_id, event_id AS shard_id,
         date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS ts_us,
         round(value * 60000000)::BIGINT AS service_us,
         8200 * (event_id % 64 + 1) AS bytes, event_id % 64 + 1 AS n,
         event_id % (event_id % 64 + 1) AS correct
  FROM events)"""

PHASE_LOG = """
phase_log AS (
  SELECT user_id AS run, event_id AS shard_id, value AS ms, ts,
         CASE event_type WHEN 'click' THEN 'wait' WHEN 'error' THEN 'load' WHEN 'purchase' THEN 'pin'
                         WHEN 'signup' THEN 'h2d' WHEN 'view' THEN 'train' END AS phase
  FROM events)"""

PHASE_SUMS = ", ".join(
    f"coalesce(sum(CASE WHEN phase = '{p}' THEN ms END), 0) AS {p}_ms"
    for p in ("wait", "load", "pin", "h2d", "train")
)

SHARD_LOG = (
    PHASE_LOG
    + """,
shard_log AS (
  SELECT run, shard_id, phase, ms, ts, 8200 * (shard_id % 64 + 1) AS bytes,
         (shard_id % 100) / 100.0::DOUBLE AS loss, shard_id % (shard_id % 64 + 1) AS correct,
         shard_id % 64 + 1 AS n
  FROM phase_log),
totals AS (
  SELECT run, count(*) AS shards, sum(n)::BIGINT AS samples, sum(correct)::BIGINT AS correct,
         sum(loss * n) AS loss_sum, sum(bytes)::BIGINT AS bytes, """
    + PHASE_SUMS
    + """, date_diff('microsecond', min(ts), max(ts)) / 1000.0::DOUBLE AS wall_ms
  FROM shard_log GROUP BY run)"""
)

SERVED = (
    ARRIVALS
    + """,
summed AS (
  SELECT *, sum(service_us) OVER w AS c FROM arrivals
  WINDOW w AS (PARTITION BY stream ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)),
topped AS (
  SELECT *, greatest(max(ts_us - (c - service_us)) OVER w, 0) AS m FROM summed
  WINDOW w AS (PARTITION BY stream ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)),
served AS (
  SELECT stream, event_id, shard_id, ts_us, service_us, bytes, (c + m)::BIGINT AS finish_us,
         (c + m - service_us)::BIGINT AS start_us,
         (m - coalesce(lag(m) OVER w, 0))::BIGINT AS wait_us,
         (c + m - service_us - ts_us)::BIGINT AS queue_us
  FROM topped WINDOW w AS (PARTITION BY stream ORDER BY ts_us, event_id))"""
)

HELD = (
    SERVED
    + """,
changes AS (
  SELECT stream, shard_id, ts_us, 1 AS delta, bytes FROM served
  UNION ALL
  SELECT stream, shard_id, finish_us AS ts_us, -1 AS delta, -bytes AS bytes FROM served),
held AS (
  SELECT *, sum(delta) OVER w AS items, sum(bytes) OVER w AS bytes_held FROM changes
  WINDOW w AS (PARTITION BY stream ORDER BY ts_us, delta, shard_id ROWS UNBOUNDED PRECEDING))"""
)


def weight_sql(token: str, k: int) -> str:
    return f"((('0x' || substr(md5({token} || ':{k}'), 1, 8))::BIGINT % 2001 - 1000) / 1024.0::DOUBLE)"
