"""Bounds that hold while a feed runs: shards held back behind a lookahead, and the backlog as events come in.

Both keep a small state per stream, in one streaming query each; there is no loop on the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READY, RETIRED = "ready", "retired"
RELEASE, STALL = "release", "stall"


class Gate:
    """Numbers of one stream: which may be released next, which are ready, which are released and not gone yet.

    Numbers are released in order, and ``i`` only once ``i - lookahead`` is gone, so at most ``lookahead`` are in flight. Ready
    numbers are kept as ranges; where they come in order that is one range however many they are.
    """

    def __init__(self, lookahead: int, following: int = 0, in_flight: Iterable[int] = (), lows: Iterable[int] = (), highs: Iterable[int] = ()) -> None:
        self.lookahead, self.following = lookahead, following
        self.in_flight, self.lows, self.highs = set(in_flight), list(lows), list(highs)

    def state(self) -> tuple:
        return self.following, sorted(self.in_flight), self.lows, self.highs

    def ready(self, number: int) -> None:
        at = bisect_right(self.lows, number)
        if number < self.following or at and number <= self.highs[at - 1]:
            return  # said before
        left = at > 0 and self.highs[at - 1] == number - 1
        right = at < len(self.lows) and self.lows[at] == number + 1
        if left and right:
            self.highs[at - 1] = self.highs.pop(at)
            self.lows.pop(at)
        elif left:
            self.highs[at - 1] = number
        elif right:
            self.lows[at] = number
        else:
            self.lows.insert(at, number)
            self.highs.insert(at, number)

    def retired(self, number: int) -> None:
        self.in_flight.discard(number)

    def blocked(self) -> bool:
        """Whether the next number is ready and has to wait for another one to go."""
        return bool(self.lows) and self.lows[0] == self.following and bool(self.lookahead) and self.following - self.lookahead in self.in_flight

    def release(self) -> Iterator[int]:
        while self.lows and self.lows[0] == self.following and not self.blocked():
            number = self.following
            self.following += 1
            if self.lookahead:
                self.in_flight.add(number)
            if self.lows[0] == self.highs[0]:
                self.lows.pop(0)
                self.highs.pop(0)
            else:
                self.lows[0] += 1
            yield number


def hold_back(events: DataFrame, stream: str, lookahead: int, stall: str | None = None) -> DataFrame:
    """``stream, shard_id, kind`` as a stream: a ``release`` for each shard that may appear now.

    ``events`` is a stream of ``stream, shard_id, kind``, where kind is ``ready`` or ``retired``; repeated events change nothing, events of
    another kind or with nulls are passed over. Numbers of a stream are dense from 0 on; a missing one is waited for. 0 means no
    limit. With ``stall``, an interval, a ready shard that has been held back for so long is told as a ``stall`` each
    time. State is at most ``lookahead`` numbers in flight and the ranges of ready ones.
    """
    millis = int(pd.Timedelta(stall).total_seconds() * 1000) if stall else None
    kind = events.schema[stream].dataType.simpleString()
    names = [stream, "shard_id", "kind"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(lookahead, *state.get) if state.exists else Gate(lookahead)
        if state.hasTimedOut:
            yield pd.DataFrame({stream: [key[0]], "shard_id": [gate.following], "kind": [STALL]})
        else:
            gone: list[int] = []
            for rows in batches:
                for number in sorted(rows.loc[rows["kind"] == READY, "shard_id"].tolist()):
                    gate.ready(number)
                gone += rows.loc[rows["kind"] == RETIRED, "shard_id"].tolist()
            for number in gone:
                gate.retired(number)
            while out := [n for _, n in zip(range(10_000), gate.release())]:
                yield pd.DataFrame({stream: [key[0]] * len(out), "shard_id": out, "kind": [RELEASE] * len(out)}, columns=names)
        state.update(gate.state())
        if millis and gate.blocked():
            state.setTimeoutDuration(millis)

    fine = events.where(F.col("shard_id").isNotNull() & F.col("kind").isin(READY, RETIRED)).select(*names)
    return fine.groupBy(stream).applyInPandasWithState(
        step, f"`{stream}` {kind}, shard_id bigint, kind string", "following bigint, in_flight array<bigint>, lows array<bigint>, highs array<bigint>",
        "append", GroupStateTimeout.ProcessingTimeTimeout if stall else GroupStateTimeout.NoTimeout,
    )


class Held:
    """Shards and bytes outstanding, and their peaks, after events taken in order."""

    def __init__(self, items: int = 0, held: int = 0, peak_items: int = 0, peak_bytes: int = 0) -> None:
        self.items, self.bytes, self.peak_items, self.peak_bytes = items, held, peak_items, peak_bytes

    def figures(self) -> tuple[int, int, int, int]:
        return self.items, self.bytes, self.peak_items, self.peak_bytes

    def take(self, changes: np.ndarray) -> Held:
        """Rows of (ts_us, delta, shard_id, bytes), in order."""
        if len(changes):
            items, size = self.items + np.cumsum(changes[:, 1]), self.bytes + np.cumsum(changes[:, 3])
            self.items, self.bytes = int(items[-1]), int(size[-1])
            self.peak_items, self.peak_bytes = max(self.peak_items, int(items.max())), max(self.peak_bytes, int(size.max()))
        return self


LIVE = "items bigint, bytes_held bigint, peak_items bigint, peak_bytes bigint, settled_items bigint, settled_bytes bigint, waiting bigint"


def live_backlog(changes: DataFrame, stream: str, delay: str) -> DataFrame:
    """Running backlog of each stream as it comes in: items and bytes outstanding, and the peak of each.

    ``changes`` is a stream of ``stream, shard_id, ts_us, delta, bytes`` as ``timeline.backlog`` has them: +1 and the bytes for a publish, -1
    and minus the bytes for a retire. Changes are taken in the order of (ts_us, delta, shard_id), whatever the order in which they come, as
    long as none is more than ``delay`` behind the newest; what comes later than that is dropped by the watermark. State is
    the running figures up to the watermark and the changes above it. Each row has the figures with all changes that are known, and as
    ``settled_`` those up to the watermark, which no later change alters. The last row of a stream equals the table's result.
    """
    kind = changes.schema[stream].dataType.simpleString()
    timed = changes.where(F.col("ts_us").isNotNull() & F.col("shard_id").isNotNull()).select(
        stream, F.timestamp_micros("ts_us").alias("event_time"), "ts_us", F.col("delta").cast("bigint").alias("delta"), "shard_id", "bytes"
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, parts = Held(), [np.zeros((0, 4), np.int64)]
        if state.exists:
            *figures, packed = state.get
            held = Held(*figures)
            parts.append(np.frombuffer(packed, np.int64).reshape(-1, 4))
        for rows in batches:
            parts.append(np.stack([rows[c].astype("int64").to_numpy() for c in ("ts_us", "delta", "shard_id", "bytes")], axis=1))
        waiting = np.concatenate(parts)
        waiting = waiting[np.lexsort(waiting.T[::-1])]
        mark = state.getCurrentWatermarkMs() * 1000
        done = int(np.searchsorted(waiting[:, 0], mark, side="right"))
        held.take(waiting[:done])
        waiting = waiting[done:]
        now = Held(*held.figures()).take(waiting)
        # Packed, because every micro-batch goes through the whole state for time-outs, and unfolds it as it goes.
        state.update((*held.figures(), waiting.tobytes()))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting[0, 0]) // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame([(key[0], *now.figures(), held.items, held.bytes, len(waiting))], columns=names)

    names = [stream, *[c.split()[0] for c in LIVE.split(", ")]]
    return timed.withWatermark("event_time", delay).groupBy(stream).applyInPandasWithState(
        step, f"`{stream}` {kind}, {LIVE}",
        "items bigint, held bigint, peak_items bigint, peak_bytes bigint, waiting binary",
        "update", GroupStateTimeout.EventTimeTimeout,
    )
