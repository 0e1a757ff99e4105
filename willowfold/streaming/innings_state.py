"""A match as state: its deliveries folded one at a time as they arrive, in whatever order, up to the ball that ends each innings.

State of a match is two counters' worth of numbers for each innings, and the deliveries that wait for an earlier one.  A delivery that is next in its innings is folded, with all
that wait behind it; the second innings begins when the first has ended, and knows its target.  A ball that was folded or waits already is a replay and counts once.
Finished matches are forgotten when the watermark passes their last ball, others when nothing came for ``idle``; by then their balls would be late.
Rows behind the watermark never reach the state; the stream counts them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

BALL = "match_id long, innings int, seq int, time timestamp, total_runs int, is_out boolean, is_legal boolean, is_last boolean"
FOLDED = "match_id long, innings int, seq int, kind string, score long, wickets long, balls long, target long, needed long, balls_left long"
_INNINGS = "next int, score long, wickets long, balls long, over boolean"
_WAITING = "total_runs int, is_out boolean, is_legal boolean, is_last boolean"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Match(StatefulProcessor):
    """The fold of one match; limits as the cut-off's: an innings ends with a ball that reaches one of them, or that the feed calls its last."""

    def __init__(self, max_balls: int, max_wickets: int, idle_ms: int = 6 * 3_600_000):
        self.max_balls, self.max_wickets, self.idle_ms = max_balls, max_wickets, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.innings = handle.getMapState("innings", "innings int", _INNINGS)
        self.waiting = handle.getMapState("waiting", "innings int, seq int", _WAITING)
        self.seen = handle.getValueState("seen", "latest long")

    def _of(self, n: int) -> list:
        return list(self.innings.getValue((n,))) if self.innings.containsKey((n,)) else [0, 0, 0, 0, False]

    def _folded(self, state: dict[int, list], waiting: dict, match: int, n: int) -> Iterator[tuple]:
        """Rows of the deliveries of innings n that can be folded now."""
        own, first = state[n], state[1]
        target = first[1] + 1 if n == 2 else None
        while not own[4] and (n == 1 or first[4]) and (n, own[0]) in waiting:
            runs, out, legal, last = waiting.pop((n, own[0]))
            own[0], own[1], own[2], own[3] = own[0] + 1, own[1] + runs, own[2] + out, own[3] + legal
            own[4] = bool(last or own[3] >= self.max_balls or own[2] >= self.max_wickets or n == 2 and own[1] >= target)
            yield match, n, own[0] - 1, "ball", own[1], own[2], own[3], target, max(0, target - own[1]) if n == 2 else None, self.max_balls - own[3]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        match, found, latest = int(key[0]), [], self.seen.get()[0] if self.seen.exists() else 0
        state = {n: self._of(n) for n in (1, 2)}
        held = {tuple(k): tuple(v) for k, v in self.waiting.iterator()}
        waiting = dict(held)
        for frame in rows:
            latest = max(latest, int(frame["time"].max().timestamp() * 1000))
            for n, seq, *ball in zip(*(frame[c].tolist() for c in ("innings", "seq", "total_runs", "is_out", "is_legal", "is_last")), strict=True):
                if seq < state[n][0] or (n, seq) in waiting:
                    found.append((match, n, seq, "replay", *[None] * 6))
                elif not state[n][4]:  # what comes behind the end of an innings is not kept
                    waiting[n, seq] = tuple(ball)
        for n in (1, 2):
            found += self._folded(state, waiting, match, n)
            self.innings.updateValue((n,), tuple(state[n]))
        waiting = {k: v for k, v in waiting.items() if not state[k[0]][4]}
        for k in held.keys() - waiting.keys():
            self.waiting.removeKey(k)
        for k in waiting.keys() - held.keys():
            self.waiting.updateValue(k, waiting[k])
        self.seen.update((latest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + (0 if state[2][4] else self.idle_ms))
        yield _frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self._of(2)[4]
        for state in (self.innings, self.waiting, self.seen):
            state.clear()
        yield _frame([(int(key[0]), None, None, "finished" if over else "abandoned", *[None] * 6)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in FOLDED.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({n: "Int64" for n in names if n != "kind"}).astype({"innings": "Int32", "seq": "Int32", "kind": "object"})


def fold(deliveries: DataFrame, max_balls: int, max_wickets: int, delay: str = "1 hour", idle_ms: int = 6 * 3_600_000) -> DataFrame:
    """A streaming DataFrame of FOLDED rows: a ball when it is folded, a replay, and the end of a match's state."""
    rows = deliveries.withWatermark("time", delay).groupBy("match_id")
    return rows.transformWithStateInPandas(Match(max_balls, max_wickets, idle_ms), FOLDED, "update", "eventTime")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, max_balls: int, max_wickets: int, delay: str = "1 hour", files: int = 4, matches: DataFrame | None = None, idle_ms: int = 6 * 3_600_000) -> StreamingQuery:
    """Follow the Parquet files of a folder; each micro-batch writes what it folded, into a folder of its number, so that one that is run again writes the same.

    matches: rows by match_id that are joined to every folded row, read anew for each batch.
    """
    before = spark.conf.get(*PROVIDER[:1], None)
    spark.conf.set(*PROVIDER)
    try:
        folded = fold(spark.readStream.schema(BALL).option("maxFilesPerTrigger", files).parquet(source), max_balls, max_wickets, delay, idle_ms)
        if matches is not None:
            folded = folded.join(matches, "match_id", "left")

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        return folded.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the batches that the query still knows of."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Entries of the state after the last batch."""
    done = [p for p in query.recentProgress if p["stateOperators"]]
    return sum(s["numRowsTotal"] for s in done[-1]["stateOperators"]) if done else 0


def seq_in_order(over_no, ball_no):
    """The place of a ball in an innings of six to the over."""
    return (F.col(over_no) * 6 + F.col(ball_no) - 1).cast("int")
