"""Rate limits whose state and timers are Spark's own (``transformWithState``).

A task first reduces its lines to those that a limit could admit, so a busy source sends its key few
rows: at most ``limit`` of each millisecond or second and Arrow batch.  The key's state is one row; what it
decides comes out as "lines up to this one", which the lines are then joined to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event times are moved by so many ms (some 139 years), as Spark's watermark starts in 1970 and would
#: take lines up to then for late ones.
SHIFT = 1 << 42
#: A last admitted line that no line comes after.
EVERY = 2**63 - 1
#: Lines judged, and decisions handed to Spark, at once.
OUT_ROWS = 1 << 16
_CANDIDATE = "source string, slot bigint, ts_ms bigint, line_no bigint, event_time timestamp"


def use_state_store(spark: SparkSession) -> None:
    """Processors need a store with column families; a session that names its own provider keeps it."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


def candidates(lines: DataFrame, limit: int, width: int, delay: str) -> DataFrame:
    """The first ``limit`` lines of every source and slot of ``width`` ms in each Arrow batch, with
    their watermark.  Lines without a source or time are left to the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).to_pandas()
            table = table.sort_values(["source", "ts_ms", "line_no"], ignore_index=True)
            table["slot"] = table["ts_ms"] // width
            kept = table[table.groupby(["source", "slot"]).cumcount() < limit]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kept["source"], pa.string()),
                    *(pa.array(kept[c].astype("int64")) for c in ("slot", "ts_ms", "line_no")),
                    pa.array((kept["ts_ms"].astype("int64") + SHIFT) * 1000, pa.int64()).cast(pa.timestamp("us", "UTC")),
                ],
                ["source", "slot", "ts_ms", "line_no", "event_time"],
            )

    placed = lines.where(F.col("source").isNotNull() & F.col("ts_ms").isNotNull() & F.col("line_no").isNotNull())
    rows = placed.select("source", F.col("ts_ms").cast("bigint"), F.col("line_no").cast("bigint"))
    return rows.mapInArrow(run, _CANDIDATE).withWatermark("event_time", delay)


def _sorted(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Times and line numbers of a key's candidates, in order."""
    parts = [(f["ts_ms"].to_numpy(np.int64, copy=True), f["line_no"].to_numpy(np.int64, copy=True)) for f in rows]
    times = np.concatenate([p[0] for p in parts])
    numbers = np.concatenate([p[1] for p in parts])
    del parts
    return _in_order(times, numbers)


def _in_order(times: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((numbers, times))
    return times[order], numbers[order]


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(values))[: len(starts)]


def _watermark(timer_values) -> int:
    return timer_values.getCurrentWatermarkInMs() - SHIFT


def _decided(key, columns: dict[str, np.ndarray], none: np.ndarray, empty: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """A key's decisions, some at a time; the columns ``empty`` are null where ``none`` says."""
    for low in range(0, len(none), OUT_ROWS):
        part = slice(low, low + OUT_ROWS)
        out = {"source": key[0]}
        for name, values in columns.items():
            out[name] = pd.array(values[part], "Int64") if name in empty else values[part]
        frame = pd.DataFrame(out)
        for name in empty:
            frame.loc[none[part], name] = pd.NA
        yield frame


class SecondLimit(StatefulProcessor):
    """First ``limit`` lines of each clock second of a source, over batches.

    State: the lines already admitted per second, for seconds the watermark has not passed; a
    timer at the newest second's end drops what a silent source leaves behind.
    """

    SCHEMA = "source string, slot bigint, last_ts bigint, last_line bigint"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getValueState("seconds", "second array<bigint>, used array<bigint>, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, before, timer = self._state()
        times, numbers = _sorted(rows)
        slots = times // 1000
        starts, ends = _groups(slots)
        slot = slots[starts]
        del slots
        place = np.searchsorted(known, slot)
        there = place < len(known)
        there[there] = known[place[there]] == slot[there]
        used = np.zeros(len(slot), np.int64)
        used[there] = before[place[there]]
        take = np.minimum(self.limit - used, ends - starts)
        last = starts + np.maximum(take, 1) - 1
        found = {"slot": slot, "last_ts": times[last], "last_line": numbers[last]}
        del times, numbers
        if len(known) or len(slot):
            before[place[there]] += take[there]
            known = np.concatenate([known, slot[~there]])
            before = np.concatenate([before, take[~there]])
            order = np.argsort(known, kind="stable")
            self._keep(known[order], before[order], timer, _watermark(timerValues))
        yield from _decided(key, found, take <= 0, ("last_ts", "last_line"))

    def _state(self) -> tuple[np.ndarray, np.ndarray, int | None]:
        """Seconds in order, the lines admitted in each, and the timer."""
        second, used, timer = self.seconds.get() if self.seconds.exists() else ([], [], None)
        return np.array(second, np.int64), np.array(used, np.int64), timer

    def _keep(self, second: np.ndarray, used: np.ndarray, timer, watermark: int) -> None:
        alive = (second + 1) * 1000 > watermark
        if not alive.any():
            self.seconds.clear()
            return
        second, used = second[alive], used[alive]
        end = (int(second[-1]) + 1) * 1000
        if timer != end:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer + SHIFT)
            self.handle.registerTimer(end + SHIFT)
        self.seconds.update((second.tolist(), used.tolist(), end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seconds.exists():
            self._keep(*self._state(), _watermark(timerValues))
        return iter(())

    def close(self) -> None:
        pass


class AnchoredLimit(StatefulProcessor):
    """First ``limit`` lines of each window that opens at the first line ``span`` ms or more after
    the window before.

    State: the open window and, when lines are held back, the candidates that the watermark has
    not passed.  A timer settles these in the order of their times, and drops a window that no
    line in time can fall into any more.
    """

    SCHEMA = "source string, ts_ms bigint, window_start bigint, last_line bigint"
    STATE = "start bigint, used bigint, ms array<bigint>, line array<bigint>, timer bigint"

    def __init__(self, limit: int, span: int, hold: bool):
        self.every = limit <= 0  # no limit: only the windows matter, and one line shows a time
        self.limit, self.span, self.hold = max(limit, 1), span, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.STATE)

    def _state(self):
        start, used, ms, line, timer = self.open.get() if self.open.exists() else (None, 0, [], [], None)
        return start, used, np.array(ms, np.int64), np.array(line, np.int64), timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, used, held_ms, held_lines, timer = self._state()
        times, numbers = _sorted(rows)
        if len(held_ms):
            times, numbers = _in_order(np.concatenate([held_ms, times]), np.concatenate([held_lines, numbers]))
        yield from self._settle(key, start, used, times, numbers, timer, _watermark(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            start, used, times, numbers, _ = self._state()
            yield from self._settle(key, start, used, times, numbers, None, _watermark(timerValues))

    def _settle(self, key, start, used, times, numbers, timer, watermark: int) -> Iterator[pd.DataFrame]:
        until = int(np.searchsorted(times, watermark, "right")) if self.hold else len(times)
        low = 0
        while low < until:  # some lines at a time, all lines of one time together
            high = min(low + OUT_ROWS, until)
            high = min(int(np.searchsorted(times, times[high - 1], "right")), until)
            start, used, found, none = self._judge(start, used, times[low:high], numbers[low:high])
            yield from _decided(key, found, none, ("last_line",))
            low = high
        self._keep(start, used, times[until:], numbers[until:], timer, watermark)

    def _judge(self, start, used, times: np.ndarray, numbers: np.ndarray) -> tuple:
        """Window and last admitted line of each time, and the window that stays open."""
        firsts, ends = _groups(times)
        at = times[firsts]
        # the times that open a window; those before belong to the window of the state
        opens = 0 if start is None else int(np.searchsorted(at, start + self.span))
        following = np.searchsorted(at, at + self.span)
        opened = np.zeros(len(at), bool)
        while opens < len(at):
            opened[opens] = True
            opens = max(int(following[opens]), opens + 1)
        window = np.cumsum(opened)
        heads = np.flatnonzero(opened)
        begun = np.concatenate([[0 if start is None else start], at[heads]])[window]
        if self.every:
            return int(begun[-1]), 0, {"ts_ms": at, "window_start": begun, "last_line": np.full(len(at), EVERY)}, np.zeros(len(at), bool)
        # lines of the window that come before a time's own, those the state has let in included
        ahead = firsts - np.concatenate([[0], firsts[heads]])[window] + np.where(window == 0, used, 0)
        take = np.clip(self.limit - ahead, 0, ends - firsts)
        used = int(min(self.limit, ahead[-1] + ends[-1] - firsts[-1]))
        last = numbers[firsts + np.maximum(take, 1) - 1]
        return int(begun[-1]), used, {"ts_ms": at, "window_start": begun, "last_line": last}, take == 0

    def _keep(self, start, used, times, numbers, timer, watermark: int) -> None:
        if not len(times) and (start is None or start + self.span <= watermark):
            self.open.clear()
            return
        # of each millisecond only the first ``limit`` lines can matter
        place = np.arange(len(times)) - np.repeat(_groups(times)[0], np.diff(np.concatenate([_groups(times)[0], [len(times)]])))
        times, numbers = times[place < self.limit], numbers[place < self.limit]
        due = int(times[0]) if len(times) else start + self.span
        due = max(due, watermark + 1)
        if timer != due:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer + SHIFT)
            self.handle.registerTimer(due + SHIFT)
        self.open.update((start, int(used), times.tolist(), numbers.tolist(), due))

    def close(self) -> None:
        pass


def decisions(lines: DataFrame, processor: StatefulProcessor, width: int, delay: str) -> DataFrame:
    """What the processor decides about a stream of ``source, ts_ms, line_no``."""
    use_state_store(lines.sparkSession)
    return (
        candidates(lines, processor.limit, width, delay)
        .groupBy("source")
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="EventTime"
        )
    )
