"""Structured Streaming: windowed rates with late data, crossings and pairs of marks by event time, runs to completion.

What depends on order is held back until the watermark has passed it, then taken in the order of event time, whatever order it came in. Rows
that come later than that are dropped. A run or mark that is still open is given out when its session has been silent for `idle`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: Rows of a piece of state, and rows that are gathered before they are sorted.
PIECE, GATHER = 1 << 13, 1 << 16
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def rates(points: DataFrame, window: str, late: str, t: str = "ts", unit: str = "unit") -> DataFrame:
    """(start, unit, n): points in windows of event time; those later than `late` are dropped once their window closed."""
    return points.withWatermark(t, late).groupBy(F.window(t, window).alias("w"), unit).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), unit, "n")


def crossings(samples: DataFrame, threshold: float) -> DataFrame:
    """(session, start, stop) of samples (session, idx, value) above a threshold, each given out when it ends.

    The state of a session is the first index of its open run and the last index seen; samples of a session must
    come in order between batches.
    """
    ship(samples.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(parts)).sort_values("idx")
        idx, above = rows.idx.to_numpy(), rows.value.to_numpy() > threshold
        # Where runs begin and end, the open one of the batches before included.
        turns = np.diff(np.concatenate([[first >= 0], above]).astype(np.int8))
        starts, stops = idx[turns > 0], idx[turns < 0]
        if first >= 0:
            starts = np.concatenate([[first], starts])
        closed = len(stops)
        state.update((int(starts[closed]) if len(starts) > closed else -1, max(last, int(idx[-1]))))
        yield pd.DataFrame({"session": np.full(closed, key[0], np.int32), "start": starts[:closed].astype(np.int64), "stop": stops.astype(np.int64)})

    rows = samples.select("session", "idx", "value")
    return rows.groupBy("session").applyInPandasWithState(step, "session int, start long, stop long", "first long, last long", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Rows (ms, columns) of a session to step(state, rows in order) -> (state, output rows); end(state) gives out what is open.

    State of a session: the rows that the watermark hasn't passed, in sorted pieces of PIECE rows at most under their first and last instant, and a small value that
    step keeps as JSON. A piece is one entry of the state, so rows don't go in and out one by one. Pieces are read in order of their first instant; rows before that of the
    next piece are complete.
    """

    def __init__(self, columns: list[str], kinds: str, step: Callable, end: Callable, names: list[str], idle: int):
        self.columns, self.kinds, self.step, self.end, self.names, self.idle = columns, kinds, step, end, names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([("ms", pa.int64()), *((c, ARROW[kind]) for c, kind in (x.split() for x in self.kinds.split(", ")))])
        self.held = handle.getMapState("held", "low long, high long, number long", "body binary")
        self.number = handle.getValueState("number", "n long")
        self.value = handle.getValueState("value", "state string, last long, passed long")

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=self.names[1:])
        made.insert(0, self.names[0], key[0])
        return made

    def _sorted(self, tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).sort_by([(c, "ascending") for c in self.schema.names]).combine_chunks()

    def _hold(self, table: pa.Table) -> None:
        """Sorted rows, held until the watermark has passed them."""
        number = self.number.get()[0] if self.number.exists() else 0
        for i in range(0, len(table), PIECE):
            piece = table.slice(i, PIECE)
            low, high = piece["ms"][0].as_py(), piece["ms"][-1].as_py()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as writer:
                writer.write_table(piece)
            self.held.updateValue((low, high, number), (sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(high)
            number += 1
        self.number.update((number,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        parts, size = [], 0
        for part in rows:
            part = part[part["ms"] > passed] if passed > 0 else part
            if len(part):
                parts.append(pa.Table.from_pandas(part[self.schema.names], self.schema, preserve_index=False).replace_schema_metadata())
                size += len(part)
            if size >= GATHER:
                self._hold(self._sorted(parts))
                parts, size = [], 0
        if parts:
            self._hold(self._sorted(parts))
        yield self._out(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        kept = self.value.get() if self.value.exists() else None
        state, last, done = (json.loads(kept[0]), kept[1], kept[2]) if kept else (None, 0, None)
        if done == passed:  # another timer of this batch has done it all
            yield self._out(key, [])
            return
        every = sorted(tuple(k) for k in self.held.keys())
        ready = [k for k in every if k[0] <= passed]
        rest, due = self.schema.empty_table(), 0
        parts, size = [], 0
        for i, piece in enumerate(ready):
            parts.append(pa.ipc.open_stream(self.held.getValue(piece)[0]).read_all())
            self.held.removeKey(piece)
            size += len(parts[-1])
            final = i + 1 == len(ready)
            if size >= due or final:
                table = self._sorted([rest, *parts])
                until = passed + 1 if final else ready[i + 1][0]
                cut = int(np.searchsorted(table["ms"].to_numpy(), until))
                if cut:
                    state, out = self.step(state, list(zip(*(table[c].slice(0, cut).to_pylist() for c in self.schema.names))))
                    last = table["ms"][cut - 1].as_py()
                    yield self._out(key, out)
                rest, parts, size = table.slice(cut), [], 0
                due = max(GATHER, len(rest))
        if len(rest):
            self._hold(rest)
        if state is not None and not len(rest) and len(ready) == len(every) and last + self.idle <= passed:
            yield self._out(key, self.end(state))
            state = None
        self.value.update((json.dumps(state), last, passed))
        if state is not None:
            self.handle.registerTimer(last + self.idle)
        yield self._out(key, [])

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, t: str, late: str, idle_ms: int, kinds: str, step: Callable, end: Callable, schema: str) -> DataFrame:
    """_InOrder over rows (session, t, columns of `kinds`)."""
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [c.split()[0] for c in kinds.split(", ")]
    marked = rows.withWatermark(t, late).select("session", t, F.unix_millis(t).alias("ms"), *columns)
    names = [c.split()[0] for c in schema.split(", ")]
    work = _InOrder(columns, kinds, step, end, names, idle_ms)
    return marked.groupBy("session").transformWithStateInPandas(statefulProcessor=work, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def crossings_by_time(samples: DataFrame, threshold: float, late: str, idle_ms: int, t: str = "ts") -> DataFrame:
    """(session, start, stop, ended) of samples (session, t, idx, value) above a threshold, in any order up to `late`.

    start is the first index above, stop that of the first sample after the run. A run that is open when its session falls silent has
    the last index plus one as its stop, and ended is false. Of samples at one instant that with the least idx comes first.
    """

    def step(state: dict | None, rows: list[tuple]) -> tuple[dict, list[tuple]]:
        first, out = (state or {}).get("first"), []
        for _, idx, value in rows:
            if value is not None and value > threshold:
                first = idx if first is None else first
            elif first is not None:
                out.append((first, idx, True))
                first = None
        return {"first": first, "last": rows[-1][1]}, out

    def end(state: dict) -> list[tuple]:
        return [] if state["first"] is None else [(state["first"], state["last"] + 1, False)]

    return _in_order(samples, t, late, idle_ms, "idx long, value double", step, end, "session long, start long, stop long, ended boolean")


def mark_pairs(marks: DataFrame, start_mark: str, stop_mark: str, late: str, idle_ms: int, t: str = "ts") -> DataFrame:
    """(session, start, stop) in ms of marks (session, t, label), in any order up to `late`: each start with the first stop after it that no earlier start has taken.

    Marks are found anywhere in a label. A start without a stop is given out with a null one when its session falls silent.
    """

    def step(state: list | None, rows: list[tuple]) -> tuple[list, list[tuple]]:
        open_, out = list(state or []), []
        # At one instant stops come first: a stop must be later than its start.
        for ms, label in sorted(rows, key=lambda r: (r[0], start_mark in (r[1] or ""))):
            if stop_mark in (label or "") and open_:
                out.append((open_.pop(0), ms))
            if start_mark in (label or ""):
                open_.append(ms)
        return open_, out

    def end(state: list) -> list[tuple]:
        return [(ms, None) for ms in state]

    return _in_order(marks, t, late, idle_ms, "label string", step, end, "session long, start long, stop long")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its output, written to path.

    Each batch has a folder of its own that a replay of the batch replaces, so nothing is written twice. In mode complete only the last batch counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    spark = SparkSession.active()
    out = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", path).parquet(path)
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")
