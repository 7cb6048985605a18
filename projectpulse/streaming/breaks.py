"""ST4 for hot projects: streamed sessions with their inactive stretches, in two steps.

The first step orders the rows of one slice of time and emits gap-free stretches; the second
joins the few stretches that reach a slice border. Projects are dealt to a fixed number of
buckets, and a key of either step is one bucket (of one slice, in the first): a call costs
milliseconds whatever it handles, so keys do not grow in number with the projects. A key
holds no more than one slice of the rows of its bucket, however many rows a project sends.
Both steps work on columns and keep them in the RocksDB provider that the session settings
name, as Arrow streams of up to ``_BLOB_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from projectpulse.operators import telemetry
from projectpulse.skew import time_chunk
from projectpulse.streaming.telemetry import BREAK_SCHEMA, DEFAULT_DELAY

_ROW = ["micros", "seq", "code"]
_STRETCH = ["opened", "last", "n", "active", "breaks", "first_code", "last_code"]
_PIECE = ["kind", "slice", *_STRETCH, "meets_left", "meets_right"]
_PIECE_SCHEMA = (
    "project_id string, kind int, slice bigint, opened bigint, last bigint, n bigint, active bigint, breaks bigint, "
    "first_code int, last_code int, meets_left boolean, meets_right boolean"
)
_OPENING, _CLOSED = 0, 1
_BLOBS = "rows binary"
_BLOB_ROWS = 10_000
Columns = dict[str, np.ndarray]


def _blobs(names: pa.Array | pa.ChunkedArray, columns: Columns, wanted: list[str]) -> Iterator[tuple[bytes]]:
    """Columns of numbers beside project names as state rows of bounded size."""
    arrays = [names, *[pa.array(columns[c].astype(np.int64, copy=False)) for c in wanted]]
    table = pa.table(arrays, names=["project_id", *wanted])
    for start in range(0, len(table), _BLOB_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(start, _BLOB_ROWS))
        yield (sink.getvalue().to_pybytes(),)


def _table(blobs: Iterable[tuple], wanted: list[str]) -> pa.Table:
    tables = [pa.ipc.open_stream(bytes(blob[0])).read_all() for blob in blobs]
    empty = pa.schema([("project_id", pa.string()), *[(c, pa.int64()) for c in wanted]]).empty_table()
    return pa.concat_tables(tables) if tables else empty


def _put(state: Any, blobs: Iterator[tuple[bytes]]) -> None:
    """A list state becomes these blobs, one message each."""
    first = next(blobs, None)
    if first is None:
        state.clear()
        return
    state.put([first])
    for blob in blobs:
        state.appendValue(blob)


def _numbered(*tables: pa.Table) -> tuple[pa.Array, list[Columns]]:
    """Project names once, and the tables as arrays with the number of the project instead; no name is one, too."""
    chunks = [chunk for t in tables for chunk in t["project_id"].chunks]
    names = pa.chunked_array(chunks, pa.string()).dictionary_encode("encode").combine_chunks()
    numbers, found, start = names.indices.to_numpy(), [], 0
    for t in tables:
        found.append({"project": numbers[start:start + len(t)], **{c: t[c].to_numpy() for c in t.column_names[1:]}})
        start += len(t)
    return names.dictionary, found


def _picked(columns: Columns, rows: np.ndarray) -> Columns:
    return {name: values[rows] for name, values in columns.items()}


def _both(one: Columns, two: Columns, wanted: list[str]) -> Columns:
    return {name: np.concatenate([one[name], two[name]]) for name in ["project", *wanted]}


def _stretches(rows: Columns, gap: int) -> Columns:
    """Rows to stretches without a gap above the limit, and the breaks inside each."""
    rows = _picked(rows, np.lexsort((rows["code"], rows["seq"], rows["micros"], rows["project"])))
    project, at, code = rows["project"], rows["micros"], rows["code"]
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (project[1:] != project[:-1]) | (at[1:] - at[:-1] > gap)
    first, stretch = np.flatnonzero(opens), np.cumsum(opens) - 1
    count = lambda which: np.bincount(stretch[which], minlength=len(first))
    known = np.flatnonzero(code >= 0)
    value, of = code[known], stretch[known]
    same = np.zeros(len(known), dtype=bool)
    same[1:] = of[1:] == of[:-1]
    goes_on = same.copy()
    goes_on[1:] &= value[:-1] == 0
    first_code, last_code = np.full(len(first), -1), np.full(len(first), -1)
    first_code[of[~same]] = value[~same]
    ends = np.append(~same[1:], True)[:len(known)]
    last_code[of[ends]] = value[ends]
    return {
        "project": project[first], "opened": at[first], "last": at[np.append(first[1:], len(at)) - 1] if len(at) else at,
        "n": count(slice(None)), "active": count(code == 1), "breaks": count(known[(value == 0) & ~goes_on]),
        "first_code": first_code, "last_code": last_code,
    }


def _joined(pieces: Columns, gap: int) -> tuple[Columns, np.ndarray, np.ndarray]:
    """Stretches of a project that lie within the gap become one; also the order used and where each begins in it."""
    order = np.lexsort((pieces["opened"], pieces["project"]))
    p = _picked(pieces, order)
    if not len(order):
        return p, order, order
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (p["project"][1:] != p["project"][:-1]) | (p["opened"][1:] - p["last"][:-1] > gap)
    first, chain = np.flatnonzero(opens), np.cumsum(opens) - 1
    end = np.append(first[1:], len(order)) - 1
    known, place = p["last_code"] >= 0, np.arange(len(order))
    # the last known code up to each piece, and the first one from it on
    up_to = np.maximum.accumulate(np.where(known, place, -1))
    onward = np.minimum.accumulate(np.where(known, place, len(order))[::-1])[::-1]
    before = np.append(-1, up_to[:-1])
    goes_on = (p["first_code"] == 0) & (before >= first[chain]) & (p["last_code"][before] == 0)
    total = lambda values: np.add.reduceat(values, first)
    some = up_to[end] >= first
    merged = {
        "project": p["project"][first], "opened": p["opened"][first], "last": p["last"][end], "n": total(p["n"]),
        "active": total(p["active"]), "breaks": total(p["breaks"] - goes_on),
        "first_code": np.where(some, p["first_code"][np.where(some, onward[first], 0)], -1),
        "last_code": np.where(some, p["last_code"][np.where(some, up_to[end], 0)], -1),
    }
    return merged, order, first


class SliceStretches(StatefulProcessor):
    """Rows of one (bucket, slice) to stretches of its projects without a gap above the limit.

    Rows wait until the watermark has passed them, then extend the open stretches in order. A
    stretch near the start of its slice is announced when it opens, so that the second step
    knows whether a stretch of the slice before goes on.
    """

    def __init__(self, gap: int, width: int) -> None:
        self.gap, self.width = gap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BLOBS)
        self.open = handle.getListState("open", _BLOBS)
        self.wake = handle.getValueState("wake", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            columns = {c: frame[c].to_numpy() for c in _ROW}
            for blob in _blobs(pa.array(frame["project_id"], pa.string(), from_pandas=True), columns, _ROW):
                self.waiting.appendValue(blob)
            least = int(columns["micros"].min())
            earliest = least if earliest is None else min(earliest, least)
        self._wake_at(earliest, sooner=True)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.wake.exists() and self.wake.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.wake.clear()
        passed, slice_no = watermark * 1000, int(key[1])
        start, end = slice_no * self.width, (slice_no + 1) * self.width
        names, (waiting, carried) = _numbered(_table(self.waiting.get(), _ROW), _table(self.open.get(), _STRETCH))
        ready = waiting["micros"] < passed
        rest = _picked(waiting, ~ready)
        fresh = _stretches(_picked(waiting, ready), self.gap)
        old = len(carried["project"])
        found, order, first = _joined(_both(carried, fresh, _STRETCH), self.gap)
        # the carried stretches come first in what was joined; the others open now
        opened_now = found["opened"] - start < self.gap
        opened_now &= order[first] >= old
        # a project's last stretch stays open until the watermark is beyond its gap or its slice
        stays = np.append(found["project"][1:] != found["project"][:-1], True)[:len(first)]
        stays &= (passed - found["last"] <= self.gap) & (passed < end)
        if ready.any():
            _put(self.waiting, _blobs(names.take(pa.array(rest["project"])), rest, _ROW))
        still = _picked(found, stays)
        _put(self.open, _blobs(names.take(pa.array(still["project"])), still, _STRETCH))
        times = [int(rest["micros"].min())] if len(rest["micros"]) else []
        if len(still["last"]):
            times.append(min(int(still["last"].min()) + self.gap, end - 1))
        if times:
            self._wake_at(min(times))
        closed, opening = _picked(found, ~stays), _picked(found, opened_now)
        closed["kind"] = np.full(len(closed["last"]), _CLOSED)
        closed["meets_left"] = closed["opened"] - start < self.gap
        closed["meets_right"] = end - closed["last"] <= self.gap
        zero = np.zeros(len(opening["last"]), dtype=np.int64)
        opening.update({"last": opening["opened"], "n": zero, "active": zero, "breaks": zero, "first_code": zero - 1, "last_code": zero - 1})
        opening.update({"kind": zero + _OPENING, "meets_left": zero == 0, "meets_right": zero != 0})
        pieces = _both(closed, opening, [c for c in _PIECE if c != "slice"])
        if len(pieces["project"]):
            result = pd.DataFrame({"cell": key[0], "project_id": names.take(pa.array(pieces.pop("project"))).to_pandas(), **pieces, "slice": slice_no})
            # a row may not be older than the watermark that the next step has seen
            result["due"] = pd.to_datetime(watermark + 1, unit="ms", utc=True)
            yield result
        else:
            yield pd.DataFrame()

    def _wake_at(self, micros: int, sooner: bool = False) -> None:
        """One timer per key: it fires as soon as the watermark is beyond ``micros``."""
        at = micros // 1000
        if self.wake.exists():
            before = self.wake.get()[0]
            if before == at or (sooner and before < at):
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def close(self) -> None:
        pass


class StretchJoiner(StatefulProcessor):
    """Stretches that meet at slice borders to sessions; all others pass through."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", _BLOBS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at_border = bool(key[1])
        for frame in rows:
            columns = {c: frame[c].to_numpy() for c in _PIECE}
            names = pa.array(frame["project_id"], pa.string(), from_pandas=True)
            if at_border:
                for blob in _blobs(names, columns, _PIECE):
                    self.pieces.appendValue(blob)
            else:
                yield self._sessions(names, columns)
        if at_border:
            # the rows of a key may come in several calls, so they settle when all are there: at a timer of this batch
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() - 1, 1))
            yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._settle(timerValues.getCurrentWatermarkInMs() * 1000)

    def _settle(self, passed: int) -> pd.DataFrame:
        """Sessions that can grow no more; the others go back to the state, each as one stretch."""
        names, (known,) = _numbered(_table(self.pieces.get(), _PIECE))
        opening, closed = _picked(known, known["kind"] == _OPENING), _picked(known, known["kind"] == _CLOSED)
        found, order, first = _joined({c: closed[c] for c in ["project", *_STRETCH]}, self.gap)
        last = order[np.append(first[1:], len(order)) - 1] if len(order) else order
        found.update({"kind": closed["kind"][last], "slice": closed["slice"][last]})
        found.update({"meets_left": closed["meets_left"][order[first]], "meets_right": closed["meets_right"][last]})
        after = dict(zip(zip(opening["project"].tolist(), opening["slice"].tolist()), opening["opened"].tolist()))
        nearest = [after.get(k) for k in zip(found["project"].tolist(), (found["slice"] + 1).tolist())]
        near = np.array([at is not None and at - end <= self.gap for at, end in zip(nearest, found["last"].tolist())], dtype=bool)
        right = found["meets_right"].astype(bool)
        goes_on = right & near
        kept = goes_on | (right & (passed - found["last"] <= self.gap))
        ended = set(zip(closed["project"].tolist(), closed["opened"].tolist()))
        ahead = np.array([k not in ended for k in zip(opening["project"].tolist(), opening["opened"].tolist())], dtype=bool)
        rest = _both(_picked(found, kept), _picked(opening, ahead), _PIECE)
        _put(self.pieces, _blobs(names.take(pa.array(rest["project"])), rest, _PIECE))
        waits = found["last"][kept & ~goes_on]
        if len(waits):
            self.handle.registerTimer((int(waits.min()) + self.gap) // 1000)
        done = _picked(found, ~kept)
        return self._sessions(names.take(pa.array(done["project"])), done)

    @staticmethod
    def _sessions(names: pa.Array, stretches: Columns) -> pd.DataFrame:
        counts = (stretches["n"] >= 2) & (stretches["active"] >= 1)
        if not counts.any():
            return pd.DataFrame()
        s = _picked(stretches, counts)
        at = lambda column: pd.to_datetime(s[column], unit="us", utc=True)
        return pd.DataFrame({
            "project_id": names.filter(pa.array(counts)).to_pandas(), "started_at": at("opened"), "ended_at": at("last"),
            "snapshot_count": s["n"], "break_count": s["breaks"],
        })

    def close(self) -> None:
        pass


def stream_sliced_breaks(
    rows: DataFrame, gap_minutes: float = 15.0, delay: str = DEFAULT_DELAY, slice_hours: int = 24, buckets: int = 1024
) -> DataFrame:
    """ST4, WN2: the rows of ``stream_breaks`` with the work of a project spread over its time slices.

    A session is emitted once the watermark is beyond its gap, also when it crosses slices.
    Slices must be longer than the gap. A stream keeps its number of buckets for life.
    """
    gap, width = int(gap_minutes * 60_000_000), slice_hours * 3_600_000_000
    if gap >= width:
        raise ValueError("a slice must be longer than the gap")
    coded = rows.withWatermark("recorded_at", delay).select(
        F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int").alias("cell"),
        time_chunk("recorded_at", slice_hours).cast("bigint").alias("slice"), "project_id", "recorded_at",
        F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.unix_micros("recorded_at").alias("micros"),
        F.coalesce(telemetry.activity_code(), F.lit(-1)).cast("int").alias("code"),
    )
    pieces = coded.groupBy("cell", "slice").transformWithStateInPandas(
        SliceStretches(gap, width), f"cell int, {_PIECE_SCHEMA}, due timestamp", "Append", "EventTime", eventTimeColumnName="due"
    )
    # stretches inside a slice stay with it; those at borders meet in one small group per bucket
    at_border = F.col("meets_left") | F.col("meets_right")
    dealt = pieces.withColumn("at_border", at_border).withColumn("part", F.when(at_border, F.lit(0)).otherwise(F.col("slice")))
    return dealt.groupBy("cell", "at_border", "part").transformWithStateInPandas(
        StretchJoiner(gap), BREAK_SCHEMA, "Append", "EventTime"
    )
