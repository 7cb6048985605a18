"""Removal of bytes in repeated strings of a fixed length, by suffix order.

Every window of ``width`` bytes has an anchor: its ``GRAM``-byte string with the smallest hash, the
leftmost of equal ones. Equal windows have equal anchors at equal offsets, so only windows whose
anchor string occurs at least twice in the corpus can repeat. Those are cut out of their texts as
contexts (consecutive windows with one anchor share one), dealt by anchor, and sorted by suffix.

The suffix array of a set of contexts is built by linear grouping. Contexts are laid out with
their anchors in one column, and a symbol is (column, byte), larger in columns farther left. Then
symbols fall along every context, so a suffix's longest Lyndon prefix is its first symbol, the
groups are the (column, byte) pairs, the previous smaller suffix of each member is the border
before its context, and the second phase (emit each group's order from the suffixes one step to the
right, groups in ascending order) is one stable distribution per column from right to left, with no
renaming. In the order of a column, windows with another copy stand next to it: neighbours that
agree on ``width`` bytes (by a rolling 64-bit hash) are repeats.

The same step runs in the task that cuts the contexts, on its own contexts, first: windows repeated
there are settled, and one of each kind goes on. So a passage that a third of all documents share
reaches the second step once per task, not once per row.

An anchor with more than ``HOT_CONTEXTS`` contexts (a short line that a third of all documents hold
in different surroundings) is not ordered in one task. Its open windows are dealt by the hash of
their ``width`` bytes, so equal ones meet and different ones spread, and equal hashes are repeats.

Cases: a null text is empty; texts shorter than ``width`` lose nothing; matches never cross texts;
rows that repeat a text are repeats of each other, whatever their ids, null ids included; an empty
table gives an empty result. What remains of a text may not be valid UTF-8 and is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.llm import common
from projectpulse.skew import cut_lineage

GRAM = 32
#: contexts ordered together, and bytes of them per task of the second step
ORDER_ROWS, TASK_BYTES = 8192, 8 << 20
#: contexts that are ordered for one anchor; those of anchors with more are dealt as hashes of their windows
HOT_CONTEXTS = 4 * ORDER_ROWS
PLACE = "doc_id bigint, row_key bigint, anchor bigint, at bigint, low bigint, high bigint"
CONTEXT = "kind int, row_key bigint, anchor bigint, lead int, starts int, low bigint, context binary, spans binary"


def sliding_argmin(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost minimum of values[i : i + span] for every whole window."""
    marked = (values & ~np.uint64(0xFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    return (common.sliding_min(marked, span) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, anchor hash, anchor place, first and last window), places within the text."""
    span = width - GRAM + 1
    found = []
    for base in range(0, max(len(data) - width + 1, 0), common.BLOCK_BYTES):  # a window is in one piece only
        piece = data[base : base + common.BLOCK_BYTES + width - 1]
        starts = np.arange(len(piece) - GRAM + 1)
        hashes = common.span_hashes(piece, starts, starts + GRAM)
        place = sliding_argmin(hashes, span)
        window = np.arange(len(place))
        text = np.searchsorted(offsets, window + base, side="right") - 1
        whole = window + base + width <= offsets[text + 1]
        window, place, text = window[whole], place[whole], text[whole]
        if not len(window):
            continue
        head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
        last = np.append(head[1:], len(window)) - 1
        shift = base - offsets[text[head]]
        found.append((text[head], hashes[place[head]], place[head] + shift, window[head] + shift, window[last] + shift))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.blocks(batches):
            text, hashes, at, low, high = anchors(data, offsets, width)
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].take(taken), rows["row_key"].take(taken), pa.array(hashes.astype(np.uint64).view(np.int64)), pa.array(at), pa.array(low), pa.array(high)],
                names=["doc_id", "row_key", "anchor", "at", "low", "high"],
            )

    return run


def repeats(contexts: list[bytes], lead: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every context and window start (counted from the context's begin): is it repeated, is it the first of its kind.

    ``lead``: bytes before the anchor; ``starts``: windows of the context. See the module's text.
    """
    most = int(starts.max())
    repeated, first = np.zeros((len(contexts), most), bool), np.ones((len(contexts), most), bool)
    ahead = int(lead.max())
    columns = ahead + max(len(c) - int(x) for c, x in zip(contexts, lead, strict=True))
    table = np.zeros((len(contexts), columns + 1), np.uint8)
    begin = (ahead - lead).astype(np.int64)
    for row, (context, column) in enumerate(zip(contexts, begin, strict=True)):
        table[row, column : column + len(context)] = np.frombuffer(context, np.uint8)
    table = np.ascontiguousarray(table.T)
    order = np.arange(len(contexts))
    rolling = np.zeros(len(contexts), np.uint64)
    far = np.uint64(pow(int(common.MULTIPLIER), width, 1 << 64))
    for column in reversed(range(columns)):
        symbols = table[column]
        order = order[np.argsort(symbols[order], kind="stable")]  # emit the groups of this column
        rolling = rolling * common.MULTIPLIER + common.BYTE_VALUES[symbols]
        if column + width < columns:
            rolling -= common.BYTE_VALUES[table[column + width]] * far
        start = column - begin
        valid = (start >= 0) & (start < starts)
        if column + width > columns or not valid.any():
            continue
        ranked = order[valid[order]]
        same = rolling[ranked[1:]] == rolling[ranked[:-1]]
        later, earlier = ranked[1:][same], ranked[:-1][same]
        repeated[later, start[later]] = True
        repeated[earlier, start[earlier]] = True
        first[later, start[later]] = False
    return repeated, first


def _in_chunks(anchor: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts whose anchor occurs more than once here, equal anchors together, in chunks of bounded size."""
    _, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[place] > 1)
    shared = shared[np.argsort(anchor[shared], kind="stable")]
    yield from (shared[i : i + ORDER_ROWS] for i in range(0, len(shared), ORDER_ROWS))


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _reach(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of all True as one stretch: settled windows between open ones come along, since a cut would repeat more bytes."""
    place = np.flatnonzero(flags)
    return [(int(place[0]), int(place[-1]) + 1)] if len(place) else []


class _Found:
    """Collects settled spans and contexts that go on."""

    schema = pa.schema([("kind", pa.int32()), ("row_key", pa.int64()), ("anchor", pa.int64()), ("lead", pa.int32()), ("starts", pa.int32()), ("low", pa.int64()), ("context", pa.binary()), ("spans", pa.binary())])

    def __init__(self) -> None:
        self.rows: dict[str, list] = {f.name: [] for f in self.schema}

    def add(self, *values) -> None:
        for name, value in zip(self.rows, values, strict=True):
            self.rows[name].append(value)

    def settle(self, row_key: int, low: int, flags: np.ndarray, width: int) -> None:
        if flags.any():
            spans = _runs(flags) + low
            spans[:, 1] += width - 1
            self.add(1, row_key, None, None, None, None, None, spans.astype(np.int64).tobytes())

    def pass_on(self, row_key: int, anchor: int, lead: int, low: int, context: bytes, flags: np.ndarray, width: int) -> None:
        for start, end in _reach(flags):
            self.add(0, row_key, anchor, lead - start, end - start, low + start, context[start : end + width - 1], None)

    def deal(self, hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, parts: int) -> None:
        """Windows of hot anchors, packed by the part that their hash falls into (as ``anchor``)."""
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for some in np.split(order, common.first_of_runs(part[order])[1:]):
            if len(some):
                self.add(2, None, int(part[some[0]]), None, None, None, hashes[some].tobytes(), np.concatenate((keys[some], places[some])).tobytes())

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(self.rows, schema=self.schema)


def _settle(found: _Found, contexts: list[bytes], keys: np.ndarray, anchor: np.ndarray, lead: np.ndarray, starts: np.ndarray, low: np.ndarray, width: int) -> list[np.ndarray | None]:
    """Settle what repeats here; per context the windows that still stand for their kind (None: all)."""
    open_flags: list[np.ndarray | None] = [None] * len(contexts)
    for some in _in_chunks(anchor):
        if len(some) < 2:
            continue
        repeated, first = repeats([contexts[i] for i in some], lead[some], starts[some], width)
        for row, i in enumerate(some):
            found.settle(int(keys[i]), int(low[i]), repeated[row, : starts[i]], width)
            open_flags[i] = first[row, : starts[i]]
    return open_flags


def _cut_contexts(width: int, parts: int = 1):
    """Contexts of the listed anchors; repeats among this batch's own are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts, keys, anchor, lead, starts, low, hot = [], [], [], [], [], [], []
            for text, key, places in zip(batch["text"], batch["row_key"].to_pylist(), batch["places"].to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                for p in places:
                    contexts.append(bytes(data[p["low"] : p["high"] + width]))
                    keys.append(key)
                    anchor.append(p["anchor"])
                    lead.append(p["at"] - p["low"])
                    starts.append(p["high"] - p["low"] + 1)
                    low.append(p["low"])
                    hot.append(p["hot"])
            if not contexts:
                continue
            arrays = [np.array(x, np.int64) for x in (keys, anchor, lead, starts, low)]
            found = _Found()
            flags = _settle(found, contexts, *arrays, width)
            dealt = []
            for i, open_windows in enumerate(flags):
                every = np.ones(starts[i], bool) if open_windows is None else open_windows
                if hot[i]:
                    begin = np.flatnonzero(every)
                    hashes = common.span_hashes(np.frombuffer(contexts[i], np.uint8), begin, begin + width)
                    dealt.append((hashes, np.full(len(begin), keys[i], np.int64), begin + low[i]))
                    continue
                found.pass_on(keys[i], anchor[i], lead[i], low[i], contexts[i], every, width)
            if dealt:
                found.deal(*(np.concatenate(x) for x in zip(*dealt, strict=True)), parts)
            yield found.batch()

    return run


def _settle_dealt(found: _Found, table: pa.Table, width: int) -> None:
    """Windows of hot anchors: equal hashes are repeats."""
    if not table.num_rows:
        return
    hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["context"]])
    owners = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in table["spans"]]
    keys, places = np.concatenate(owners, axis=1)
    order = np.argsort(hashes, kind="stable")
    heads = common.first_of_runs(hashes[order])
    size = np.diff(np.append(heads, len(order)))
    again = order[np.repeat(size > 1, size)]
    again = again[np.lexsort((places[again], keys[again]))]
    for some in np.split(again, common.first_of_runs(keys[again])[1:]):
        if len(some):
            begin = np.unique(places[some])
            found.add(1, int(keys[some[0]]), None, None, None, None, None, np.stack((begin, begin + width), axis=1).astype(np.int64).tobytes())


def _settle_group(width: int):
    def run(table: pa.Table) -> pa.Table:
        known, dealt = table.filter(pc.equal(table["kind"], 1)), table.filter(pc.equal(table["kind"], 2))
        table = table.filter(pc.equal(table["kind"], 0))
        found = _Found()
        if table.num_rows:
            contexts = [c.as_buffer().to_pybytes() for c in table["context"]]
            arrays = [table[n].to_numpy().astype(np.int64) for n in ("row_key", "anchor", "lead", "starts", "low")]
            _settle_chained(found, contexts, *arrays, width)
        _settle_dealt(found, dealt, width)
        out = found.batch()
        spans = pa.Table.from_batches([out]).select(["row_key", "spans"])
        return pa.concat_tables([known.select(["row_key", "spans"]), spans])

    return run


def _settle_chained(found: _Found, contexts: list[bytes], keys, anchor, lead, starts, low, width: int) -> None:
    """As ``_settle`` for groups beyond one chunk: what stands for its kind in a chunk joins the next one."""
    _, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[place] > 1)
    shared = shared[np.argsort(anchor[shared], kind="stable")]
    held: list[tuple] = []
    at = 0
    while at < len(shared):
        some = shared[at : at + ORDER_ROWS]
        at += len(some)
        rows = held + [(contexts[i], int(keys[i]), int(anchor[i]), int(lead[i]), int(starts[i]), int(low[i])) for i in some]
        repeated, first = repeats([r[0] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), width)
        last = rows[-1][2]
        held = []
        for row, (context, key, own, ahead, number, begin) in enumerate(rows):
            found.settle(key, begin, repeated[row, :number], width)
            if own == last and at < len(shared):
                for start, end in _reach(first[row, :number]):
                    held.append((context[start : end + width - 1], key, own, ahead - start, end - start, begin + start))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, kept = [], [], [], []
        for text, packed in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            sizes.append(len(data))
            if packed:
                spans = np.concatenate([np.frombuffer(p, np.int64) for p in packed]).reshape(-1, 2)
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 1], -1)
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                runs.append(len(_runs(gone)))
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                removed.append(0)
                runs.append(0)
            kept.append(data)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
        )


def _dealt_contexts(keyed: DataFrame, width: int) -> DataFrame:
    """Contexts of repeated anchors, windows of hot ones and settled spans, with the task that takes them."""
    places = cut_lineage(keyed.mapInArrow(_anchor_rows(width), PLACE).drop("doc_id"))
    shared = cut_lineage(places.groupBy("anchor").count().where("count > 1"))
    hot = F.col("count") > HOT_CONTEXTS
    size, many = shared.agg(F.sum(F.when(~hot, F.col("count"))), F.sum(F.when(hot, F.col("count")))).first()
    wanted = places.join(shared.select("anchor", hot.alias("hot")), "anchor")
    per_row = wanted.groupBy("row_key").agg(F.collect_set(F.struct("anchor", "at", "low", "high", "hot")).alias("places"))
    texts = keyed.join(per_row, "row_key").select("text", "row_key", "places")
    parts = max(8, -(-(many or 0) * 24 * (width - GRAM + 1) // TASK_BYTES))  # a window is three numbers
    tasks = max(8, -(-(size or 0) * (width + width // 2) // TASK_BYTES) + (parts if many else 0))
    contexts = texts.mapInArrow(_cut_contexts(width, parts), CONTEXT)
    return contexts.withColumn("task", F.pmod(F.xxhash64(F.coalesce("anchor", "row_key")), F.lit(tasks)))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_bytes."""
    common.small_batches(docs.sparkSession)
    keyed = common.with_row_key(docs, id_col, text_col)
    dealt = _dealt_contexts(keyed, width)
    spans = dealt.groupBy("task").applyInArrow(_settle_group(width), "row_key bigint, spans binary")
    per_text = spans.groupBy("row_key").agg(F.collect_list("spans").alias("spans"))
    joined = keyed.join(per_text, "row_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary")
