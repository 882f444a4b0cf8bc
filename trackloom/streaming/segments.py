"""Streaming segmentation: the rally machine fed by a stream of the sources' frame evidence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trackloom.operators.rallies import ENDING, LIVE, START_STATE, STARTING, rally_machine
from trackloom.settings import RallySettings

OUTPUT = "source_id long, start_frame long, end_frame long, at_frame long, kind string"
BLOCK = 512  # frames of a source that wait in one entry of the state
SEGMENT_SHARDS = 1024  # sources are dealt to this many keys of the state
GROUP = 16  # sources of a shard that share the entries of their waiting blocks
HELD_ROWS = 1 << 16  # new rows of a shard that a task holds at a time
LEAST = -(1 << 63)


def open_start(entry: str) -> int | None:
    """First frame of the interval a machine state leaves open; None if it leaves none that counts."""
    name, _, *more = json.loads(entry)
    counts = name in (LIVE, ENDING) or name == STARTING and (more[2] or not more[1])
    return more[0] if counts else None


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # frames in order, each once, with their bits and times
WIDTH = np.dtype([("source", "<i8"), ("frame", "<i8"), ("bits", "<i8"), ("ms", "<i8")])


def merged(rows: Rows, more: Rows) -> Rows:
    """Both in order of frames; of a frame that both have, the row of ``more`` stays."""
    columns = [np.concatenate(pair) for pair in zip(rows, more)]
    order = np.argsort(columns[0], kind="stable")
    frames = columns[0][order]
    order = order[np.append(frames[1:] != frames[:-1], True)] if len(frames) else order
    return tuple(c[order] for c in columns)


NO_ROWS: Rows = tuple(np.zeros(0, np.int64) for _ in range(3))


def packed(rows: dict[int, Rows]) -> bytes:
    """The waiting rows of several sources as one piece of bytes."""
    out = np.empty(sum(len(f) for f, _, _ in rows.values()), WIDTH)
    at = 0
    for source, columns in rows.items():
        part = out[at:at + len(columns[0])]
        part["source"], part["frame"], part["bits"], part["ms"] = source, *columns
        at += len(part)
    return out.tobytes()


def unpacked(piece: bytes) -> dict[int, Rows]:
    table = np.frombuffer(bytes(piece), WIDTH)
    source = table["source"]
    cuts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), len(source)]
    return {int(source[a]): tuple(table[c][a:b].copy() for c in ("frame", "bits", "ms")) for a, b in zip(cuts, cuts[1:]) if a < b}


def gathered(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in frames of about ``HELD_ROWS``, each source's rows together and in the order they came."""
    held = []
    for pdf in rows:
        held.append(pdf)
        if sum(map(len, held)) >= HELD_ROWS:
            yield pd.concat(held).sort_values("source_id", kind="stable")
            held = []
    if held:
        yield pd.concat(held).sort_values("source_id", kind="stable")


class Segmenter(StatefulProcessor):
    """A shard of sources: of each the machine's state and next due frame in one value, frames that came early in a map of blocks.

    The value holds per source [machine's state, due frame, newest time, when a gap is given up, when silence ends its play,
    blocks that wait]; the shard's only timer is the earliest of those times. Sources are numbered as they come; ``GROUP`` of them
    share an entry of the map per block, so that many short sources do not cost a call each. Of the waiting frames a task holds
    some entries, ``HELD_ROWS`` in all or one more, and ``HELD_ROWS`` new ones at a time; the rest stays in the state store.
    Sources without an id are shard -1.
    """

    def __init__(self, settings: RallySettings, first_frame: int, patience_ms: int, idle_ms: int):
        self.settings, self.first_frame, self.patience_ms, self.idle_ms = settings, first_frame, patience_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = rally_machine(self.settings, "spans")
        self.places = handle.getValueState("places", "sources string, timer_ms long")
        self.waiting = handle.getMapState("waiting", "part long, block long", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        self._load(key)
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in gathered(rows):
            ids, frames, bits = (pdf[c].to_numpy() for c in ("source_id", "frame", "bits"))
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for source in ids[cuts[:-1]].tolist():
                self.number.setdefault(source, len(self.number))
            for a, b in sorted(zip(cuts, cuts[1:]), key=lambda cut: self.number[int(ids[cut[0]])]):
                self._enter(int(ids[a]))
                self.last_ms = max(self.last_ms, int(ms[a:b].max()))
                due = np.flatnonzero(frames[a:b] >= self.due) + a
                if bits.dtype.kind == "f" and np.isnan(bits[due]).any():
                    raise ValueError("a frame has no evidence bits")
                yield from self._advance(merged(NO_ROWS, (frames[due], bits[due].astype(np.int64), ms[due])), now, False)
                self._leave()
        yield from self._told()
        self._save(None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key)
        expired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for source in [s for s, (*_, gap_ms, end_ms, _) in self.sources.items() if any(t is not None and t <= now for t in (gap_ms, end_ms))]:
            self._enter(source)
            over = self.end_ms is not None and self.end_ms <= now
            yield from self._advance(NO_ROWS, now, over)
            if over:
                start, last = open_start(self.entry), self.due - 1
                self.entry, self.last_ms = START_STATE, -1
                if start is not None:
                    self._tell(max(start, self.first_frame), last, last + 1, "open")
            self._leave()
        yield from self._told()
        self._save(expired)

    def close(self) -> None:
        pass

    def _load(self, key: tuple) -> None:
        sources, self.timer_ms = self.places.get() if self.places.exists() else ("{}", None)
        self.sources, self.unnamed, self.rows = {int(s): place for s, place in json.loads(sources).items()}, key[0] < 0, []
        self.number = {source: i for i, source in enumerate(self.sources)}
        # entries of the map: those in the state store, those at hand and those at hand that differ from what is stored
        self.stored = {(i // GROUP, block) for i, place in enumerate(self.sources.values()) for block in place[5]}
        self.entries: dict[tuple[int, int], dict[int, Rows]] = {}
        self.changed: set[tuple[int, int]] = set()

    def _save(self, expired: int | None) -> None:
        self._flush()
        wanted = min((t for place in self.sources.values() for t in place[3:5] if t is not None), default=None)
        there = None if self.timer_ms == expired else self.timer_ms
        if wanted != there:
            if there is not None:
                self.handle.deleteTimer(there)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.places.update((json.dumps(self.sources), wanted))

    def _enter(self, source: int) -> None:
        self.source = source
        self.entry, self.due, self.last_ms, self.gap_ms, self.end_ms, blocks = self.sources.get(source, (START_STATE, self.first_frame, -1, None, None, ()))
        self.blocks = set(blocks)

    def _leave(self) -> None:
        self.end_ms = self.last_ms + self.idle_ms if self.last_ms >= 0 else None
        self.sources[self.source] = [self.entry, self.due, self.last_ms, self.gap_ms, self.end_ms, sorted(self.blocks)]

    def _entry(self, block: int) -> dict[int, Rows]:
        """The waiting rows of the source's group in a block."""
        key = (self.number[self.source] // GROUP, block)
        if key not in self.entries:
            if self.entries and (key[0] != next(iter(self.entries))[0] or sum(len(r[0]) for e in self.entries.values() for r in e.values()) >= HELD_ROWS):
                self._flush()
            self.entries[key] = unpacked(self.waiting.getValue(key)[0]) if key in self.stored else {}
        return self.entries[key]

    def _flush(self) -> None:
        """Give the entries at hand back to the state store."""
        for key in self.changed:
            if self.entries[key]:
                self.waiting.updateValue(key, (packed(self.entries[key]),))
                self.stored.add(key)
            elif key in self.stored:
                self.waiting.removeKey(key)
                self.stored.discard(key)
        self.entries, self.changed = {}, set()

    def _take(self, block: int) -> Rows:
        """The waiting frames of a block, which leave the state."""
        rows = self._entry(block).pop(self.source)
        self.changed.add((self.number[self.source] // GROUP, block))
        self.blocks.discard(block)
        first = int(np.searchsorted(rows[0], self.due))
        return tuple(c[first:] for c in rows)

    def _advance(self, held: Rows, now: int, over: bool) -> Iterator[pd.DataFrame]:
        """Feed the machine all frames that are due; give up frames that the watermark says are lost. ``held``: no frame before the one due."""
        ready, waits, self.gap_ms = [], 0, None
        while True:
            frames = held[0]
            if (not len(frames) or frames[0] != self.due) and self.due // BLOCK in self.blocks:
                held = merged(held, self._take(self.due // BLOCK))
                continue
            if len(frames) and frames[0] == self.due:
                steps = np.flatnonzero(np.diff(frames) != 1)
                run = int(steps[0]) + 1 if len(steps) else len(frames)
                ready.append((frames[:run], held[1][:run]))
                held, self.due, waits = tuple(c[run:] for c in held), self.due + run, waits + run
                if waits >= 16 * BLOCK:
                    yield from self._feed(ready)
                    waits = 0
                continue
            if self.blocks and (not len(frames) or min(self.blocks) <= frames[0] // BLOCK):
                held = merged(held, self._take(min(self.blocks)))
                continue
            if not len(frames):
                break
            deadline, first = int(held[2][0]) + self.patience_ms, int(frames[0])
            if not over and deadline > now:
                self.gap_ms = deadline
                break
            self._tell(self.due, first - 1, first, "gap")
            self.due = first
        yield from self._feed(ready)
        self._store(held)

    def _store(self, held: Rows) -> None:
        blocks = held[0] // BLOCK
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            block, rows = int(blocks[a]), tuple(c[a:b] for c in held)
            entry = self._entry(block)
            entry[self.source] = merged(entry[self.source], rows) if block in self.blocks else rows
            self.changed.add((self.number[self.source] // GROUP, block))
            self.blocks.add(block)

    def _feed(self, ready: list) -> Iterator[pd.DataFrame]:
        if ready:
            rows, self.entry = self.machine(dict(zip(("frame", "bits"), map(np.concatenate, zip(*ready)))), self.entry)
            ready.clear()
            for start, end, at in zip(rows["start_frame"], rows["end_frame"], rows["at_frame"]):
                self._tell(max(start, self.first_frame), end, at, "ended")
        if len(self.rows) >= HELD_ROWS:
            yield from self._told()

    def _tell(self, start: int, end: int, at: int, kind: str) -> None:
        self.rows.append((None if self.unnamed else self.source, start, end, at, kind))

    def _told(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            yield pd.DataFrame(self.rows, columns=["source_id", "start_frame", "end_frame", "at_frame", "kind"])
            self.rows = []


def stream_segment(evidence: DataFrame, settings: RallySettings = RallySettings(), first_frame: int = 0, late: str = "1 minute",
                   patience_seconds: float = 0.0, idle_seconds: float = 60.0, shards: int = SEGMENT_SHARDS) -> DataFrame:
    """Intervals as they end, and what the stream leaves open. ``evidence``: source_id, frame, bits (see ``with_evidence``), ts.

    Frames may arrive out of order within and across batches: they wait in the state until the frames before them are
    there; frames already consumed are ignored. ``kind`` of a row: "ended"; "gap": frames given up because the watermark
    (``late`` behind the newest ``ts``) passed the first frame after them by ``patience_seconds``, the machine goes on behind
    them; "open": play that was still on when the source had been silent for ``idle_seconds`` of event time, for review.
    A source that speaks again after that starts at rest and goes on with its next frame. Needs the RocksDB state store.
    Sources are dealt to ``shards`` keys of the state: Python and the state store are called per shard and trigger, not per source.
    """
    processor = Segmenter(settings, first_frame, int(patience_seconds * 1000), int(idle_seconds * 1000))
    unnamed = F.col("source_id").isNull()
    # no nulls among whole numbers, which pandas would turn into floats; a row without a frame only tells that its source is there
    rows = evidence.select(F.when(unnamed, F.lit(-1)).otherwise(F.pmod(F.xxhash64("source_id"), F.lit(shards))).cast("long").alias("shard"),
                           F.coalesce(F.col("source_id").cast("long"), F.lit(0)).alias("source_id"),
                           F.coalesce(F.col("frame").cast("long"), F.lit(LEAST)).alias("frame"), "bits", "ts")
    return rows.withWatermark("ts", late).groupBy("shard").transformWithStateInPandas(processor, OUTPUT, "Append", "eventTime")
