"""Survey readings that arrive tile by tile."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitesift.operators.surveys import MERGE_RADIUS, VALUE_TOLERANCE, missing, same_spot, sure
from sitesift.streaming.replay import with_rocksdb

READING = "spot_id BIGINT, x DOUBLE, y DOUBLE, value DOUBLE, raw STRING, confidence DOUBLE"
NAMES = ("spot_id", "x", "y", "value", "raw", "confidence")
#: Rows handed over at once when a drawing ends.
ROWS = 10_000
#: Labels of a square in one part of its state.
SPLIT = 256
#: Kept readings in one part of the state.
CHUNK = 256
CHUNKS = ", ".join(f"{name} ARRAY<{kind}>" for name, kind in (field.split() for field in READING.split(", ")))
#: Squares and value bins are a little wider than twice the reach, so that a probe touches two of them at most.
SIDE, BIN, PAD = 2.01, 2.01, 1.001


class _Merge(StatefulProcessor):
    """Folds readings into the kept ones of a drawing.

    Kept readings lie in map state by slot, CHUNK of them in an entry. A square of the page leads from texts and value bins to the slots there. Readings
    that share such a label lie apart or would have merged, so few slots share one, however crowded the square is. The labels
    of a square are dealt by hash over parts, twice as many whenever a part holds more than SPLIT of them
    on average. A reading looks at four squares with its text and two bins each; a micro-batch
    reads and writes each touched part and chunk once, and the drawing is never held whole unless all of it is touched.
    """

    def __init__(self, radius: float, idle_ms: int | None):
        self.radius = radius
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.squares = handle.getMapState("squares", "cx BIGINT, cy BIGINT", "parts INT, n BIGINT")
        self.near = handle.getMapState("near", "cx BIGINT, cy BIGINT, part INT", "labels ARRAY<STRING>, slots ARRAY<BIGINT>")
        self.kept = handle.getMapState("kept", "chunk BIGINT", CHUNKS)
        self.count = handle.getValueState("count", "n BIGINT, end_ms BIGINT")

    # -- where readings lie

    def _squares(self, reading: dict, reach: float) -> list[tuple[int, int]]:
        """Squares within ``reach`` of a reading; none without a place."""
        side = SIDE * self.radius
        if not (np.isfinite(reading["x"]) and np.isfinite(reading["y"])):
            return []
        across, down = ({int((reading[axis] - reach) // side), int((reading[axis] + reach) // side)} for axis in ("x", "y"))
        return [(cx, cy) for cx in across for cy in down]

    @staticmethod
    def _labels(reading: dict, reach: float) -> list[str]:
        text = "none" if missing(reading["raw"]) else f"text {reading['raw']}"
        value, size = reading["value"], BIN * VALUE_TOLERANCE
        if value is None or not np.isfinite(value):
            return [text]
        bins = {int((value - reach) // size), int((value + reach) // size)}
        return [text, *(f"value {b}" for b in bins)]

    def _keys(self, reading: dict, around: bool) -> list[tuple[tuple[int, int], str]]:
        squares = self._squares(reading, PAD * self.radius if around else 0.0)
        labels = self._labels(reading, PAD * VALUE_TOLERANCE if around else 0.0)
        return [(square, label) for square in squares for label in labels]

    def _size(self, square: tuple[int, int]) -> tuple[int, int]:
        if square not in self.sizes:
            self.sizes[square] = self.squares.getValue(square) or (1, 0)
        return self.sizes[square]

    def _part(self, square: tuple[int, int], part: int) -> dict[str, list[int]]:
        key = (*square, part)
        if key not in self.read:
            own = self.read[key] = {}
            for label, slot in zip(*(self.near.getValue(key) or ((), ()))):
                own.setdefault(label, []).append(slot)
        return self.read[key]

    def _slots(self, square: tuple[int, int], label: str) -> list[int]:
        parts, n = self._size(square)
        return self._part(square, zlib.crc32(label.encode()) % parts).get(label, []) if n else []

    def _place(self, reading: dict, slot: int, there: bool) -> None:
        for square, label in self._keys(reading, False):
            parts, n = self._size(square)
            part = zlib.crc32(label.encode()) % parts
            slots = self._part(square, part).setdefault(label, [])
            if there:
                slots.append(slot)
            else:
                slots.remove(slot)
            self.written.add((*square, part))
            self.sizes[square] = (parts, n + (1 if there else -1))
            if n >= SPLIT * parts:
                self._split(square)

    def _split(self, square: tuple[int, int]) -> None:
        parts, n = self._size(square)
        before = [self._part(square, part) for part in range(parts)]
        for part in range(2 * parts):
            self.read[*square, part] = {}
            self.written.add((*square, part))
        for own in before:
            for label, slots in own.items():
                self.read[*square, zlib.crc32(label.encode()) % (2 * parts)][label] = slots
        self.sizes[square] = (2 * parts, n)

    def _write(self) -> None:
        for key in self.written:
            labels = [label for label, slots in self.read[key].items() for _ in slots]
            self.near.updateValue(key, (labels, [slot for slots in self.read[key].values() for slot in slots]))
        for square in {key[:2] for key in self.written}:
            self.squares.updateValue(square, self.sizes[square])
        for number in {slot // CHUNK for slot in self.changed}:
            self.kept.updateValue((number,), tuple([e[k] for e in self.chunks[number]] for k in NAMES))

    # -- kept readings

    def _chunk(self, number: int) -> list[dict]:
        if number not in self.chunks:
            stored = self.kept.getValue((number,))
            self.chunks[number] = [dict(zip(NAMES, row)) for row in zip(*stored)] if stored else []
        return self.chunks[number]

    def _entry(self, slot: int) -> dict:
        return self._chunk(slot // CHUNK)[slot % CHUNK]

    def _keep(self, slot: int, reading: dict) -> None:
        chunk, place = self._chunk(slot // CHUNK), slot % CHUNK
        chunk[place:place + 1] = [reading]  # or at the end
        self.changed.add(slot)

    # -- folding

    def _fold(self, reading: dict, n: int) -> int:
        """The new count of kept readings."""
        for slot in sorted({s for key in self._keys(reading, True) for s in self._slots(*key)}):
            entry = self._entry(slot)
            if same_spot(entry, reading, self.radius):
                if sure(reading["confidence"]) > sure(entry["confidence"]):
                    self._place(entry, slot, False)
                    self._place(reading, slot, True)
                    self._keep(slot, reading)
                return n
        self._keep(n, reading)
        self._place(reading, n, True)
        return n + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if missing(key[0]):  # a row without a drawing only tells the time
            return
        n, end = self.count.get() if self.count.exists() else (0, None)
        self.sizes: dict[tuple[int, int], tuple[int, int]] = {}
        self.read: dict[tuple[int, int, int], dict[str, list[int]]] = {}
        self.written: set[tuple[int, int, int]] = set()
        self.chunks: dict[int, list[dict]] = {}
        self.changed: set[int] = set()
        arrived = pd.concat(list(rows)).sort_values("spot_id")
        for reading in arrived[list(NAMES)].to_dict("records"):
            n = self._fold(reading, n)
        self._write()
        if self.idle_ms is not None:
            last = int(arrived["seen_at"].max().timestamp() * 1000) + self.idle_ms
            if end is None or last > end:
                if end is not None:
                    self.handle.deleteTimer(end)
                self.handle.registerTimer(last)
                end = last
        self.count.update((n, end))
        if self.idle_ms is None and self.changed:
            yield pd.DataFrame([(key[0], slot, *self._entry(slot).values()) for slot in sorted(self.changed)],
                               columns=["drawing_id", "slot", *NAMES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The drawing has ended: its kept readings go out, its state goes."""
        out = []
        for chunk, stored in self.kept.iterator():
            out += [(key[0], chunk[0] * CHUNK + place, *reading) for place, reading in enumerate(zip(*stored))]
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["drawing_id", "slot", *NAMES])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["drawing_id", "slot", *NAMES])
        for state in (self.squares, self.near, self.kept, self.count):
            state.clear()

    def close(self) -> None:
        pass


def _merged(readings: DataFrame, radius: float, idle_ms: int | None, mode: str, time: str) -> DataFrame:
    with_rocksdb(readings.sparkSession)
    return readings.groupBy("drawing_id").transformWithStateInPandas(
        statefulProcessor=_Merge(radius, idle_ms), outputMode=mode, timeMode=time,
        outputStructType=f"drawing_id BIGINT, slot BIGINT, {READING}")


def stream_dedupe_spots(readings: DataFrame, radius: float = MERGE_RADIUS) -> DataFrame:
    """Changes of the kept readings as tiles arrive: (drawing_id, slot, reading).

    ``slot`` names a kept reading for good; a later row of the same slot
    replaces it. Readings of one micro-batch are taken in spot_id order; one drawing's share of a
    micro-batch is held by its task, so the source's trigger limits bound it.
    """
    return _merged(readings.select("drawing_id", *NAMES), radius, None, "Update", "None")


def stream_finished_drawings(
    readings: DataFrame, radius: float = MERGE_RADIUS, idle: str = "30 minutes", late: str = "0 seconds",
) -> DataFrame:
    """The kept readings of every drawing, once, when it has ended: (drawing_id, slot, reading).

    ``readings`` also has seen_at. A drawing ends when event time (the newest seen_at less ``late``) passes
    its last reading by ``idle``; then its rows go out and all of its state is dropped. Rows that are older than event time
    are dropped. A row without drawing_id is no reading: it only moves event time on, as a source may send after its last tile.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return _merged(readings.select("drawing_id", *NAMES, "seen_at").withWatermark("seen_at", late), radius, idle_ms, "Append", "EventTime")
