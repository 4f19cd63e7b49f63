"""Sites that arrive and move over time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from sitesift.functions import geometry as G
from sitesift.operators import grid
from sitesift.operators.sites import BOX, equal_shapes, with_box
from sitesift.streaming.replay import with_rocksdb


@dataclass(frozen=True)
class CellTable:
    """Features laid out by grid cell in a stored, bucketed table, so that no batch lays them out or moves them again."""

    name: str
    levels: tuple[int, ...]
    attrs: tuple[str, ...]


CELL = ("_level", "_cx", "_cy")


def store_cells(
    features: DataFrame, name: str, path: str, attrs: tuple[str, ...] = ("unit_code", "name"),
    buckets: int = 64, stored_box: Sequence[str] | None = None,
) -> CellTable:
    """Write table ``name`` at ``path``: one row for each cell that a feature's box touches on its own level.

    Bucketed by cell: the stream's side alone is exchanged, into as many partitions. A cell of very many
    features is one bucket's part; coarser features lie on their own levels and do not add to it.
    """
    # Of equal polygons the first in source order is the one that every lookup finds.
    boxed, _ = equal_shapes(with_box(features, True, stored_box))
    if attrs:
        boxed = boxed.join(features.select("feature_seq", *attrs), "feature_seq")
    west, south, east, north = (F.col(c) for c in BOX)
    shaped = boxed.select(
        "feature_seq", *attrs, (west - G.EDGE_TOLERANCE).alias("_w"), (south - G.EDGE_TOLERANCE).alias("_s"),
        (east + G.EDGE_TOLERANCE).alias("_e"), (north + G.EDGE_TOLERANCE).alias("_n"), grid.box_level(*BOX).alias("_level"),
        G.flat_edges("polygon").alias("_outer"), G.hole_edges("holes").alias("_inner"))
    celled = grid._explode_cells(shaped, ("_w", "_s", "_e", "_n"))
    celled.write.mode("overwrite").option("path", path).bucketBy(buckets, *CELL).sortBy(*CELL).saveAsTable(name)
    stored = features.sparkSession.table(name)
    levels = tuple(r["_level"] for r in stored.select("_level").distinct().orderBy("_level").collect())  # 45 at most
    return CellTable(name, levels, attrs)


def units_by_cell(sites: DataFrame, cells: CellTable, key: str) -> DataFrame:
    """``sites`` (key, lat, lng) with the first feature in source order that holds each; static side as stored."""
    table = sites.sparkSession.table(cells.name)
    located = sites.select("lat", "lng").where(G.valid_location("lat", "lng")).distinct()
    placed = located.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in cells.levels]).cast("array<int>")))
    for axis, name in (("lng", "_cx"), ("lat", "_cy")):
        placed = placed.withColumn(name, grid.cell_of(F.col(axis), F.col("_level")))
    held = placed.join(table, list(CELL)).where(
        F.col("lng").between(F.col("_w"), F.col("_e")) & F.col("lat").between(F.col("_s"), F.col("_n"))
        & G.point_in_polygon_edges("lng", "lat", "_outer", "_inner"))
    first = held.groupBy("lat", "lng").agg(F.min(F.struct("feature_seq", *cells.attrs)).alias("_unit"))
    return sites.join(first, ["lat", "lng"], "left").select(*sites.columns, "_unit.feature_seq", *[f"_unit.{a}" for a in cells.attrs])


def stream_site_units(
    events: DataFrame, cells: CellTable, path: str, checkpoint: str, key: str = "event_id", **trigger,
) -> StreamingQuery:
    """Look up the unit of every arriving site (key, lat, lng) and append it to ``path``.

    The features are a table of ``store_cells``. Each micro-batch is written to
    a folder of its own, so that a repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        units_by_cell(batch, cells, key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Newest(StatefulProcessor):
    """Keeps revision and place of a project; late revisions are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "revision BIGINT, lat DOUBLE, lng DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.place.get() if self.place.exists() else None
        newest = None
        for batch in rows:
            last = batch.loc[batch["revision"].idxmax()]
            if newest is None or last["revision"] > newest[0]:
                newest = (int(last["revision"]), float(last["lat"]), float(last["lng"]))
        if newest is None or (known is not None and newest[0] <= known[0]):
            return
        moved = known is None or known[1] != newest[1] or known[2] != newest[2]
        self.place.update(newest)
        yield pd.DataFrame({
            "project_id": [key[0]], "revision": [newest[0]], "lat": [newest[1]],
            "lng": [newest[2]], "site_changed": [moved]})

    def close(self) -> None:
        pass


def latest_site_stream(events: DataFrame) -> DataFrame:
    """Stream of (project_id, revision, lat, lng, site_changed): newest revision only.

    ``events``: project_id, revision, lat, lng. ``site_changed`` tells the
    dependents (historical items, saved views) to reset. Needs the RocksDB
    state store.
    """
    slim = events.select("project_id", "revision", "lat", "lng")
    return slim.groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=_Newest(), outputMode="Append", timeMode="None",
        outputStructType="project_id BIGINT, revision BIGINT, lat DOUBLE, lng DOUBLE, "
                         "site_changed BOOLEAN")


CHANGE = "kind STRING, revision BIGINT, item STRING, lat DOUBLE, lng DOUBLE, sequence BIGINT"


class _Project(StatefulProcessor):
    """Place, dated items and saved views of a project, each in state of its own; a move of the site clears the last two."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "revision BIGINT, moved BIGINT, lat DOUBLE, lng DOUBLE")
        self.items = handle.getMapState("items", "item STRING", "revision BIGINT, sequence BIGINT")
        self.views = handle.getMapState("views", "item STRING", "revision BIGINT")
        self.counters = handle.getValueState("counters", "n BIGINT, end_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        n, end = self.counters.get() or (0, None)
        known = None if end is None else self.place.get()
        # What the rows add lies here until the end; the stored items and views are read and dropped once, at the first move.
        items: dict[str, tuple[int, int]] = {}
        views: dict[str, tuple[int]] = {}
        unread, out = end is not None, []
        arrived, seen = [], []
        for batch in rows:
            arrived += zip(*(batch[c].tolist() for c in ("revision", "kind", "item", "lat", "lng")))
            seen.append(batch["ts"].max())
        for revision, kind, item, lat, lng in sorted(arrived, key=lambda row: (row[0], row[1] is None, row[1] or "")):
            revision = int(revision)
            if kind == "site":
                if known is not None and revision <= known[0]:
                    continue  # a late answer
                moved = known is None or (known[2], known[3]) != (lat, lng)
                known = (revision, revision if moved else known[1], lat, lng)
                if moved:
                    out.append(("site", revision, None, lat, lng, None))
                    if unread:
                        items = {i[0]: v for i, v in self.items.iterator()} | items
                        views = {i[0]: v for i, v in self.views.iterator()} | views
                        self.items.clear()
                        self.views.clear()
                        unread = False
                    out += [("historical", revision, i, None, None, v[1]) for i, v in items.items()]
                    out += [("view", revision, i, None, None, None) for i in views]
                    items, views, n = {}, {}, 0
            elif known is None or revision > known[1]:  # else it belongs to a place that the site has left
                if kind == "historical":
                    n += 1
                    items[item] = (revision, n)
                else:
                    views[item] = (revision,)
        for state, added in ((self.items, items), (self.views, views)):
            for item, value in added.items():
                state.updateValue((item,), value)
        if known is not None:
            self.place.update(known)
        last = int(max(seen).timestamp() * 1000) + self.idle_ms
        if end is None or last > end:
            if end is not None:
                self.handle.deleteTimer(end)
            self.handle.registerTimer(last)
            end = last
        self.counters.update((n, end))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out],
                               columns=["project_id", "kind", "revision", "item", "lat", "lng", "sequence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.place, self.items, self.views, self.counters):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_site_changes(events: DataFrame, idle: str = "90 days", late: str = "0 seconds") -> DataFrame:
    """What a moving site does to its project: (project_id, kind, revision, item, lat, lng, sequence).

    ``events``: project_id, revision, kind (site, historical or view), item, lat, lng, ts. A site row newer than the known one
    counts; if it is elsewhere, a row of kind ``site`` goes out, and one row for each dated item (with its number since the last
    move) and each saved view that goes with the old place; numbering starts anew. Rows of a place already left are
    thrown away. A project without events for ``idle`` of event time loses its state; what comes for it afterwards is a new project's.
    The rows of a project in one micro-batch are taken in the order of their revision, and held by one task.
    """
    with_rocksdb(events.sparkSession)
    slim = events.select("project_id", "revision", "kind", "item", "lat", "lng", "ts").withWatermark("ts", late)
    return slim.groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=_Project(int(pd.Timedelta(idle).total_seconds() * 1000)), outputMode="Append", timeMode="EventTime",
        outputStructType=f"project_id BIGINT, {CHANGE}")


def latest_site(events: DataFrame, project: str = "project_id", revision: str = "revision") -> DataFrame:
    """The same answer over a whole table, combined before the shuffle."""
    rest = [c for c in events.columns if c not in (project, revision)]
    return events.groupBy(project).agg(
        F.max(revision).alias(revision),
        *[F.max_by(c, revision).alias(c) for c in rest])


def tile_progress(
    events: DataFrame, run: str, time: str = "ts", window: str = "1 hour",
    watermark: str | None = "1 hour", done: Column | None = None,
) -> DataFrame:
    """Done and total per run and tumbling window, for a stream or a table."""
    finished = F.lit(True) if done is None else done
    timed = events.withWatermark(time, watermark) if events.isStreaming and watermark else events
    return timed.groupBy(run, F.window(time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(finished).alias("done")).select(
        run, F.col("w.start").alias("window_start"), "total", "done")
