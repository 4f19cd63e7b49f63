"""Streams over files against their table forms."""

import random

import pytest
from pyspark.sql import functions as F

from sitesift.operators.sites import site_unit
from sitesift.plans.bindings import Source
from sitesift.plans.site_queries import features
from sitesift.plans.stream_queries import MOVES
from sitesift.plans.survey_queries import SPOTS
from sitesift.streaming.replay import arrive, finished
from sitesift.streaming.sites import (
    latest_site, latest_site_stream, store_cells, stream_site_changes, stream_site_units, tile_progress, units_by_cell)
from sitesift.streaming.spots import NAMES, stream_dedupe_spots, stream_finished_drawings
from sitesift.operators.surveys import KeptReadings

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def source(spark):
    return Source(spark, FOLDER)


def as_stream(spark, df, path, files=3):
    df.repartitionByRange(files, df.columns[0]).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode, tmp_path):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_site_units(spark, source, tmp_path):
    moves = source.sql(MOVES).select("revision", "lat", "lng").where("revision < 300").union(
        spark.createDataFrame([(1000, None, 1.0), (1001, 91.0, 1.0), (1002, 0.0, 0.0)], "revision bigint, lat double, lng double"))
    cells = store_cells(features(source), "cells_of_test", str(tmp_path / "cells"), (), 4)
    stream = as_stream(spark, moves, str(tmp_path / "in"))
    query = stream_site_units(stream, cells, str(tmp_path / "out"), str(tmp_path / "cp"), "revision")
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("revision", "feature_seq")
    want = site_unit(moves, features(source), (), "revision").select("revision", "feature_seq")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = units_by_cell(moves, cells, "revision")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("FileScan parquet"):]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(_level") == 1, scan[:300]
    spark.sql("DROP TABLE cells_of_test")


def test_only_the_newest_revision_counts(spark, source, tmp_path):
    moves = source.sql(MOVES).select("revision", "project_id", "lat", "lng").where("project_id < 12")
    out = run(latest_site_stream(as_stream(spark, moves, str(tmp_path / "in"))), "newest", "append", tmp_path)
    last = out.groupBy("project_id").agg(F.max("revision").alias("revision"), F.max_by("lat", "revision").alias("lat"))
    want = latest_site(moves).select("project_id", "revision", "lat")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert out.where("site_changed").count() > 0


def test_readings_merge_tile_by_tile(spark, source, tmp_path):
    rows = source.sql(SPOTS).where("drawing_id < 3").select("spot_id", "drawing_id", *NAMES[1:])
    # One file after the other, so that they are read in spot order.
    low, high = rows.approxQuantile("spot_id", [0.33, 0.66], 0.01)
    third = F.col("spot_id")
    for part in (third <= low, (third > low) & (third <= high), third > high):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(stream_dedupe_spots(stream), "merged", "update", tmp_path)
    kept = {}
    for r in sorted(rows.collect(), key=lambda r: r["spot_id"]):
        kept.setdefault(r["drawing_id"], KeptReadings(40.0)).add({k: r[k] for k in NAMES})
    want = {(d, i): e["confidence"] for d, k in kept.items() for i, e in enumerate(k.entries)}
    got = {}
    for r in out.collect():
        key = (r["drawing_id"], r["slot"])
        got[key] = max(got.get(key, 0), r["confidence"])
    assert got == want


def test_progress(spark, source, tmp_path):
    events = source.table("events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).alias("run"))
    stream = as_stream(spark, events, str(tmp_path / "in"))
    out = run(tile_progress(stream, "run"), "progress", "complete", tmp_path)
    want = tile_progress(events, "run")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def at(minutes):
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(60) * minutes)


def test_drawings_end_once_and_lose_their_state(spark, tmp_path, monkeypatch):
    """A crowd of texts on one square, missing texts and places, readings that move a kept one; drawing 2 comes back after its end."""
    from sitesift.streaming import spots

    monkeypatch.setattr(spots, "SPLIT", 8)
    r = random.Random(3)
    rows, n = [], 0
    for part in range(3):
        for drawing in (1, 2) if part == 0 else (1,):
            for _ in range(60):
                n += 1
                raw = r.choice([None, "", f"{r.randrange(40)}.5"])
                rows.append((drawing, n, r.uniform(-5, 90), r.uniform(0, 90), r.choice([None, float("nan"), r.randrange(50) / 100]), raw,
                             r.choice([None, 0.2, 0.5, 0.9]), part))
    rows += [(1, 900, float("nan"), 3.0, 1.0, "a", 0.5, 2), (1, 901, float("nan"), 3.0, 1.0, "a", 0.5, 2), (None, 0, 0.0, 0.0, None, None, None, 3),
             (2, 950, 1.0, 1.0, 7.0, "late", 0.5, 4), (None, 0, 0.0, 0.0, None, None, None, 5)]
    df = spark.createDataFrame(rows, "drawing_id bigint, spot_id bigint, x double, y double, value double, raw string, confidence double, part int")
    minutes = F.element_at(F.array(*[F.lit(m) for m in (0, 20, 40, 200, 210, 900)]), F.col("part") + 1)
    stream = arrive(df.withColumn("seen_at", at(minutes)), "part", "drawing_id", str(tmp_path / "in"), 6, 1)
    out = finished(stream_finished_drawings(stream, idle="30 minutes")).collect()
    want = {}
    for row in sorted(df.where("drawing_id IS NOT NULL AND x = x AND NOT isnan(x)").collect(), key=lambda x: x.spot_id):
        key = (row.drawing_id, row.part == 4)
        want.setdefault(key, KeptReadings(40.0)).add({k: row[k] for k in NAMES})
    ids = sorted((d, e["spot_id"]) for (d, _), k in want.items() for e in k.entries) + [(1, 900), (1, 901)]
    assert sorted((x.drawing_id, x.spot_id) for x in out) == sorted(ids)


def test_a_move_clears_what_belongs_to_the_old_place(spark, tmp_path):
    rows = [
        (1, 1, "site", None, 1.0, 2.0, 0), (1, 2, "historical", "a", None, None, 0), (1, 3, "view", "A", None, None, 0),
        (1, 4, "site", None, 1.0, 2.0, 1), (1, 5, "historical", "b", None, None, 1),  # same place: nothing goes
        (1, 7, "site", None, 3.0, 2.0, 2), (1, 8, "historical", "c", None, None, 2),
        (1, 6, "historical", "late", None, None, 3), (1, 5, "site", None, 9.0, 9.0, 3),  # late answers
        (1, 9, "site", None, 4.0, 2.0, 3), (2, 1, "view", "A", None, None, 0), (2, 2, "site", None, 0.0, 0.0, 1),
        (2, 3, "view", "B", None, None, 6), (2, 1, "site", None, 5.0, 5.0, 6)]  # project 2 was forgotten
    df = spark.createDataFrame(rows, "project_id bigint, revision bigint, kind string, item string, lat double, lng double, part int")
    beat = spark.createDataFrame([(None, 0, "site", None, None, None, p) for p in (4, 5)], df.schema)
    stream = arrive(df.union(beat).withColumn("ts", at(F.col("part") * 100)), "part", "project_id", str(tmp_path / "in"), 7, 1)
    out = finished(stream_site_changes(stream, idle="250 minutes")).collect()
    assert sorted(((r.project_id, r.revision, r.kind, r.item, r.lat, r.sequence) for r in out), key=repr) == sorted([
        (1, 1, "site", None, 1.0, None), (1, 7, "site", None, 3.0, None), (1, 7, "historical", "a", None, 1), (1, 7, "historical", "b", None, 2),
        (1, 7, "view", "A", None, None), (1, 9, "site", None, 4.0, None), (1, 9, "historical", "c", None, 1),
        (2, 2, "site", None, 0.0, None), (2, 2, "view", "A", None, None), (2, 1, "site", None, 5.0, None)], key=repr)


class States:
    """State of one key in memory; counts what is read and written."""

    def __init__(self):
        self.maps, self.calls, self.timers = {}, {}, set()

    def getMapState(self, name, *schemas):
        return State(self, name)

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    def __init__(self, states, name):
        self.rows, self.states, self.name = {}, states, name

    def called(self):
        self.states.calls[self.name] = self.states.calls.get(self.name, 0) + 1

    def getValue(self, key):
        self.called()
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.called()
        self.rows[key] = value

    def iterator(self):
        self.called()
        return iter(list(self.rows.items()))

    def clear(self):
        self.called()
        self.rows = {}

    def exists(self):
        self.called()
        return () in self.rows

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


def test_kept_readings_are_read_and_written_once_a_batch(monkeypatch):
    import pandas as pd

    from sitesift.streaming import spots

    monkeypatch.setattr(spots, "CHUNK", 16)
    r = random.Random(8)
    rows = [(i, r.uniform(0, 200), r.uniform(0, 200), r.randrange(30) / 50, f"{r.randrange(30)}", r.choice([0.2, 0.5, 0.9])) for i in range(900)]
    states, kept, found = States(), KeptReadings(40.0), {}
    merge = spots._Merge(40.0, None)
    merge.init(states)
    for start in range(0, 900, 300):
        states.calls.clear()
        batch = pd.DataFrame(rows[start:start + 300], columns=list(NAMES))
        for out in merge.handleInputRows((1,), iter([batch]), None):
            found |= {row[1]: row[2:] for row in out.itertuples(index=False, name=None)}
        for row in rows[start:start + 300]:
            kept.add(dict(zip(NAMES, row)))
        assert [found[i] for i in range(len(found))] == [tuple(e.values()) for e in kept.entries]
        assert states.calls["kept"] <= 2 * (len(found) // 16 + 2)  # before: with every comparison
    ended = [row[1:] for out in merge.handleExpiredTimer((1,), None, None) for row in out.itertuples(index=False, name=None)]
    assert sorted(ended) == [(i, *found[i]) for i in range(len(found))]


def test_items_of_a_project_are_written_once_a_batch():
    """Items that a later row of the batch clears never reach the state: before, each was written, read again and dropped."""
    import pandas as pd

    from sitesift.streaming import sites

    states = States()
    project = sites._Project(1000)
    project.init(states)
    columns = ["revision", "kind", "item", "lat", "lng", "ts"]
    ts = pd.Timestamp("2024-01-01")
    rows = [(i, *[("site", None, float(i // 3 % 2), 1.0), ("historical", f"{i}", None, None), ("view", f"v{i % 2}", None, None)][i % 3], ts)
            for i in range(300)]
    out = []
    for start in (0, 200):
        states.calls.clear()
        for batch in project.handleInputRows((1,), iter([pd.DataFrame(rows[start:start + 200], columns=columns).sample(frac=1, random_state=3)]), states):
            out += batch.itertuples(index=False, name=None)
        assert states.calls.get("items", 0) <= 4 and states.calls.get("views", 0) <= 4
    # Each move, from the second on, clears one item and one view.
    assert sorted((r[2], r[1]) for r in out) == sorted(
        [(i, "site") for i in range(0, 300, 3)] + [(i, kind) for i in range(3, 300, 3) for kind in ("historical", "view")])
    assert {r[3] for r in out if r[1] == "historical"} == {str(i) for i in range(1, 297, 3)} and {r[6] for r in out if r[1] == "historical"} == {1}
