"""Cases that only larger tables show."""

import math
import os
import random

import duckdb
import pytest

from check import table
from sitesift.operators import rings, surveys
from sitesift.plans.bindings import TABLES
from sitesift.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def compare(spark, folder, query, **changed):
    """Query and SQL on the smallest tables, some of them replaced by the SELECT given (over ``t``)."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        source, target = f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet"
        if name in changed:
            db.execute(f"COPY (WITH t AS (SELECT * FROM '{source}') {changed[name]}) TO '{target}' (FORMAT parquet)")
        else:
            os.symlink(source, target)
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{target}'")
    df = QUERIES[query](spark, str(folder))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLES[query])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[1]


def test_linked_text_files_outside_the_cache_are_not_followed(spark, tmp_path):
    compare(spark, tmp_path, "linked_documents", supplier="SELECT t.* REPLACE (i AS s_suppkey) FROM range(800) r(i), (SELECT * FROM t LIMIT 1) t")


def test_sheets_that_end_on_a_tile_border(spark, tmp_path):
    compare(spark, tmp_path, "tile_requests", customer="SELECT t.* REPLACE (i AS c_custkey) FROM range(18000) r(i), (SELECT * FROM t LIMIT 1) t WHERE i % 7 < 3")


def test_short_rings_need_no_exchange_and_agree_with_cells(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(60):
        ring = [(-80 + r.randint(0, 6) / 8, 43 + r.randint(0, 6) / 8) for _ in range(r.randint(1, 9))]
        rows.append((i, ring + ring[:1]))
    rows += [(90, None), (91, [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, f"ring_id INT, ring {RING}")
    for tolerant in (True, False):
        want = sorted(map(tuple, rings.self_intersections(rings.ring_segments(df), tolerant=tolerant).collect()))
        assert want
        assert sorted(map(tuple, rings.crossings(df, tolerant=tolerant).collect())) == want
    whole = {x.ring_id: x.violations for x in rings.validate_rings(df).collect()}
    projected = {x.ring_id: x.violations for x in rings.validate_projected_rings(df).collect()}
    monkeypatch.setattr(rings, "ROW_EDGES", 4)  # some rings by cells, some in their rows
    assert {x.ring_id: x.violations for x in rings.validate_rings(df).collect()} == whole
    assert {x.ring_id: x.violations for x in rings.validate_projected_rings(df).collect()} == projected


@pytest.mark.parametrize("name", ["self_intersections", "validate_rings", "validate_projected_rings"])
def test_edges_of_rings_are_never_broadcast(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_restored_projects_meet_no_join(spark):
    # Joined by id, whole texts went through the driver as a broadcast.
    plan = QUERIES["restore_projects"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_equal_places_and_equal_polygons_share_their_work(spark):
    """Ten thousand sites of one place and thousands of equal polygons: pairs would be 4e7 before the first aggregate."""
    from pyspark.sql import functions as F

    from sitesift.functions import geometry as G
    from sitesift.operators import sites

    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))])
    table = spark.range(1, 4001).select(F.col("id").alias("feature_seq"), F.lit("z").alias("name"), F.concat(F.lit("u"), F.col("id") % 2).alias("unit_code"),
                                        ring.alias("polygon"), G.no_holes().alias("holes"))
    places = spark.range(10000).select(F.col("id").alias("site_id"), F.lit(1.0).alias("lng"), F.lit(1.0).alias("lat"))
    views = spark.range(10000).select(F.col("id").alias("view_id"), G.bounds(0.0, 0.0, 1.0, 1.0).alias("bounds"))
    shapes, members = sites.equal_shapes(sites.with_box(table, True))
    assert shapes.count() == 1 and members.where("_shape = 1").count() == 4000
    assert {(x.feature_seq, x.unit_code, x.n) for x in sites.site_unit(places, table).groupBy("feature_seq", "unit_code").agg(
        F.count("*").alias("n")).collect()} == {(1, "u1", 10000)}
    assert {(x.unit_key, x.feature_seq, x.n) for x in sites.visible_units(views, table).groupBy("unit_key", "feature_seq").agg(
        F.count("*").alias("n")).collect()} == {("u0", 4000, 10000), ("u1", 3999, 10000)}
    assert {(x.unit_key, x.area, x.features, x.n) for x in sites.unit_coverage(views, table).groupBy("unit_key", "area", "features").agg(
        F.count("*").alias("n")).collect()} == {("u0", 8000.0, 2000, 10000), ("u1", 8000.0, 2000, 10000), (None, 16000.0, 4000, 10000)}
    assert sites.site_hits_by_edges(places, table).count() == sites.visible_features(views, table).count() == 40_000_000


def test_best_imagery_equals_the_ranking_of_all_pairs(spark):
    from sitesift.operators import catalog
    from sitesift.plans.bindings import Source
    from sitesift.plans.catalog_queries import PROVIDERS, matches

    s = Source(spark, SMALL)
    columns = ["site_id", "id", "bucket", "top_pos"]
    want = catalog.top_imagery(catalog.rank_imagery_years(matches(s)), 3).select(columns)
    got = catalog.best_imagery(s.view("b_sites"), s.view("b_catalog"), s.sql(PROVIDERS), 3).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_places_are_numbered_once_for_all_their_sites(spark):
    from pyspark.sql import functions as F

    from sitesift.operators import catalog
    from sitesift.plans.bindings import Source
    from sitesift.plans.catalog_queries import PROVIDERS, matches

    s = Source(spark, SMALL)
    columns = ["site_id", "year", "id", "pos"]
    places = s.view("b_sites").withColumn("site_id", F.explode(F.array(F.col("site_id"), F.col("site_id") + 1000000)))
    got = {tuple(r) for r in catalog.site_rank_within_year(places, s.view("b_catalog"), s.sql(PROVIDERS)).select(columns).collect()}
    want = {tuple(r) for r in catalog.rank_within_year(matches(s)).select(columns).collect()}
    assert got == want | {(a + 1000000, *rest) for a, *rest in want} != set()


SPOT = "drawing_id INT, spot_id BIGINT, x DOUBLE, y DOUBLE, value DOUBLE, raw STRING, confidence DOUBLE"


def test_merged_readings_move_once(spark):
    """No pairs of readings are joined: before, every candidate was copied to 9 squares and 27 bins of values."""
    plan = QUERIES["dedupe_spots"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("batch", [7, 10_000])
def test_best_readings_over_tiles_bands_and_batches(spark, batch):
    r = random.Random(batch)
    # Around sides of tiles (320, 960) and of bands, crowded and sparse, texts with one value and with several.
    rows = []
    for i in range(900):
        x, y = (r.choice([r.uniform(-400, 1000), r.gauss(320, 40)]) for _ in "xy")
        value = round(r.choice([10.0, 11.0, 12.0]) + r.randint(0, 60) / 100, 2)
        rows.append((r.choice([1, 2]), i, x, y, value, r.choice([f"{value:.2f}"] * 9 + ["12.5"]), r.choice([0.95, 0.58, None])))
    rows += [(3, i, None, 5.0, 1.0, "1.00", 0.5) for i in range(3)] + [(3, 9, float("inf"), 5.0, 1.0, "1.00", 0.5)]
    alike = lambda p, q: None not in (p[2], q[2]) and math.hypot(p[2] - q[2], p[3] - q[3]) <= 40 and (
        abs(p[4] - q[4]) < 0.011 or p[5] == q[5])
    want = {p[:2] for p in rows if not any(
        q[0] == p[0] and alike(p, q) and (-(q[6] or 0), q[1]) < (-(p[6] or 0), p[1]) for q in rows)}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        found = surveys.dedupe_spots(spark.createDataFrame(rows, SPOT)).collect()
    finally:
        spark.conf.set(key, before)
    assert len(found) == len(want) and {(f.drawing_id, f.spot_id) for f in found} == want


@pytest.mark.parametrize("crowd", [None, 20])
def test_sequential_merge_by_runs_of_values(spark, monkeypatch, crowd):
    """Squares of the page are laid out for crowded groups only; readings without a place merge with nothing."""
    laid = []
    place_groups = surveys._place_groups
    monkeypatch.setattr(surveys, "_place_groups", lambda *a: laid.append(1) or place_groups(*a))
    if crowd:
        monkeypatch.setattr(surveys, "CROWD", crowd)
    r = random.Random(11)
    rows = []
    for i in range(600):
        value = round(r.choice([10.0, 11.0, 12.0]) + r.randint(0, 30) / 100, 2)
        text = r.choice([f"{value:.2f}"] * 9 + [None, "12.5"])
        rows.append((r.choice([1, 2]), i, r.uniform(-200, 500), r.uniform(0, 500), value if r.random() < 0.9 else None, text, r.choice([0.95, 0.58, 0.1])))
    rows += [(3, i, float("nan"), 5.0, 1.0, "1.00", 0.5) for i in range(3)]
    kept = {}
    for p in rows:
        mine = kept.setdefault(p[0], [])
        for i, q in enumerate(mine):
            close = None not in (p[4], q[4]) and abs(p[4] - q[4]) < 0.011
            if math.hypot(p[2] - q[2], p[3] - q[3]) <= 40 and (close or p[5] == q[5]):
                if p[6] > q[6]:
                    mine[i] = p
                break
        else:
            mine.append(p)
    found = surveys.dedupe_spots(spark.createDataFrame(rows, SPOT), mode="greedy").collect()
    assert sorted((f.drawing_id, f.spot_id) for f in found) == sorted(p[:2] for group in kept.values() for p in group)
    assert bool(laid) == bool(crowd)


def test_walks_are_cut_every_few_levels(spark, monkeypatch):
    """A long chain beside cycles, shared documents and two roots, against a walk by hand; before, each level was cut twice."""
    from sitesift.operators import links

    cuts = []
    durable = links.durable
    monkeypatch.setattr(links, "durable", lambda df: cuts.append(1) or durable(df))
    monkeypatch.setattr(links, "PIECES", 2, raising=False)
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 117)] + [(r.randrange(40), r.randrange(40)) for _ in range(70)] + [(3, 100), (117, 100), (5, 5)]
    table = spark.createDataFrame([(*p, None) for p in pairs], "parent INT, doc INT, region STRING")
    roots = spark.createDataFrame([(1, 3), (2, 110), (3, 7), (3, 8)], "root_id INT, doc INT")
    want = set()
    for root, starts in ((1, [3]), (2, [110]), (3, [7, 8])):
        depth = dict.fromkeys(starts, 0)
        queue = list(starts)
        for doc in queue:
            for parent, child in pairs:
                if parent == doc and child not in depth:
                    depth[child] = depth[doc] + 1
                    queue.append(child)
        want |= {(root, doc, d) for doc, d in depth.items()}
    got = [(x.root_id, x.doc, x.depth) for x in links.reachable_documents(table, roots).collect()]
    assert sorted(got) == sorted(want) and max(w[2] for w in want) >= 17
    assert len(cuts) <= 10


def test_years_are_ranked_once_for_all_sites_of_a_place(spark):
    """Sites and records meet last, by place, and nothing is exchanged after it; ranks equal those over all pairs."""
    from sitesift.operators import catalog
    from sitesift.plans.bindings import Source
    from sitesift.plans.catalog_queries import PROVIDERS, matches

    df = QUERIES["rank_imagery_years"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "_place" in first and "Exchange" not in plan[:plan.index(first)]
    s = Source(spark, SMALL)
    sites = s.view("b_sites")
    twice = sites.union(sites.selectExpr("site_id + 1000000", "lng", "lat", "requested_year + 1"))
    columns = ["site_id", "id", "year", "year_rank", "bucket"]
    want = catalog.rank_imagery_years(catalog.imagery_for_site(twice, s.view("b_catalog"), s.sql(PROVIDERS))).select(columns)
    got = catalog.site_rank_imagery_years(twice, s.view("b_catalog"), s.sql(PROVIDERS)).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and matches(s).count() < got.count()


@pytest.mark.parametrize("name", ["export_requests", "tile_requests"])
def test_sheets_are_dealt_before_their_requests_are_made(spark, name):
    """Before, the one task that read the file of sheets made all requests."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(sheet_id" in plan[plan.index("Generate"):]


@pytest.mark.parametrize("name", ["imagery_for_site", "rank_within_year"])
def test_a_hash_goes_before_structs_that_are_keys(spark, name):
    """Sorts of places and extents compare numbers first; before, they compared structs of doubles for every pair of rows."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_span" in plan and "Sort [_spot" in plan and ("Sort [_group" in plan) == (name == "rank_within_year")


def test_ranks_are_found_by_the_number_of_a_year(spark):
    """Places of different years, years far apart, -0.0 as a coordinate, a site without a year; before, each pair searched a map."""
    from sitesift.operators import catalog

    box = "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE"
    providers = spark.createDataFrame([("a", -180.0, -90.0, 180.0, 90.0)], f"provider_id STRING, {box}")
    at = {0.0: [1950, 1951, 1953, -7, 2000000000], 50.0: [1952, 1953, None], 80.0: [1990]}
    records = spark.createDataFrame(
        [(f"{x}-{i}", "a", y, x - 1, -1.0, x + 1, 1.0) for x, years in at.items() for i, y in enumerate(years + years[:1])],
        f"id STRING, provider_id STRING, year INT, {box}")
    sites = spark.createDataFrame(
        [(1, 0.0, 0.0, 1951), (2, -0.0, 0.0, 1952), (3, 50.0, 0.5, 1952), (4, 50.0, 0.5, None), (5, 120.0, 0.0, 1950),
         (6, 80.0, None, 1990), (6, 80.0, 0.0, 1800), (6, 80.0, 0.0, 1800)], "site_id INT, lng DOUBLE, lat DOUBLE, requested_year INT")
    columns = ["site_id", "id", "year", "year_rank", "bucket"]
    df = catalog.site_rank_imagery_years(sites, records, providers).select(columns)
    assert "map_from_entries" not in df._jdf.queryExecution().executedPlan().toString()
    want, wanted = [], {1: 1951, 2: 1952, 3: 1952, 4: None, 6: 1800}
    for site, x in ((1, 0.0), (2, 0.0), (3, 50.0), (4, 50.0), (6, 80.0), (6, 80.0)):
        years, ask = at[x], wanted[site]
        others = sorted({y for y in years if y is not None and y != ask}, key=lambda y: (abs(y - ask) if ask else 0, y))
        for i, y in enumerate(years + years[:1]):
            if y is not None:
                rank = 0 if y == ask else others.index(y) + 1
                want.append((site, f"{x}-{i}", y, rank, "exact" if rank == 0 else "nearby" if rank <= 3 else "remaining"))
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("values", [1, 2, 1 << 62])
def test_features_find_their_shape_by_a_hash(spark, monkeypatch, values):
    """Outlines are exchanged for shapes only, and compared only where shapes share a hash; before, every feature's went along."""
    from pyspark.sql import functions as F

    from sitesift.functions import geometry as G
    from sitesift.operators import sites

    whole = sites._shape_hash
    monkeypatch.setattr(sites, "_shape_hash", lambda *keys: F.pmod(whole(*keys), F.lit(values)))
    side = F.col("id") % 5 + 1.0
    zero = F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0))
    ring = F.array(*[G.point(x, y) for x, y in ((zero, zero), (side, zero), (side, side), (zero, side), (zero, zero))])
    table = spark.range(1, 101).select(F.col("id").alias("feature_seq"), ring.alias("polygon"), G.no_holes().alias("holes"),
                                       F.when(F.col("id") > 5, F.col("id") % 3).alias("kind"))
    boxed = sites.with_box(table, True)
    shapes, members = sites.equal_shapes(boxed)
    assert {r.feature_seq for r in shapes.collect()} == {1, 2, 3, 4, 5}
    assert sorted((r.feature_seq, r._shape) for r in members.collect()) == [(i, (i - 1) % 5 + 1) for i in range(1, 101)]
    shapes, members = sites.equal_shapes(boxed, ["kind"])
    least = {}
    for i in range(6, 101):
        least.setdefault((i % 5, i % 3), i)
    assert sorted((r.feature_seq, r._shape) for r in members.collect()) == [(i, least[i % 5, i % 3]) for i in range(6, 101)]
    assert members.columns == [*boxed.columns, "_shape"]
