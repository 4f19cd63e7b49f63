"""Survey labels and contour lines of scanned drawings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesift.functions import geometry as G
from sitesift.functions import text as X
from sitesift.operators.numbering import id_block, number_rows
from sitesift.session import durable

# OCR window, merge radius and value tolerance, duplicate radius.
TILE_WIDTH, TILE_HEIGHT = 800, 600
MERGE_RADIUS = 40.0
VALUE_TOLERANCE = 0.011
LINE_RADIUS = 20.0


def ocr_tiles(pages: DataFrame, overlap: int, page_key: str = "page_id") -> DataFrame:
    """Windows of 800 x 600 over each page (width, height); the last ones are clipped."""

    def starts(size: str, tile: int) -> Column:
        step = tile - overlap
        # Steps until a window reaches the far edge.
        last = F.greatest(F.ceil((F.col(size) - tile) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)

    return (
        pages.where((F.col("width") > 0) & (F.col("height") > 0))
        .withColumn("y", F.explode(starts("height", TILE_HEIGHT)))
        .withColumn("x", F.explode(starts("width", TILE_WIDTH)))
        .select(page_key, "x", "y",
                F.least(F.lit(TILE_WIDTH), F.col("width") - F.col("x")).cast("int").alias("w"),
                F.least(F.lit(TILE_HEIGHT), F.col("height") - F.col("y")).cast("int").alias("h"))
    )


def spot_candidates(
    tokens: DataFrame, tiles: DataFrame, low: float = 0.0, high: float = 999.0,
    ocr_scale: float = 1.0,
) -> DataFrame:
    """One row per number in a recognised label, in page pixels.

    ``tokens``: drawing_id, tile_id, pos, text, poly and the detected mark
    (mark_x, mark_y, mark_type, or nulls). ``tiles``: drawing_id, tile_id,
    tile_x, tile_y, proc_scale. Without a mark a lone number sits at the box
    centre; several spread along the top edge.
    """
    numbers = F.posexplode(X.parse_elevations("text"))
    read = tokens.withColumn("_n", F.size(X.parse_elevations("text"))).select(
        "*", numbers.alias("k", "_number"))
    placed = read.join(tiles, ["drawing_id", "tile_id"])
    poly = F.transform("poly", lambda p: G.point(p["x"] / ocr_scale, p["y"] / ocr_scale))
    centre = G.centroid(poly)
    share = (F.col("k") + 0.5) / F.col("_n")
    marked = F.col("mark_x").isNotNull()
    spread = (F.col("_n") > 1) & ~marked

    def at(axis: str) -> Column:
        a, b = poly[0][axis], poly[1][axis]
        return (F.when(spread, a + (b - a) * share).when(marked, F.col(f"mark_{axis}"))
                .otherwise(centre[axis]))

    judged = X.ranged_elevation(F.col("_number.value"), marked, F.col("_n"), low, high)
    return placed.select(
        "drawing_id", "tile_id", "pos", "k",
        ((F.col("tile_x") + at("x")) / F.col("proc_scale")).alias("x"),
        ((F.col("tile_y") + at("y")) / F.col("proc_scale")).alias("y"),
        F.col("_number.raw").alias("raw"), F.col("text").alias("raw_full"),
        judged.alias("_judged"), "mark_type",
    ).select("*", "_judged.*").drop("_judged")


# -- merging repeated readings ----------------------------------------------


def _cells(x: Column, size: float) -> Column:
    return F.floor(x / size)


def _nine(column: str, around: int = 1) -> Column:
    return F.sequence(F.col(column) - around, F.col(column) + around)


def dedupe_spots(spots: DataFrame, radius: float = MERGE_RADIUS, mode: str = "best") -> DataFrame:
    """Merge readings of the same spot: within ``radius`` pixels, and of equal
    text or of values closer than 0.011.

    ``best`` (order-free): a spot goes when a better one (confidence, then
    lower spot_id) matches it. ``greedy``: readings are taken in spot_id order
    and merge into the first kept one they match, which takes over the better
    reading with its place, as when tiles are merged one after another. The
    two differ on chains of readings.
    """
    if mode == "greedy":
        return _dedupe_greedy(spots, radius)
    return _dedupe_best(spots, radius)


#: Side of a tile in radii, and width of a band of values in tolerances; what lies near a side is copied to the neighbour.
TILE, BAND, PAD = 16, 16, 1.001
#: Candidates and readings compared at once, and rows of a table that may be broadcast.
PAIRS, SMALL = 2_000_000, 400_000


def _finite(value: str = "value") -> Column:
    """Only finite values match by value, and only finite places lie near others."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def text_values(spots: DataFrame) -> DataFrame:
    """(drawing_id, raw, n, low, many): how often a text was read, its least value and whether it has others, or none.

    Readings of one text whose values are all equal match by their value wherever they match by their text.
    """
    value = F.when(_finite(), F.col("value"))
    read = spots.groupBy("drawing_id", "raw").agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("_n"), F.min(value).alias("low"), F.max(value).alias("_high"))
    return read.select("drawing_id", "raw", "n", "low",
                       ((F.col("_n") < F.col("n")) | (F.col("low") != F.col("_high"))).alias("many"))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL else table


def _around(of: Column, reach: float, size: float) -> Column:
    return F.sequence(_cells(of - reach, size), _cells(of + reach, size))


def _dedupe_best(spots: DataFrame, radius: float) -> DataFrame:
    """Every reading moves once, to the readings of its tile of the page and its band of values.

    Neighbours get copies of what lies near their sides, so that a reading is judged in one place. Texts with several values (or
    none) meet by tile and text as well, and stay only if both let them.
    """
    columns = spots.columns
    many = durable(text_values(spots).where("many").select(
        F.col("drawing_id").alias("_drawing"), F.col("raw").alias("_text"), F.lit(True).alias("_many")))
    texts = many.count()
    if texts:
        marked = spots.join(_small(many, texts), F.col("drawing_id").eqNullSafe(F.col("_drawing"))
                            & F.col("raw").eqNullSafe(F.col("_text")), "left")
    else:
        marked = spots.withColumn("_many", F.lit(False))
    side, width = TILE * radius, BAND * VALUE_TOLERANCE
    placed = _finite("x") & _finite("y")
    by_value, by_text, alone = F.lit(0), F.lit(1), F.lit(2)
    kind = F.col("_kind")
    # Pages begin at 0, half a tile from a side.
    x, y = F.col("x") + side / 2, F.col("y") + side / 2
    one = F.array(F.lit(0).cast("bigint"))
    tiles = [F.when(kind == alone, one).otherwise(_around(c, PAD * radius, side)) for c in (x, y)]
    homes = F.when(~placed, F.array(alone)).when(~_finite(), F.array(by_text)).when(
        F.coalesce("_many", F.lit(False)), F.array(by_value, by_text)).otherwise(F.array(by_value))
    copies = (
        marked.withColumn("_homes", F.size(homes)).withColumn("_kind", F.explode(homes))
        .withColumn("_band", F.explode(F.when(kind == by_value, _around(F.col("value"), PAD * VALUE_TOLERANCE, width)).otherwise(one)))
        .withColumn("_tx", F.explode(tiles[0])).withColumn("_ty", F.explode(tiles[1]))
        .withColumn("_label", F.when(kind == alone, F.col("spot_id").cast("string")).when(kind == by_text, F.col("raw"))))
    at_home = ((kind == alone) | ((F.col("_tx") == _cells(x, side)) & (F.col("_ty") == _cells(y, side)))) & (
        (kind != by_value) | (F.col("_band") == _cells(F.col("value"), width)))
    group = ["drawing_id", "_kind", "_band", "_tx", "_ty", F.col("_label").isNull(), "_label"]
    # Two digests of 96 bits in all stand for the group; the better of two readings comes first.
    arranged = copies.select(
        *columns, "_homes", "_kind", at_home.alias("_home"), F.xxhash64(*group).alias("_group"), F.hash(*group).alias("_check"),
        (-F.coalesce("confidence", F.lit(0.0))).alias("_worse")
    ).repartition("_group", "_check").sortWithinPartitions("_group", "_check", "_worse", "spot_id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Open | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.select([*columns, "_homes"])
            px, py, value, home, group, check, kind = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "value", "_home", "_group", "_check", "_kind"))
            px, py, home = px.astype(float), py.astype(float), home.astype(bool)
            value = np.where(kind == 0, value.astype(float), 0.0)
            leads = home & _leads(px, py, value, group, check, radius)
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (check[1:] != check[:-1])) + 1
            stay: list[np.ndarray] = []
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                key = (group[start], check[start])
                if last is not None and last.key != key:
                    yield from last.kept(radius)
                    last = None
                lead = start + np.flatnonzero(leads[start:end])
                if last is not None or end == batch.num_rows:  # the group goes on, or may
                    last = last or _Open(key)
                    last.add(px[start:end], py[start:end], value[start:end], lead - start, rows.take(pa.array(lead)))
                else:
                    stay.append(lead[_unbeaten(px[start:end], py[start:end], value[start:end], lead - start, radius)])
            if stay:
                yield rows.take(pa.array(np.concatenate(stay)))
        if last is not None:
            yield from last.kept(radius)

    schema = T.StructType([*spots.schema.fields, T.StructField("_homes", T.IntegerType())])
    kept = arranged.mapInArrow(judge, schema)
    if texts:
        kept = kept.groupBy(*columns, "_homes").agg(F.count(F.lit(1)).alias("_stays")).where("_stays >= _homes")
    return kept.select(*columns)


def _leads(x: np.ndarray, y: np.ndarray, value: np.ndarray, group: np.ndarray, check: np.ndarray, radius: float) -> np.ndarray:
    """The first row of each group in each small square and half of a tolerance; all others there match it."""
    cells = [np.floor(value / (VALUE_TOLERANCE / 2)), *(np.floor(v / (radius / 1.5)) for v in (y, x)), check, group]
    order = np.lexsort(cells)
    first = np.ones(len(x), dtype=bool)
    first[1:] = np.any([c[order][1:] != c[order][:-1] for c in cells], axis=0)
    leads = np.zeros(len(x), dtype=bool)
    leads[order[first]] = True
    return leads


def _unbeaten(x: np.ndarray, y: np.ndarray, value: np.ndarray, lead: np.ndarray, radius: float) -> np.ndarray:
    """Which of the rows ``lead`` of a group match no earlier row of it."""
    stays = np.ones(len(lead), dtype=bool)
    if len(x) == 1 or not len(lead):
        return stays
    order = np.argsort(value, kind="stable")
    values = value[order]
    turn = np.argsort(value[lead], kind="stable")
    bins = np.floor(value[lead][turn] / (VALUE_TOLERANCE / 2))
    for run in np.split(turn, np.flatnonzero(bins[1:] != bins[:-1]) + 1):
        own = value[lead[run]]
        low = np.searchsorted(values, own.min() - PAD * VALUE_TOLERANCE, "left")
        high = np.searchsorted(values, own.max() + PAD * VALUE_TOLERANCE, "right")
        others = order[low:high]
        for part in np.array_split(run, 1 + len(run) * len(others) // PAIRS):
            ours = lead[part][:, None]
            match = (others < ours) & (np.abs(value[others] - value[ours]) < VALUE_TOLERANCE)
            match &= np.hypot(x[others] - x[ours], y[others] - y[ours]) <= radius
            stays[part] = ~match.any(axis=1)
    return stays


class _Open:
    """A group that goes on in the next batch: places and values of its rows, and the whole rows of the leads."""

    def __init__(self, key: tuple):
        self.key, self.size = key, 0
        self.places: list[tuple[np.ndarray, ...]] = []
        self.leads: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, x: np.ndarray, y: np.ndarray, value: np.ndarray, lead: np.ndarray, rows: pa.RecordBatch) -> None:
        self.places.append((x, y, value))
        self.leads.append(lead + self.size)
        self.rows.append(rows)
        self.size += len(x)

    def kept(self, radius: float) -> Iterator[pa.RecordBatch]:
        x, y, value = (np.concatenate(v) for v in zip(*self.places))
        stays = _unbeaten(x, y, value, np.concatenate(self.leads), radius)
        for rows in self.rows:
            yield rows.filter(pa.array(stays[:rows.num_rows]))
            stays = stays[rows.num_rows:]


#: Readings of a group above which its squares of the page are told apart.
CROWD = 200_000


def spot_groups(spots: DataFrame, radius: float = MERGE_RADIUS) -> DataFrame:
    """``spots`` with ``group_id``: readings that may influence one another.

    Runs of neighbouring values of a drawing, linked where a text has several of them (or none), are groups wherever they lie on
    the page: a small table of values and texts tells them. Only groups of more than ``CROWD`` readings are split by place.
    """
    binned = spots.withColumn("_bin", F.when(_finite(), F.floor(F.col("value") / 0.0125)))
    read = durable(binned.groupBy("drawing_id", "raw", "_bin").agg(F.count(F.lit(1)).alias("_n")))
    by_drawing = Window.partitionBy("drawing_id").orderBy("_bin")
    before = F.lag("_bin").over(by_drawing)
    runs = (
        read.where("_bin IS NOT NULL").groupBy("drawing_id", "_bin").agg(F.sum("_n").alias("_n"))
        .withColumn("_first", F.when(before.isNull() | (F.col("_bin") - before > 1), F.col("_bin")))
        .withColumn("_run", F.xxhash64("drawing_id", F.max("_first").over(by_drawing))))
    of_value, of_text = F.xxhash64("drawing_id", "_bin"), F.xxhash64("drawing_id", "raw", F.lit("text"))
    texts = read.groupBy("drawing_id", "raw").agg(
        F.count(F.lit(1)).alias("_bins"), F.bool_or(F.col("_bin").isNull()).alias("_none"), of_text.alias("_text"))
    several = texts.where("_bins > 1 OR _none").select(
        F.col("drawing_id").alias("_drawing"), F.col("raw").alias("_raw"), "_text")
    held = read.join(several, F.col("drawing_id").eqNullSafe(F.col("_drawing")) & F.col("raw").eqNullSafe(F.col("_raw")))
    run_of = runs.select(F.col("drawing_id").alias("_drawing"), F.col("_bin").alias("_value"), "_run")
    across = durable(
        held.drop("_drawing").join(run_of, F.col("drawing_id").eqNullSafe(F.col("_drawing")) & (F.col("_bin") == F.col("_value")))
        .select(F.col("_text").alias("_from"), F.col("_run").alias("_node")).distinct())
    nodes = runs.select(of_value.alias("_node"), F.col("_run").alias("_own"), "_n").unionByName(
        read.where("_bin IS NULL").select(of_text.alias("_node"), of_text.alias("_own"), "_n"))
    if not across.isEmpty():
        labels = _components(across.union(across.select("_node", "_from")), across.select("_from").union(
            across.select("_node")).distinct().toDF("_node"))
        nodes = nodes.join(labels.withColumnRenamed("_node", "_own"), "_own", "left").withColumn(
            "_own", F.coalesce("_label", "_own"))
    sizes = nodes.groupBy("_own").agg((F.sum("_n") > CROWD).alias("_crowded"))
    groups = durable(nodes.join(sizes, "_own").select("_node", F.col("_own").alias("group_id"), "_crowded").distinct())
    grouped = binned.withColumn("_node", F.coalesce(F.when(F.col("_bin").isNotNull(), of_value), of_text)).join(
        _small(groups, groups.count()), "_node").drop("_node", "_bin")
    if groups.where("_crowded").isEmpty():
        return grouped.drop("_crowded")
    crowds = _place_groups(grouped.where("_crowded").select(*spots.columns), radius)
    return grouped.where("NOT _crowded").drop("_crowded").unionByName(crowds)


def _place_groups(spots: DataFrame, radius: float) -> DataFrame:
    """``spots`` with ``group_id``, apart where they lie apart.

    Squares of the page with equal text or neighbouring values are nodes, and
    neighbouring nodes are linked. Node pairs are bounded by the neighbourhood,
    not by the readings in it.
    """
    side = radius
    nodes = spots.select(
        "*", _cells(F.col("x"), side).alias("_cx"), _cells(F.col("y"), side).alias("_cy"),
        F.when(_finite(), F.floor(F.col("value") / 0.0125)).alias("_bin"))
    key = F.xxhash64("drawing_id", "_cx", "_cy", "_bin", "raw")
    nodes = nodes.withColumn("_node", key)
    distinct = durable(nodes.select(
        "drawing_id", "_cx", "_cy", "_bin", "raw", "_node").distinct())
    around = distinct.withColumn("_cx", F.explode(_nine("_cx"))).withColumn(
        "_cy", F.explode(_nine("_cy"))).withColumnRenamed("_node", "_from")
    # A missing text equals a missing text, as in the fold.
    by_text = around.drop("_bin").withColumn("raw", F.struct("raw")).join(
        distinct.withColumn("raw", F.struct("raw")), ["drawing_id", "_cx", "_cy", "raw"])
    by_value = around.drop("raw").where("_bin IS NOT NULL").withColumn(
        "_bin", F.explode(_nine("_bin"))).join(distinct, ["drawing_id", "_cx", "_cy", "_bin"])
    links = durable(
        by_text.select("_from", "_node").union(by_value.select("_from", "_node"))
        .where("_from <> _node").distinct())
    labels = _components(links, distinct.select("_node").distinct())
    return nodes.join(labels, "_node").withColumnRenamed("_label", "group_id").drop(
        "_cx", "_cy", "_bin", "_node")


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(_node, _label) of the parts that ``links`` (_from, _node; both ways) make of ``nodes``.

    The least label spreads with pointer jumping; every round is cut by a checkpoint.
    """
    labels = durable(nodes.select("_node", F.col("_node").alias("_label")))
    while True:
        # Both steps only lower labels, so the loop ends with each component's least.
        offered = links.join(labels, "_node").groupBy(F.col("_from").alias("_node")).agg(
            F.min("_label").alias("_offer"))
        lowered = labels.join(offered, "_node", "left").select(
            "_node", F.col("_label").alias("_old"),
            F.least("_label", F.coalesce("_offer", "_label")).alias("_label"))
        lowered = durable(lowered)
        jump = lowered.select(F.col("_node").alias("_label"), F.col("_label").alias("_root"))
        jumped = durable(lowered.join(jump, "_label", "left").select(
            "_node", "_old", F.least("_label", F.coalesce("_root", "_label")).alias("_label")))
        changed = jumped.where("_label <> _old").limit(1).count()
        labels = jumped.select("_node", "_label")
        if not changed:
            return labels


def sure(confidence) -> float:
    """Confidence with a missing one (None, or NaN as Arrow batches have it) as 0."""
    return 0.0 if confidence is None or confidence != confidence else confidence


def missing(text) -> bool:
    return text is None or text != text


def same_spot(kept: dict, reading: dict, radius: float) -> bool:
    """Whether a reading merges into a kept one."""
    dx, dy = kept["x"] - reading["x"], kept["y"] - reading["y"]
    # The sides alone tell most of those that lie apart.
    if abs(dx) > radius or abs(dy) > radius or not np.hypot(dx, dy) <= radius:
        return False
    a, b = kept["value"], reading["value"]
    finite = a is not None and b is not None and np.isfinite(a) and np.isfinite(b)
    same_text = kept["raw"] == reading["raw"] or (missing(kept["raw"]) and missing(reading["raw"]))
    return bool(finite and abs(a - b) < VALUE_TOLERANCE) or same_text


class KeptReadings:
    """Kept readings in order of arrival, looked up by page square."""

    def __init__(self, radius: float):
        self.radius = radius
        self.entries: list[dict] = []
        self.squares: dict[tuple[int, int], list[int]] = {}

    def _square(self, reading: dict) -> tuple[int, int]:
        return int(reading["x"] // self.radius), int(reading["y"] // self.radius)

    def add(self, reading: dict) -> None:
        if not (np.isfinite(reading["x"]) and np.isfinite(reading["y"])):  # near nothing
            self.entries.append(reading)
            return
        cx, cy = self._square(reading)
        near = sorted(
            i for dx in (-1, 0, 1) for dy in (-1, 0, 1)
            for i in self.squares.get((cx + dx, cy + dy), ()))
        for i in near:
            entry = self.entries[i]
            if same_spot(entry, reading, self.radius):
                if sure(reading["confidence"]) > sure(entry["confidence"]):
                    self.squares[self._square(entry)].remove(i)
                    self.squares.setdefault((cx, cy), []).append(i)
                    self.entries[i] = reading
                return
        self.squares.setdefault((cx, cy), []).append(len(self.entries))
        self.entries.append(reading)


def _dedupe_greedy(spots: DataFrame, radius: float) -> DataFrame:
    """Sequential folds, one per influence group, never per drawing.

    Rows arrive sorted by group and are folded as they stream by, so a task
    holds the kept readings of one group and not the group.
    """
    columns = spots.columns
    order = ["drawing_id", "group_id", "spot_id"]
    arranged = spot_groups(spots, radius).repartition(
        "drawing_id", "group_id").sortWithinPartitions(*order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, KeptReadings(radius)
        for batch in batches:
            done: list[dict] = []
            for reading in batch.to_dict("records"):
                group = (reading["drawing_id"], reading.pop("group_id"))
                if group != current:
                    done += kept.entries
                    current, kept = group, KeptReadings(radius)
                kept.add(reading)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(kept.entries, columns=columns)

    return arranged.select(*columns, "group_id").mapInPandas(fold, spots.schema)


def number_points(
    spots: DataFrame, start: int | str | Column = 1, drawing: str = "drawing_id",
    order: str = "spot_id",
) -> DataFrame:
    """Point numbers of a drawing in spot order, from ``start`` (positive, else 1)."""
    first = G.col(start).cast("double")
    first = F.when(first >= 1, first.cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    numbered = number_rows(spots, [drawing], [id_block(order)], [F.col(order)], "_pos")
    return numbered.withColumn("number", first + F.col("_pos") - 1).drop("_pos")


# -- contours ---------------------------------------------------------------


def _first_hit(points: str | Column) -> Column:
    """Least share of the cut at which the line crosses it; null without a crossing."""
    hits = F.transform(G.path_edges(points), lambda e: G.crossing_position(
        F.col("cut_x1"), F.col("cut_y1"), F.col("cut_x2"), F.col("cut_y2"),
        e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.array_min(F.filter(hits, lambda t: t.isNotNull()))


def cut_line_hits(contours: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cut_id, drawing_id, contour_id, t) of the CONTOUR* lines a cut crosses.

    ``cuts``: cut_id, drawing_id, cut_x1, cut_y1, cut_x2, cut_y2. The line is
    walked inside its row: the only data movement is the join on the drawing.
    """
    lines = contours.where(F.startswith("layer", F.lit("CONTOUR")) & (F.size("points") >= 2))
    return (
        lines.join(cuts, "drawing_id").withColumn("t", _first_hit("points"))
        .where(F.col("t").isNotNull()).select("cut_id", "drawing_id", "contour_id", "t")
    )


def label_contours(
    contours: DataFrame, cuts: DataFrame, start: Column | float, interval: Column | float
) -> DataFrame:
    """Elevations along one cut per drawing: start + n * interval in crossing order.

    Lines that are not crossed, and other layers, keep their elevation. Numbers
    come from ranges of the crossing position, so that one drawing may hold any
    number of lines. A drawing with several cuts is labelled along the least of them.
    """
    columns = contours.columns
    others = [c for c in cuts.columns if c != "drawing_id"]
    cuts = cuts.groupBy("drawing_id").agg(F.min(F.struct(*others)).alias("_cut")).select(
        "drawing_id", "_cut.*")
    labelled = F.startswith("layer", F.lit("CONTOUR")) & (F.size("points") >= 2)
    placed = contours.join(cuts, "drawing_id", "left").withColumn(
        "t", F.when(labelled, _first_hit("points")))
    placed = placed.withColumn("_start", G.col(start).cast("double")).withColumn(
        "_step", G.col(interval).cast("double"))
    crossed = number_rows(
        placed.where(F.col("t").isNotNull()), ["drawing_id"],
        None, [F.col("t"), F.col("contour_id")], "_n")
    high = crossed.withColumn(
        "elevation", F.col("_start") + (F.col("_n") - 1) * F.col("_step")).select(*columns)
    return high.unionByName(placed.where(F.col("t").isNull()).select(*columns))


def near_duplicate_lines(
    new: DataFrame, existing: DataFrame, radius: float = LINE_RADIUS
) -> DataFrame:
    """``new`` without lines whose vertex mean lies closer than ``radius`` to that
    of an existing CONTOUR* line or of a new line with a lower contour_id.

    Inside a square of diagonal below the radius only the lowest id can stay,
    so the candidates are few wherever the lines crowd.
    """

    def centres(lines: DataFrame, order: Column) -> DataFrame:
        return lines.where(F.size("points") > 0).select(
            "drawing_id", order.alias("_order"), G.centroid("points").alias("_c")).select(
            "drawing_id", "_order", F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"))

    fresh = centres(new, F.col("contour_id"))
    old = centres(
        existing.where(F.startswith("layer", F.lit("CONTOUR"))), F.lit(-1).cast("bigint"))
    fine = radius / 1.5
    lowest = fresh.groupBy(
        "drawing_id", _cells(F.col("_x"), fine).alias("_sx"), _cells(F.col("_y"), fine).alias("_sy")
    ).agg(F.min(F.struct("_order", "_x", "_y")).alias("_l"))
    probe = lowest.select(
        "drawing_id", F.col("_l._order").alias("contour_id"), F.col("_l._x").alias("_px"),
        F.col("_l._y").alias("_py"))
    spread = (
        probe.withColumn("_cx", _cells(F.col("_px"), radius))
        .withColumn("_cy", _cells(F.col("_py"), radius))
        .withColumn("_cx", F.explode(_nine("_cx"))).withColumn("_cy", F.explode(_nine("_cy"))))
    others = fresh.unionByName(old).withColumn("_cx", _cells(F.col("_x"), radius)).withColumn(
        "_cy", _cells(F.col("_y"), radius)).groupBy("drawing_id", "_cx", "_cy", "_x", "_y").agg(
        F.min("_order").alias("_order"))
    gone = (
        spread.join(others, ["drawing_id", "_cx", "_cy"])
        .where((F.col("_order") < F.col("contour_id"))
               & (F.hypot(F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py")) < radius))
        .select("drawing_id", "contour_id").distinct())
    # All others of a square lie closer than the radius to its lowest line.
    covered = fresh.withColumn("_sx", _cells(F.col("_x"), fine)).withColumn(
        "_sy", _cells(F.col("_y"), fine)).join(
        lowest.select("drawing_id", "_sx", "_sy", F.col("_l._order").alias("_first")),
        ["drawing_id", "_sx", "_sy"]).where("_order <> _first").select(
        "drawing_id", F.col("_order").alias("contour_id"))
    # Lines without points or without a drawing have no near one and stay.
    return new.join(gone.union(covered).distinct(), ["drawing_id", "contour_id"], "left_anti")


def _simplified(xs: np.ndarray, ys: np.ndarray, eps: float) -> np.ndarray:
    """Mask of the vertices that Douglas-Peucker keeps."""
    keep = np.zeros(len(xs), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(xs) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py = xs[a + 1:b] - xs[a], ys[a + 1:b] - ys[a]
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        length = np.hypot(dx, dy)
        away = np.hypot(px, py) if length == 0 else np.abs(px * dy - py * dx) / length
        far = int(away.argmax())
        if away[far] > eps:
            middle = a + 1 + far
            keep[middle] = True
            stack += [(a, middle), (middle, b)]
    return keep


def simplify_line(lines: DataFrame, eps: float = 1.25, points: str = "points") -> DataFrame:
    """Douglas-Peucker on every line; each line is a row, rows come in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shorter = []
            for path in batch[points]:
                if path is None or len(path) < 3:
                    shorter.append(path)
                    continue
                xs = np.array([p["x"] for p in path], dtype=float)
                ys = np.array([p["y"] for p in path], dtype=float)
                mask = _simplified(xs, ys, eps)
                shorter.append([{"x": x, "y": y} for x, y in zip(xs[mask], ys[mask])])
            batch[points] = shorter
            yield batch

    return lines.mapInPandas(run, lines.schema)
