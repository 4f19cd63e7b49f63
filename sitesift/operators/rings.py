"""Ring checks over a table of rings (ring_id, ring)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.functions import geometry as G
from sitesift.operators import grid

MIN_POINTS, MAX_POINTS = 4, 5000


def ring_segments(rings: DataFrame, ring_id: str = "ring_id", ring: str = "ring") -> DataFrame:
    """ring_id, n, edge_no (from 1), x1, y1, x2, y2 of the consecutive vertices."""
    return rings.select(
        ring_id, (F.size(ring) - 1).alias("n"),
        F.posexplode(G.path_edges(ring)).alias("_i", "_e"),
    ).select(
        ring_id, "n", (F.col("_i") + 1).alias("edge_no"),
        F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"),
        F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"))


def self_intersections(
    edges: DataFrame, keys: Sequence[str] = ("ring_id",), tolerant: bool = True,
) -> DataFrame:
    """(keys, i, j): edges of one ring that touch or cross without being neighbours.

    ``tolerant``: an end within 1e-10 of an edge touches it; else the form of rings to be projected (``segments_meet``).
    Edges meet in a box join on their own scale, so a ring of thousands of
    edges is not compared all against all and a huge ring is spread over cells.
    """
    keys = list(keys)

    def side(prefix: str) -> DataFrame:
        return edges.select(
            *keys, F.col("edge_no").alias(f"{prefix}no"),
            *([F.col("n").alias(f"{prefix}n")]),
            *[F.col(c).alias(prefix + c) for c in ("x1", "y1", "x2", "y2")],
            F.least("x1", "x2").alias(f"{prefix}w"), F.least("y1", "y2").alias(f"{prefix}s"),
            F.greatest("x1", "x2").alias(f"{prefix}e"), F.greatest("y1", "y2").alias(f"{prefix}t"))

    # Touching is tolerant by 1e-10; widen one side's boxes by as much.
    left = side("l").withColumn("lw", F.col("lw") - 1e-9).withColumn(
        "ls", F.col("ls") - 1e-9).withColumn("le", F.col("le") + 1e-9).withColumn(
        "lt", F.col("lt") + 1e-9)
    right = side("r")
    apart = (F.col("lno") + 1 < F.col("rno")) & ~(
        (F.col("lno") == 1) & (F.col("rno") == F.col("ln")))
    near = grid.box_pairs(
        left, right, ("lw", "ls", "le", "lt"), ("rw", "rs", "re", "rt"), keys, condition=apart)
    crossing = (G.segments_cross if tolerant else G.segments_meet)("lx1", "ly1", "lx2", "ly2", "rx1", "ry1", "rx2", "ry2")
    return near.where(crossing).select(*keys, F.col("lno").alias("i"), F.col("rno").alias("j"))


# Up to this many edges, a ring is checked inside its row; its pairs are then fewer than the cells it would be spread over.
ROW_EDGES = 64


def crossings(rings: DataFrame, ring_id: str = "ring_id", ring: str = "ring", tolerant: bool = True) -> DataFrame:
    """(ring_id, i, j) as of ``self_intersections``: rings of few edges inside their rows, without any exchange, longer ones by cells."""
    rings = rings.repartition(ring_id)  # a small file of many rings is one task otherwise
    short = F.coalesce(F.size(ring), F.lit(0)) <= ROW_EDGES + 1
    inside = rings.where(short).select(ring_id, F.explode(
        G.ring_crossings(ring, G.segments_cross if tolerant else G.segments_meet)).alias("_p")).select(ring_id, "_p.i", "_p.j")
    return inside.union(self_intersections(ring_segments(rings.where(~short), ring_id, ring), (ring_id,), tolerant))


def _with_crossed(rings: DataFrame, ring_id: str, ring: str, tolerant: bool) -> DataFrame:
    """``rings`` with ``_crossed``; only rings of many edges meet a join."""
    rings = rings.repartition(ring_id)
    short = F.coalesce(F.size(ring), F.lit(0)) <= ROW_EDGES + 1
    found = F.size(G.ring_crossings(ring, G.segments_cross if tolerant else G.segments_meet)) > 0
    long = rings.where(~short)
    crossed = self_intersections(ring_segments(long, ring_id, ring), (ring_id,), tolerant).select(ring_id).distinct().withColumn(
        "_crossed", F.lit(True))
    return rings.where(short).withColumn("_crossed", found).unionByName(long.join(crossed.hint("merge"), ring_id, "left"))


def validate_rings(rings: DataFrame, ring_id: str = "ring_id", ring: str = "ring") -> DataFrame:
    """``rings`` with a ``violations`` array: every broken rule, none for a valid ring."""
    r = F.col(ring)
    n = F.size(r)
    first, last = F.element_at(r, 1), F.element_at(r, -1)
    open_part = F.slice(r, 1, F.greatest(n - 1, F.lit(0)))
    bad_vertex = F.exists(r, lambda p: ~G.valid_location(p["y"], p["x"]))
    rules = [
        (~n.between(MIN_POINTS, MAX_POINTS), "point-count"),
        (bad_vertex, "coordinates"),
        ((first["x"] != last["x"]) | (first["y"] != last["y"]), "not-closed"),
        (G.distinct_vertices(open_part) != F.size(open_part), "repeated-vertex"),
        (F.abs(G.ring_area(r) * 2) < G.ZERO_AREA, "zero-area"),
        (F.col("_crossed"), "self-intersection"),
    ]
    found = F.filter(
        F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]), lambda v: v.isNotNull())
    return _with_crossed(rings, ring_id, ring, True).withColumn("violations", found).drop("_crossed")


# The area that the supported zones cover.
WEST_LIMIT, EAST_LIMIT, NORTH_LIMIT = -96.0, -72.0, 84.0


def validate_projected_rings(rings: DataFrame, ring_id: str = "ring_id", ring: str = "ring") -> DataFrame:
    """``rings`` with a ``violations`` array by the rules of rings that are to be projected.

    Other than ``validate_rings`` it wants the supported zones, and calls a ring flat by its size (``ring_is_flat``). Linear in the
    vertices but for the edges, which meet in a box join. A null ring breaks ``point-count``.
    """
    r = F.coalesce(F.col(ring), F.array().cast("array<struct<x:double,y:double>>"))
    n = F.size(r)
    first, last = F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(-1))
    open_part = F.slice(r, 1, F.greatest(n - 1, F.lit(0)))
    inside = lambda p: F.coalesce((p["x"] > WEST_LIMIT) & (p["x"] < EAST_LIMIT) & p["y"].between(0, NORTH_LIMIT), F.lit(False))
    rules = [
        (~n.between(MIN_POINTS, MAX_POINTS), "point-count"),
        (F.exists(r, lambda p: ~inside(p)), "coordinates"),
        ((n > 0) & ((first["x"] != last["x"]) | (first["y"] != last["y"])), "not-closed"),
        (G.distinct_vertices(open_part) != F.size(open_part), "repeated-vertex"),
        ((n >= MIN_POINTS) & G.ring_is_flat(r), "flat"),
        (F.col("_crossed"), "self-intersection"),
    ]
    found = F.filter(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]), lambda v: v.isNotNull())
    return _with_crossed(rings, ring_id, ring, False).withColumn("violations", found).drop("_crossed")
