"""Geometry as Column expressions over ARRAY<STRUCT<x, y>> rings.

Everything here is planned and run by the JVM; nothing calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the boundary tests, in coordinate units.
EDGE_TOLERANCE = 1e-10
CONVEX_SLACK = 1e-6
PARALLEL_LIMIT = 1e-9
ZERO_AREA = 1e-14


def col(value) -> Column:
    """Column of a name, a number or a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once.

    A Column is a tree: a value used many times is otherwise repeated in the
    plan, and nesting multiplies the repeats.
    """
    return F.transform(F.array(value), fn)[0]


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def bounds(west, south, east, north) -> Column:
    return F.struct(
        col(west).cast("double").alias("west"),
        col(south).cast("double").alias("south"),
        col(east).cast("double").alias("east"),
        col(north).cast("double").alias("north"),
    )


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


# -- validity ---------------------------------------------------------------


def valid_location(lat, lng) -> Column:
    """Both present, finite and in geographic range (NaN sorts above 180)."""
    return _known((F.abs(col(lat)) <= 90) & (F.abs(col(lng)) <= 180))


def _contains_point(b: Column, lat, lng) -> Column:
    return (
        (col(lat) >= b["south"]) & (col(lat) <= b["north"])
        & (col(lng) >= b["west"]) & (col(lng) <= b["east"])
    )


def valid_bounds(b, lat=None, lng=None) -> Column:
    """Figure bounds: inside ±85 / ±180, ordered, optionally holding a site."""
    b = col(b)
    ok = (
        (b["north"] > b["south"]) & (b["east"] > b["west"])
        & (b["south"] >= -85) & (b["north"] <= 85)
        & (b["west"] >= -180) & (b["east"] <= 180)
    )
    if lat is not None:
        ok = ok & valid_location(lat, lng) & _contains_point(b, lat, lng)
    return _known(ok)


def valid_coverage(b) -> Column:
    """Catalog coverage: like figure bounds, but latitudes reach ±90."""
    b = col(b)
    return _known(
        (b["west"] >= -180) & (b["east"] <= 180) & (b["south"] >= -90) & (b["north"] <= 90)
        & (b["west"] < b["east"]) & (b["south"] < b["north"])
    )


def bbox_intersects(a, b) -> Column:
    """Boxes share a point; a missing box meets everything."""
    a, b = col(a), col(b)
    meets = (
        (a["west"] <= b["east"]) & (a["east"] >= b["west"])
        & (a["south"] <= b["north"]) & (a["north"] >= b["south"])
    )
    return a.isNull() | b.isNull() | meets


def bbox_contains(outer, inner, null_ok: bool = True) -> Column:
    """``outer`` holds ``inner``; a missing outer box holds everything if ``null_ok``."""
    outer, inner = col(outer), col(inner)
    inside = _known(
        (outer["west"] <= inner["west"]) & (outer["east"] >= inner["east"])
        & (outer["south"] <= inner["south"]) & (outer["north"] >= inner["north"])
    )
    return (outer.isNull() | inside) if null_ok else inside


def bounds_hold_point(b, lat, lng) -> Column:
    return _known(_contains_point(col(b), lat, lng))


# -- segments ---------------------------------------------------------------


def on_segment(x, y, ax, ay, bx, by) -> Column:
    """Distance to the segment is within 1e-10, boxed by the segment ends.

    The box comes first: it is cheap and rules out almost every edge.
    """
    x, y, ax, ay, bx, by = map(col, (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = F.hypot(dx, dy)
    eps = EDGE_TOLERANCE
    close = F.when(length == 0, F.hypot(x - ax, y - ay) < eps).otherwise(
        F.abs((x - ax) * dy - (y - ay) * dx) <= length * eps)
    return (
        (x >= F.least(ax, bx) - eps) & (x <= F.greatest(ax, bx) + eps)
        & (y >= F.least(ay, by) - eps) & (y <= F.greatest(ay, by) + eps) & close
    )


def edge_crosses_ray(x, y, ax, ay, bx, by) -> Column:
    """Edge b->a toggles the even-odd state of the ray from (x, y) to the east."""
    x, y, ax, ay, bx, by = map(col, (x, y, ax, ay, bx, by))
    straddles = (ay > y) != (by > y)
    return F.when(straddles, x < (bx - ax) * (y - ay) / (by - ay) + ax).otherwise(F.lit(False))


def segment_meets_box(ax, ay, bx, by, box) -> Column:
    """Liang-Barsky clip of a segment by a box, all sides inclusive."""
    ax, ay, bx, by, box = map(col, (ax, ay, bx, by, box))
    dx, dy = bx - ax, by - ay
    sides = [
        (-dx, ax - box["west"]),
        (dx, box["east"] - ax),
        (-dy, ay - box["south"]),
        (dy, box["north"] - ay),
    ]
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in sides])
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    return ~outside & (enter <= leave)


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Segments ab and cd cross or touch."""
    touch = (
        on_segment(ax, ay, cx, cy, dx, dy) | on_segment(bx, by, cx, cy, dx, dy)
        | on_segment(cx, cy, ax, ay, bx, by) | on_segment(dx, dy, ax, ay, bx, by)
    )
    proper = (
        (orientation(ax, ay, bx, by, cx, cy) * orientation(ax, ay, bx, by, dx, dy) < 0)
        & (orientation(cx, cy, dx, dy, ax, ay) * orientation(cx, cy, dx, dy, bx, by) < 0)
    )
    return touch | proper


def crossing_position(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Share of ab at which cd crosses it; null when parallel or apart."""
    ax, ay, bx, by, cx, cy, dx, dy = map(col, (ax, ay, bx, by, cx, cy, dx, dy))
    den = (ax - bx) * (cy - dy) - (ay - by) * (cx - dx)
    t = ((ax - cx) * (cy - dy) - (ay - cy) * (cx - dx)) / den
    u = -((ax - bx) * (ay - cy) - (ay - by) * (ax - cx)) / den
    crossed = F.when(t.between(0, 1) & u.between(0, 1), t)
    return F.when(F.abs(den) >= PARALLEL_LIMIT, crossed)


# -- rings ------------------------------------------------------------------


def close_ring(ring) -> Column:
    ring = col(ring)
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    open_ring = (first["x"] != last["x"]) | (first["y"] != last["y"])
    return (
        F.when(F.size(ring) <= 0, ring)
        .when(open_ring, F.concat(ring, F.array(first)))
        .otherwise(ring)
    )


def ring_edges(ring) -> Column:
    """One STRUCT<a, b> per vertex: the previous vertex (cyclic) and the vertex."""
    ring = col(ring)
    rest = F.greatest(F.size(ring) - 1, F.lit(0))
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, rest))
    return F.zip_with(before, ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def path_edges(points) -> Column:
    """Consecutive vertex pairs of an open line."""
    points = col(points)
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(
        F.slice(points, 1, n), F.slice(points, 2, n),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def flat_edges(ring) -> Column:
    """Cyclic edges as ARRAY<STRUCT<ax, ay, bx, by>>, empty below three points.

    Compute it once per feature, before a join multiplies the features.
    """
    ring = col(ring)
    edges = F.transform(ring_edges(ring), lambda e: F.struct(
        e["b"]["x"].alias("ax"), e["b"]["y"].alias("ay"),
        e["a"]["x"].alias("bx"), e["a"]["y"].alias("by")))
    return F.when(F.size(ring) >= 3, edges).otherwise(F.array().cast(f"array<{EDGE}>"))


def point_in_edges(x, y, edges) -> Column:
    """Even-odd test over flat edges in one pass; 2 marks a point on an edge."""
    x, y = col(x), col(y)
    state = F.aggregate(
        col(edges), F.lit(0),
        lambda acc, e: F.when(acc == 2, acc)
        .when(on_segment(x, y, e["ax"], e["ay"], e["bx"], e["by"]), 2)
        .when(edge_crosses_ray(x, y, e["ax"], e["ay"], e["bx"], e["by"]), 1 - acc)
        .otherwise(acc),
    )
    return state > 0


def point_in_ring(x, y, ring) -> Column:
    """Even-odd test; points within 1e-10 of an edge count as inside."""
    return point_in_edges(x, y, flat_edges(ring))


def point_in_polygon_edges(x, y, outer_edges, hole_edges) -> Column:
    """Inside the outer edges and in no hole; a hole's edge belongs to the hole."""
    x, y = col(x), col(y)
    in_hole = F.exists(col(hole_edges), lambda h: point_in_edges(x, y, h))
    return point_in_edges(x, y, outer_edges) & ~in_hole


def no_holes() -> Column:
    return F.array().cast("array<array<struct<x:double,y:double>>>")


def hole_edges(holes) -> Column:
    return F.transform(F.coalesce(col(holes), no_holes()), flat_edges)


def point_in_polygon(x, y, polygon, holes) -> Column:
    return point_in_polygon_edges(x, y, flat_edges(polygon), hole_edges(holes))


def rings_meet_box(polygon, holes, box) -> Column:
    """Any edge of any ring, holes included, meets the box."""
    rings = F.concat(F.array(col(polygon)), F.coalesce(col(holes), no_holes()))
    box = col(box)
    return F.exists(rings, lambda r: F.exists(
        path_edges(r),
        lambda e: segment_meets_box(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], box),
    ))


def box_corner_in_polygon(box, polygon, holes) -> Column:
    box = col(box)
    found = F.lit(False)
    for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north")):
        found = found | point_in_polygon(box[x], box[y], polygon, holes)
    return found


def point_in_convex(x, y, corners) -> Column:
    """Every non-negligible edge cross product has the same sign."""
    x, y = col(x), col(y)
    signs = F.transform(
        ring_edges(corners),
        lambda e: orientation(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], x, y),
    )
    turning = F.filter(signs, lambda s: F.abs(s) >= CONVEX_SLACK)
    return ~(F.exists(turning, lambda s: s > 0) & F.exists(turning, lambda s: s < 0))


def geometry_bounds(polygon, holes=None) -> Column:
    """Box over all vertices, holes included; null when there is no vertex."""
    vertices = col(polygon)
    if holes is not None:
        vertices = F.concat(vertices, F.coalesce(
            F.flatten(col(holes)), F.array().cast("array<struct<x:double,y:double>>")))
    xs = F.transform(vertices, lambda p: p["x"])
    ys = F.transform(vertices, lambda p: p["y"])
    box = bounds(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(vertices) > 0, box)


def ring_area(ring) -> Column:
    """Signed shoelace area relative to the first vertex."""
    ring = col(ring)
    origin = F.element_at(ring, 1)
    twice = F.aggregate(
        path_edges(ring), F.lit(0.0),
        lambda acc, e: acc
        + (e["a"]["x"] - origin["x"]) * (e["b"]["y"] - origin["y"])
        - (e["b"]["x"] - origin["x"]) * (e["a"]["y"] - origin["y"]),
    )
    return twice / 2


def centroid(points) -> Column:
    """Mean of the vertices."""
    points = col(points)
    n = F.size(points)
    total = F.aggregate(
        points, point(0.0, 0.0),
        lambda acc, p: point(acc["x"] + p["x"], acc["y"] + p["y"]),
    )
    return F.when(n > 0, point(total["x"] / n, total["y"] / n))


def vertex_keys(ring) -> Column:
    """A text for each vertex, equal for equal vertices: texts are hashed where structs would be compared one with all."""
    return F.transform(col(ring), lambda p: F.concat_ws(",", *[
        F.coalesce((p[axis] + 0.0).cast("string"), F.lit("none")) for axis in ("x", "y")]))


def distinct_vertices(ring) -> Column:
    return F.size(F.array_distinct(vertex_keys(ring)))


# Parts of the spacing of doubles at 1 below which a ring counts as flat.
SPACING = 2.0**-52
LINE_SLACK, AREA_SLACK = 1024, 256


def compensated_area(ring) -> Column:
    """Signed area of a closed ring, summed with the rounding error of every step carried along.

    Triangles from the first vertex; one pass. Unlike ``ring_area`` it keeps its digits on rings of very many vertices.
    """
    ring = col(ring)
    origin = F.element_at(ring, 1)

    def step(acc: Column, e: Column) -> Column:
        term = ((e["a"]["x"] - origin["x"]) * (e["b"]["y"] - origin["y"])
                - (e["a"]["y"] - origin["y"]) * (e["b"]["x"] - origin["x"]))

        def add(v: Column) -> Column:
            total, t = v["sum"], v["term"]
            whole = total + t
            lost = F.when(F.abs(total) >= F.abs(t), (total - whole) + t).otherwise((t - whole) + total)
            return F.struct(whole.alias("sum"), (v["lost"] + lost).alias("lost"))

        return let(F.struct(acc["sum"].alias("sum"), acc["lost"].alias("lost"), term.alias("term")), add)

    between = F.slice(ring, 2, F.greatest(F.size(ring) - 2, F.lit(0)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))
    return F.aggregate(path_edges(between), start, step, lambda acc: (acc["sum"] + acc["lost"]) / 2)


def ring_is_flat(ring) -> Column:
    """Whether a closed ring has no area for its size: all vertices on its longest line between extremes, or an area below
    what rounding can make of it. Both limits grow with the ring, so small rings are not flat by being small.
    """
    ring = col(ring)

    def judge(v: Column) -> Column:
        xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
        ends = F.array(*[F.get(v, F.array_position(side, pick(side)).cast("int") - 1)
                         for side in (xs, ys) for pick in (F.array_min, F.array_max)])
        size = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
        lines = F.flatten(F.transform(ends, lambda a: F.transform(ends, lambda b: F.struct(
            ((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("squared"),
            (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), a["x"].alias("x"), a["y"].alias("y")))))
        longest = F.array_max(lines)
        off = lambda line: F.array_max(F.transform(v, lambda p: F.abs(
            line["dx"] * (p["y"] - line["y"]) - line["dy"] * (p["x"] - line["x"]))))
        straight = let(longest, lambda line: off(line) <= line["squared"] * SPACING * LINE_SLACK)
        twice = F.abs(compensated_area(ring)) * 2
        return straight | ~(twice > size * size * SPACING * AREA_SLACK * F.size(v)) | ~(twice < float("inf"))

    vertices = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.when(F.size(ring) > 1, let(vertices, judge)).otherwise(F.lit(True))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Segments ab and cd cross or touch, with an end on a line only within 1e-14 of its cross product."""
    def lies(px, py, sx, sy, ex, ey) -> Column:
        px, py, sx, sy, ex, ey = map(col, (px, py, sx, sy, ex, ey))
        return (px.between(F.least(sx, ex), F.greatest(sx, ex)) & py.between(F.least(sy, ey), F.greatest(sy, ey))
                & (F.abs(orientation(sx, sy, ex, ey, px, py)) < ZERO_AREA))

    touch = (lies(ax, ay, cx, cy, dx, dy) | lies(bx, by, cx, cy, dx, dy) | lies(cx, cy, ax, ay, bx, by) | lies(dx, dy, ax, ay, bx, by))
    proper = (
        (orientation(ax, ay, bx, by, cx, cy) * orientation(ax, ay, bx, by, dx, dy) < 0)
        & (orientation(cx, cy, dx, dy, ax, ay) * orientation(cx, cy, dx, dy, bx, by) < 0))
    return touch | proper


def ring_crossings(ring, meets=segments_cross) -> Column:
    """ARRAY<STRUCT<i, j>> of the edges (from 1) that touch or cross without being neighbours, all pairs inside the row.

    The work grows with the square of the vertices; ``rings.crossings`` takes longer rings apart.
    """
    def pairs(edges: Column) -> Column:
        n = F.size(edges)

        def of(e: Column, i: Column) -> Column:
            # The edges after the next one; the last is a neighbour of the first.
            rest = F.slice(edges, i + 3, F.greatest(n - i - 2 - (i == 0).cast("int"), F.lit(0)))
            numbered = F.transform(rest, lambda r, k: F.struct(r["a"].alias("c"), r["b"].alias("d"), (i + k + 3).alias("j")))
            a, b = e["a"], e["b"]

            def near(r: Column, axis: str) -> Column:
                c, d = r["c"], r["d"]
                return ((F.least(a[axis], b[axis]) <= F.greatest(c[axis], d[axis]) + 1e-9)
                        & (F.least(c[axis], d[axis]) <= F.greatest(a[axis], b[axis]) + 1e-9))

            hit = F.filter(numbered, lambda r: near(r, "x") & near(r, "y") & meets(
                a["x"], a["y"], b["x"], b["y"], r["c"]["x"], r["c"]["y"], r["d"]["x"], r["d"]["y"]))
            return F.transform(hit, lambda r: F.struct((i + 1).alias("i"), r["j"].alias("j")))

        return F.flatten(F.transform(edges, of))

    return let(path_edges(ring), pairs)
