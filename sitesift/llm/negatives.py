"""Hard-negative mining over rotated one-bit codes.

Vectors are turned by one fixed rotation. Of each, the index stores the signs (one bit a component), the
alignment (inner product of the vector with its code, a unit vector of equal components) and the length of the rest,
which is orthogonal to the code. For an anchor q and a row x with code s,

    <q, x> = alignment * <q, s> + <q, rest>,   |<q, rest>| <= |q - <q, s> s| * |rest|   (Cauchy-Schwarz),

and <q, s> comes from popcounts of the code with the bit planes of the anchor, whose rounding error is bounded too. So
every pair has an interval that holds its score for certain. Rows whose interval cannot
reach the result are passed over; the others are scored in integers. The result is exact.

Anchors are a stated query set. Rows and anchors meet in tiles of bounded size (ROW_TILE x ANCHOR_TILE), each a
group of an equi-join on the pair of tile numbers; a tile gives only the best few of each anchor.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; a vec_id
that occurs more than once counts once, with its smallest (label, vector); shorter vectors count as if
filled with zeros; components beyond the range in which a score fits 64 bits (2^28 for up to 64 dimensions) are cut to it;
equal scores go by the smaller vec_id; an anchor without positives or negatives has no rows; an empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitesift.llm.shared import stored

ROW_TILE = 8192
ANCHOR_TILE = 2048
#: Shuffle partitions over which tiles are dealt, at most; with more tiles a task takes several, one after the other.
MOST_PARTITIONS = 20_000
#: Bits of an anchor's component in the popcount estimate.
PLANES = 8
SEED = 20240613
#: Parts of |q| |x| that an interval is wider for the rounding of doubles.
SLACK = 1e-9
SCALE = 256


@dataclass(frozen=True)
class Contract:
    """Which rows are anchors, which labels move, and the window of negative scores in percent of the positive's."""

    anchor_step: int = 100
    moved_step: int = 7
    labels: int = 10
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


DEFAULT = Contract()


def rotation(dimensions: int) -> np.ndarray:
    """The fixed orthogonal matrix for ``dimensions``."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def limit(dimensions: int) -> int:
    """Largest component with which every inner product and its double fit 64 bits."""
    return min(1 << 28, math.isqrt((1 << 61) // max(dimensions, 1)))


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 64-bit words, alignment, length of the rest) of integer vectors."""
    dimensions = vectors.shape[1]
    turned = vectors.astype(float) @ rotation(dimensions)
    signs = turned >= 0
    bits = np.packbits(signs, axis=1, bitorder="little")
    words = np.zeros((len(vectors), 8 * -(-dimensions // 64)), np.uint8)
    words[:, : bits.shape[1]] = bits
    alignment = np.abs(turned).sum(axis=1) / math.sqrt(dimensions)
    rest = np.linalg.norm(turned - np.where(signs, 1.0, -1.0) * (alignment / math.sqrt(dimensions))[:, None], axis=1)
    return words.view("<u8"), alignment, rest


class Tile:
    """Rows of one tile, and the intervals of their scores with an anchor."""

    def __init__(self, table: pa.Table, dimensions: int):
        self.ids = table.column("vec_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = matrix(table.column("vector"), "<i4", dimensions).astype(np.int64)
        self.codes = matrix(table.column("code"), "<u8", -(-dimensions // 64))
        self.alignment = table.column("alignment").to_numpy()
        self.rest = table.column("rest").to_numpy()
        self.dimensions = dimensions
        self.turn = rotation(dimensions)

    def intervals(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of every row."""
        d = self.dimensions
        q = anchor.astype(float) @ self.turn
        low = float(q.min())
        step = (float(q.max()) - low) / ((1 << PLANES) - 1) or 1.0
        grid = np.rint((q - low) / step).astype(np.uint64)
        total = low * np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        padded = np.zeros(64 * self.codes.shape[1], np.uint64)
        padded[:d] = grid
        for plane in range(PLANES):
            bits = np.packbits((padded >> np.uint64(plane) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
            total = total + step * (1 << plane) * np.bitwise_count(self.codes & bits).sum(axis=1, dtype=np.int64)
        root = math.sqrt(d)
        estimate = (2 * total - float((low + step * grid).sum())) / root  # of <q, s>
        error = float(np.abs(q - (low + step * grid)).sum()) / root
        length = float(np.linalg.norm(q))
        least = np.maximum(np.abs(estimate) - error, 0)
        aside = np.sqrt(np.maximum(length**2 - least**2, 0)) * self.rest
        reach = aside + self.alignment * error + SLACK * length * (self.alignment + self.rest) + 1e-6
        middle = self.alignment * estimate
        return middle - reach, middle + reach

    def best(self, anchor: np.ndarray, among: np.ndarray, bounds: tuple[np.ndarray, np.ndarray],
             many: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the ``many`` best rows of ``among`` with scores from ``low`` to ``high``."""
        lowest, highest = bounds[0][among], bounds[1][among]
        if low is not None:
            near = (highest >= low) & (lowest <= high)
            among, lowest, highest = among[near], lowest[near], highest[near]
        # a first few, by the middle of the interval, show what a row must reach
        middle = lowest + highest
        if low is not None:
            middle = np.where(middle > 2 * high, 2.0 * high - middle, middle)
        if len(among) > 4 * many:
            first = np.argpartition(-middle, 4 * many)[: 4 * many]
            scores = self.vectors[among[first]] @ anchor
            if low is not None:
                scores = scores[(scores >= low) & (scores <= high)]
            if len(scores) >= many:
                near = highest >= np.partition(scores, -many)[-many]
                among = among[near]
        scores = self.vectors[among] @ anchor
        if low is not None:
            inside = (scores >= low) & (scores <= high)
            among, scores = among[inside], scores[inside]
        order = np.lexsort((self.ids[among], -scores))[:many]
        return among[order], scores[order]


def matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def index(embeddings: DataFrame, contract: Contract = DEFAULT) -> tuple[DataFrame, int]:
    """Stored (vec_id, label, vector, code, alignment, rest) of every row that takes part, and the number of dimensions."""
    x = F.col("embedding")
    sound = F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % contract.moved_step == 0, (label + 1) % contract.labels).otherwise(label)
    rows = (embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL").where(sound)
            .groupBy("vec_id").agg(F.min(F.struct(label.alias("l"), moved.alias("label"), x.alias("embedding"))).alias("r"))
            .select("vec_id", "r.label", "r.embedding"))
    dimensions = max(embeddings.where(sound).agg(F.max(F.size(x))).first()[0] or 0, 1)
    most = limit(dimensions)

    def coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            raw = np.zeros((batch.num_rows, dimensions))
            raw[np.arange(dimensions) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(SCALE * raw), -most, most).astype("<i4")
            codes, alignment, rest = coded(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in whole], pa.binary()),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(alignment), pa.array(rest)],
                names=["vec_id", "label", "vector", "code", "alignment", "rest"])

    wide = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return stored(wide.mapInArrow(
        coding, "vec_id bigint, label bigint, vector binary, code binary, alignment double, rest double")), dimensions


def tiles(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def spread_over(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def in_tiles(anchors: DataFrame, rows: DataFrame, visit: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``visit(anchors, rows)`` over every pair of an anchor tile and a row tile; both sides are copied once for each tile of the other."""
    across, down = tiles(anchors.count(), ANCHOR_TILE), tiles(rows.count(), ROW_TILE)
    left = anchors.toDF(*anchors.columns)  # names of its own: both sides come from one table
    left = left.withColumn("across", spread_over("vec_id", across)).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = rows.withColumn("down", spread_over("vec_id", down)).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    parts = min(across * down, MOST_PARTITIONS)  # a stated number: tiles are small and cost time, so they must not be merged by size
    left, right = left.repartition(parts, "across", "down"), right.repartition(parts, "across", "down")
    return left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(visit, schema)


def first_rows(df: DataFrame, by: list[str], score: str, name: str, many: int) -> DataFrame:
    """The ``many`` rows of highest score of each group, with their ``rank`` from 1."""
    order = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(name))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def positives(indexed: DataFrame, dimensions: int, contract: Contract = DEFAULT) -> DataFrame:
    """(anchor_id, positive_id, positive_score, rank): the best other rows of the anchor's label."""

    def visit(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        tile = Tile(rows, dimensions)
        out = []
        vectors = matrix(anchors.column("vector"), "<i4", dimensions).astype(np.int64)
        for anchor, label, vector in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), vectors):
            among = np.flatnonzero((tile.labels == label) & (tile.ids != anchor))
            if len(among):
                at, scores = tile.best(vector, among, tile.intervals(vector), contract.positives)
                out.append((np.full(len(at), anchor), tile.ids[at], scores))
        return joined(out, ["anchor_id", "positive_id", "positive_score"])

    anchors = indexed.where(F.col("vec_id") % contract.anchor_step == 0).select("vec_id", "label", "vector")
    found = in_tiles(anchors, indexed, visit, "anchor_id bigint, positive_id bigint, positive_score bigint")
    return first_rows(found, ["anchor_id"], "positive_score", "positive_id", contract.positives)


def joined(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = zip(*parts) if parts else [[np.zeros(0, np.int64)]] * len(names)
    return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(names, columns)})


def hard_negatives(embeddings: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives."""
    indexed, dimensions = index(embeddings, contract)
    chosen = stored(positives(indexed, dimensions, contract))
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # few each
    anchors = indexed.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", "positives")

    def visit(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        tile = Tile(rows, dimensions)
        out = []
        vectors = matrix(anchors.column("vector"), "<i4", dimensions).astype(np.int64)
        for anchor, label, vector, own in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(),
                                              vectors, anchors.column("positives").to_pylist()):
            among = np.flatnonzero(tile.labels != label)
            bounds = tile.intervals(vector)
            for positive in own:
                score = positive["positive_score"]
                low, high = -(-contract.low * score // 100), contract.high * score // 100
                if low <= high and len(among):
                    at, scores = tile.best(vector, among, bounds, contract.negatives, low, high)
                    same = np.full(len(at), 1)
                    out.append((same * anchor, same * positive["positive_id"], tile.ids[at], same * score, scores))
        return joined(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = in_tiles(anchors, indexed, visit, "anchor_id bigint, positive_id bigint, negative_id bigint, "
                                              "positive_score bigint, negative_score bigint")
    return first_rows(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", contract.negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
