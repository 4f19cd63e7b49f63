"""Sharding by minimax contiguous partition [native].

Rows with equal texts are one atomic group. Groups stand in the order of a 64-bit
hash of the text; the partition cuts this order into at most ``shards`` runs so
that the largest run is as small as possible.

The smallest capacity is found by binary search, checking each capacity
greedily. The check needs prefix sums only near the cuts, so the order is seen
through a histogram: 4,096 cells first, then 64 times finer inside just those
cells in which a cut can fall, until each of them is a single group. The driver
holds a few thousand cells at any input size.

Defined cases: a null text counts as an empty one (size 1); repeated rows stay
rows of one group; a null doc_id keeps its row; an empty table gives no rows;
with fewer groups than shards the last shards stay empty. Two texts with one hash
would share a shard, which the law allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.shared import stored

FIRST_BITS = 12
FINER_BITS = 6
SLOT_BITS = 8
SLOT_PARTS = 64


@dataclass(frozen=True)
class Cell:
    low: int  # smallest key inside, signed
    bits: int  # leading key bits that the cell fixes
    total: int
    biggest: int
    groups: int


def cells(groups: DataFrame, bits: int, inside: list[Cell] | None = None) -> list[Cell]:
    """Histogram of (key, size) over the leading ``bits``, within ``inside`` if given."""
    if inside is not None:
        outer = inside[0].bits
        prefix = F.shiftright("key", 64 - outer)
        groups = groups.where(prefix.isin([c.low >> (64 - outer) for c in inside]))
    rows = (
        groups.groupBy(F.shiftright("key", 64 - bits).alias("cell"))
        .agg(F.sum("size").alias("total"), F.max("size").alias("biggest"), F.count("*").alias("groups"))
        .collect()
    )
    return [Cell(r.cell << (64 - bits), bits, r.total, r.biggest, r.groups) for r in rows]


def cuts(order: list[Cell], shards: int, capacity: int, loose: bool) -> list[tuple[int, int]] | None:
    """Greedy cuts as (bytes before, cell index); None if ``shards`` runs don't do.

    ``loose`` may cut anywhere inside a cell of several groups; otherwise each
    cell is taken whole, and one above the capacity holds the cut in place.
    """
    found, at, before, index, filled = [], 0, 0, 0, 0
    while index < len(order):
        cell = order[index]
        left = before + cell.total - at
        if filled + left <= capacity:
            filled, before, at, index = filled + left, before + cell.total, before + cell.total, index + 1
            continue
        if loose and cell.groups > 1:
            at += capacity - filled
        elif filled == 0:
            return None
        found.append((at, index))
        filled = 0
        if len(found) >= shards:
            return None
    return found


def least_capacity(order: list[Cell], shards: int, loose: bool) -> int:
    low = max(max(c.biggest for c in order), -(-sum(c.total for c in order) // shards))
    high = sum(c.total for c in order)
    while low < high:
        middle = (low + high) // 2
        if cuts(order, shards, middle, loose) is None:
            low = middle + 1
        else:
            high = middle
    return low


def unsettled(order: list[Cell], shards: int, low: int, high: int) -> set[int]:
    """Cells of several groups in which a cut can lie for a capacity in [low, high]."""
    ends, total = [], 0
    for cell in order:
        total += cell.total
        ends.append(total)
    first = last = 0  # bytes before the earliest and the latest next cut
    marked: set[int] = set()
    for _ in range(shards - 1):
        index = next((i for i, end in enumerate(ends) if end > first + low), len(order))
        first = max(first, ends[index - 1] if index else 0)
        last += high
        while index < len(order) and (ends[index] - order[index].total) <= last:
            if order[index].groups > 1:
                marked.add(index)
            index += 1
    return marked


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Smallest key of each shard after the first, for groups (key, size)."""
    order = sorted(cells(groups, FIRST_BITS), key=lambda c: c.low)
    if not order:
        return []
    while True:
        low = least_capacity(order, shards, True)
        high = least_capacity(order, shards, False)
        open_cells = unsettled(order, shards, low, high)
        if not open_cells:
            return [order[i].low for _, i in cuts(order, shards, high, False)]
        bits = min(order[i].bits for i in open_cells)
        now = [order[i] for i in sorted(open_cells) if order[i].bits == bits]
        finer = cells(groups, min(64, bits + FINER_BITS), now)
        gone = set(now)
        order = sorted([c for c in order if c not in gone] + finer, key=lambda c: c.low)


def shard(documents: DataFrame, shards: int = 16, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(order column, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Slots count from 0 without a gap in each shard: rows are numbered inside small
    parts of a shard (a hash cell and a share of the ids, so that a hot group
    is many parts), and the parts' counts, of fixed number, give the offsets.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = stored(documents.select(
        F.col(order).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key")))
    groups = stored(narrow.groupBy("key").agg(F.sum("size").alias("size")))
    edges = minimax_cuts(groups, shards)
    number = F.lit(0)
    for edge in edges:
        number = number + F.when(F.col("key") >= edge, 1).otherwise(0)
    placed = narrow.withColumns({
        "shard": number.cast("int"),
        "cell": F.shiftright("key", 64 - SLOT_BITS).cast("int"),
        "part": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SLOT_PARTS)).cast("int"),
    })
    keys = ["shard", "cell", "part"]
    from pyspark.sql import Window as W

    offsets = placed.groupBy(*keys).count().select(*keys, (
        F.sum("count").over(W.partitionBy("shard").orderBy("cell", "part")) - F.col("count")).alias("before"))
    # At most (256 + shards) x 64 rows: a cell lies in one shard, or in those that a cut inside it touches.
    inner = F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "key"))
    return placed.withColumn("inner", inner).join(F.broadcast(offsets), keys).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inner") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
