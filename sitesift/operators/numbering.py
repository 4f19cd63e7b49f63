"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.session import durable

# Consecutive ids of one group that are numbered in one task.
ID_BLOCK = 1 << 20


def id_block(key: str) -> Column:
    """Order-preserving bucket of an integer id: at most ``ID_BLOCK`` ids each."""
    return F.shiftright(F.col(key).cast("bigint"), 20)


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    blocks: Sequence[Column] | None,
    order: Sequence[Column],
    out: str = "pos",
) -> DataFrame:
    """``row_number`` over ``group`` ordered by ``order``, without one task per group.

    ``blocks`` are leading, order-preserving keys of ``order`` (for example
    ``id_block``). Rows are numbered inside (group, block); a running sum over
    the block counts gives each block its offset. A group that holds a third
    of the table is thus spread over its blocks. ``order`` must be total.
    Without ``blocks`` they are ranges between sampled values of group and
    order, of about equal size whatever the values look like; the ranges
    are settled by a checkpoint, since both passes must see the same ones.
    Null groups and blocks count as values of their own.
    """
    if blocks is None:
        ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
        return number_rows(durable(ranged), group, [F.col("_range")], order, out).drop("_range")
    names = [f"_b{i}" for i in range(len(blocks))]
    blocked = df
    for name, block in zip(names, blocks):
        blocked = blocked.withColumn(name, block)
    keys = [*group, *names]
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = blocked.withColumn("_rn", inside)
    here, there = numbered.alias("here"), offsets.alias("there")
    same = [F.col(f"here.`{k}`").eqNullSafe(F.col(f"there.`{k}`")) for k in keys]
    return here.join(there, same, "left").select(
        *[F.col(f"here.`{c}`") for c in df.columns],
        (F.col("_rn") + F.col("_offset")).cast("bigint").alias(out))


def running_sum(
    df: DataFrame, group: Sequence[str], blocks: Sequence[Column], order: Sequence[Column], weight: str, out: str,
) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows of its group up to each one, without one task per group.

    Sums inside (group, block), plus the sum of the blocks before. ``blocks`` and ``order`` as in ``number_rows``; a null weight adds nothing.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    blocked = df
    for name, block in zip(names, blocks):
        blocked = blocked.withColumn(name, block)
    keys = [*group, *names]
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy(*keys).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocked.withColumn("_sum", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    here, there = summed.alias("here"), offsets.alias("there")
    same = [F.col(f"here.`{k}`").eqNullSafe(F.col(f"there.`{k}`")) for k in keys]
    return here.join(there, same, "left").select(
        *[F.col(f"here.`{c}`") for c in df.columns], (F.col("_sum") + F.col("_offset")).cast("bigint").alias(out))
