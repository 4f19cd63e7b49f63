"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.session import durable

__all__ = ["components", "dropped", "durable", "known_to", "let_go", "marked", "small_batches", "split_words", "stored", "table", "unknown_to"]


#: Rows in an Arrow batch. Texts are long, and an executor holds a batch and its results for each task.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Names of the folders that ``stored`` writes.
OWN = re.compile("table-[0-9a-f]{32}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder of ``spark.checkpoint.dir`` and read again.

    Smaller than a checkpoint of rows, and later readers take only the columns they need.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    small_batches(spark)
    if context.getCheckpointDir() is None:
        durable(spark.range(1))  # settles the folder: the setting, or a temporary one in local mode
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``tables``, also beneath them, once everything that reads it is written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        files = context._jvm.org.apache.hadoop.fs
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if OWN.fullmatch(folder.rpartition("/")[2]):
                path = files.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to are deleted: Spark does so when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let_go() -> None:
    """Gives back the memory that a Python worker has freed: it outlives its task, and Arrow and malloc keep theirs for it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words between the characters 0x20 and 0x09 to 0x0D, letters A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bits of the filter in ``known_to``. Fixed, so that what is broadcast is 1 MB at any size.
FILTER_BITS = 1 << 23


def marked(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be among ``ids``, and those whose key is not, by a bitmap of fixed size."""
    column = ids.columns[0]
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    words = (
        ids.select(slot.alias("s")).selectExpr("int(s div 32) AS w", "shiftleft(1L, int(s % 32)) AS b")
        .groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    )
    image = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for row in words:
        image[row.w] = row.b
    shared = df.sparkSession.sparkContext.broadcast(image.tobytes())

    @F.arrow_udf("boolean")
    def may_be(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        bits = np.frombuffer(shared.value, dtype=np.uint32)
        return pa.array((bits[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool))

    known = may_be(F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)))
    return df.where(known), df.where(~known)


def known_to(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``ids``.

    The bitmap removes most other rows in the scan, before the exact semi-join
    moves any of their columns. When there are so many ids that it is full, the join alone decides.
    """
    near, _ = marked(df, key, ids)
    return near.join(*listed(df, key, ids), "left_semi")


def unknown_to(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is null or not in the one column of ``ids``."""
    near, far = marked(df, key, ids)
    return far.union(near.join(*listed(df, key, ids), "left_anti"))


def listed(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """The ids under a name that ``df`` does not have, and the condition that meets them."""
    name = "known"
    while name in df.columns:
        name += "_"
    return ids.distinct().toDF(name), F.col(key) == F.col(name)


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): root is the smallest id reachable.

    Alternates two star contractions until the pairs no longer change. Every
    round is checkpointed; groups are met only as minima and joins, so a
    hub with very many links is combined before the shuffle and split by
    the skew join.
    """
    pairs = durable(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        pairs = durable(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(lowest.select("u", F.col("m").alias("v"))).distinct()
        )
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
        swept(links.sparkSession)
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
