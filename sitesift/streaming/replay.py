"""Running a stream over the rows of a table, batch after batch, as if they arrived."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sitesift.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this store; a session that names another one is told so by Spark."""
    if spark.conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


def arrive(rows: DataFrame, part: str, key: str, folder: str, parts: int, files: int = 4) -> DataFrame:
    """A stream of ``rows`` that brings part 0, then part 1, and so on; the rows of one ``key`` in a part lie in one file.

    Files are read in order of their age, ``files`` in a batch. A part with few keys has fewer files, so a batch
    may hold the end of one part and the start of the next, never a later part before an earlier one. The rows are
    made once, for all parts.
    """
    made = f"{folder}-made"
    rows.write.partitionBy(part).parquet(made)
    laid = rows.sparkSession.read.schema(rows.schema).parquet(made)
    schema = rows.drop(part).schema
    for number in range(parts):
        laid.where(F.col(part) == number).select(*schema.names).repartition(files, key).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The whole output of a stream over what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return ended(query, lambda: spark.read.schema(stream.schema).parquet(f"{folder}/out"))


def ended(query: StreamingQuery, result: Callable[[], DataFrame]) -> DataFrame:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return result()


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
