"""The streaming form of preparation: a file source, stateless steps, a counted JSON sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessellon.session import shared_dir


def read_records(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Records of the files under ``path``: a folder, or a pattern of files and folders."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_capped(stream: DataFrame, path: str, checkpoint: str, most: int, trigger: dict | None = None):
    """Appends batches as JSON until ``most`` rows are written; each batch has a folder of its own, so
    a batch that is run again after a failure replaces what it wrote."""

    counts: dict[int, int] = {}

    def sink(batch: DataFrame, number: int) -> None:
        def rows_of(*numbers: int) -> int:
            return batch.sparkSession.read.schema(batch.schema).json([f"{path}/batch={i}" for i in numbers]).count() if numbers else 0

        before = [i for i in range(number) if i not in counts]  # behind a restart, what earlier batches wrote is counted once
        done = sum(counts[i] for i in range(number) if i in counts) + rows_of(*before)
        if before:
            counts.update(dict.fromkeys(range(number), 0))
            counts[0] = done
        batch.limit(max(0, most - done)).write.mode("overwrite").json(f"{path}/batch={number}")
        counts[number] = rows_of(number)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(rows: DataFrame, name: str = "prepare") -> DataFrame:
    """The rows, with counters that listeners see: seen, compressed, plain."""
    return rows.observe(name, F.count("*").alias("seen"), F.sum(F.col("is_compressed").cast("long")).alias("compressed"), F.sum((~F.col("is_compressed")).cast("long")).alias("plain"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Tumbling counts and sums of an event stream, late rows within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs everything that is there into a table in the shared folder, each batch committed once."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}.log").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def complete(stream: DataFrame, name: str) -> DataFrame:
    """Runs everything that is there through an aggregation, and returns its last state as a table."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}.log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs everything that is there through ``sink``, and ends."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
