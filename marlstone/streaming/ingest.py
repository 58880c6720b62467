"""Streaming forms of conversion and aggregation: files that arrive in a folder are converted once each, and global aggregates are kept current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions.casts import DATE_FORMAT, TIMESTAMP_FORMAT


def csv_stream(spark: SparkSession, folder: str, schema: T.StructType, sep: str = ",", max_files: int = 100) -> DataFrame:
    """CSV files of a folder as a stream, under the same NULL policy as the batch reader."""
    raw = spark.readStream.schema(schema).options(sep=sep, quote='"', escape='"', mode="FAILFAST", dateFormat=DATE_FORMAT, timestampNTZFormat=TIMESTAMP_FORMAT, maxFilesPerTrigger=str(max_files)).csv(folder)
    return raw.fillna("", [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)])


def stream_to_store(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Convert what is there now, exactly once, and stop; call again for what has come since."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` are dropped and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), *more)
