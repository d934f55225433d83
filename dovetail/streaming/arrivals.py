"""Table files that keep arriving, as a stream of identified rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dovetail.sources import tables


def arriving_rows(spark: SparkSession, folder: str, headers: list[str]) -> DataFrame:
    """Rows of CSV files with the given headers as files arrive; a row is known by its file and content, not by a number."""
    raw = spark.readStream.option("header", True).schema(", ".join(f"`{h}` string" for h in headers)).csv(folder)
    rows = tables.mapped(raw).withColumn("row_number", F.xxhash64(*tables.ATTRIBUTES))
    return tables.identified(rows)


def keep(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all rows that have arrived to Parquet, once each, and ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
