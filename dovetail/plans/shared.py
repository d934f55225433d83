"""Cutting lineage in the folder that the cluster shares, and dealing rows over the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from spark.checkpoint.dir (only where it is unset, a folder of this machine)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="dovetail-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key with many values over as many tasks as a shuffle has: a table of small rows is read in a task or two,
    whatever its rows cost afterwards."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
