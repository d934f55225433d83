"""Readers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dovetail.sources.documents import read_folder
from dovetail.sources.tables import read_table

_readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {"csv": read_table, "resume": read_folder}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _readers[name] = reader


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in _readers:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(_readers))}")
    return _readers[name]
