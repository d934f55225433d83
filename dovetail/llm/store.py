"""Tables in the folder that the whole cluster shares: lineage ends there, so a lost executor costs no more than its tasks."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this machine if Spark runs on it alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="dovetail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder (in a folder for each value of `by`) and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dovetail-{tag}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _kept.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._dovetail_path = path  # type: ignore[attr-defined]
    return out


SMALL = 100_000


def small(df: DataFrame, tag: str) -> DataFrame:
    """A table of few numbers, written; marked for broadcasting if it has SMALL rows at most, else joined as any other."""
    out = materialize(df, tag)
    return F.broadcast(out) if out.count() <= SMALL else out


def again(df: DataFrame) -> DataFrame:
    """A materialised table read once more, for a plan that needs it on two sides."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._dovetail_path)  # type: ignore[attr-defined]
    out._dovetail_path = df._dovetail_path  # type: ignore[attr-defined]
    return out


def bucketed(df: DataFrame, tag: str, key: str, buckets: int, by: str) -> DataFrame:
    """As materialize with `by`, in `buckets` buckets of `key`: joins and groups by the key need no shuffle of it."""
    spark = df.sparkSession
    name = f"dovetail_{tag}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.partitionBy(by).bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(name)
    _kept.append((spark, path))
    out = spark.table(name).select(*df.columns)
    out._dovetail_path, out._dovetail_table = path, name  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Deletes a materialised table that nothing reads any more."""
    path, name = getattr(df, "_dovetail_path", None), getattr(df, "_dovetail_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        _delete(df.sparkSession, path)
        _kept[:] = [x for x in _kept if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _kept:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id"):
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS rows at most meanwhile: whole texts in batches of the default size take much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if int(was) <= 0 or int(was) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def parts_for(spark: SparkSession, n_bytes: int, part_bytes: int) -> int:
    """Parts for an exchange: the session's shuffle partitions, or more where parts would pass part_bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // part_bytes))
