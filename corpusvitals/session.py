"""Session helpers."""

from collections.abc import Iterator
from contextlib import contextmanager
import os
import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # file texts travel to Python workers: keep batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}


#: Written folders of each Spark application, for ``clear_staged``.
_written: dict[str, list[str]] = {}


def build_session(app: str = "corpusvitals", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used on one machine. Tasks of
    several machines would each write to their own disk, so there the
    setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: master {master!r} has several machines")
    return os.path.join(tempfile.mkdtemp(prefix="run-"), label)


def track(spark: SparkSession, path: str) -> str:
    """Have ``clear_staged`` delete a folder, once it is written."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark's readers see them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = hadoop_path(spark, path)
    return system.exists(found)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they end. Otherwise these
    stay until the driver happens to collect its garbage, and those of all
    steps of a long job are on disk at once."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def stage(df: DataFrame, label: str, **options) -> DataFrame:
    """Write an intermediate table and read it back.

    Cuts the lineage in a way that survives lost executors, and lets later
    steps prune its columns and see its real size. ``options`` go to the
    Parquet writer.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    with dropped_shuffles(spark):
        df.write.options(**options).parquet(path)
    track(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete the folders that this session has written with ``stage`` or
    named to ``track``, and say how many; tables read from them are gone, so
    call it after the last write. A folder that cannot be deleted stays named
    for the next call."""
    cleared, left = 0, []
    for path in _written.pop(spark.sparkContext.applicationId, []):
        try:
            found, system = hadoop_path(spark, path)
            cleared += system.delete(found, True)
        except Exception as fault:
            warnings.warn(f"{path} was not deleted: {fault}")
            left.append(path)
    for path in left:
        track(spark, path)
    return cleared
