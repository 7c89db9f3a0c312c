"""Incremental jobs over newly arriving rows."""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import paths
from ..functions.text import once
from ..operators import markers, secrets
from ..operators.findings import union_findings
from ..schemas import FINDING_SCHEMA
from ..session import hadoop_path, stage


#: Files of one micro-batch; what a batch holds in memory per key is bounded by it.
MAX_FILES = 1000


def read_new_files(
    spark: SparkSession, path: str, schema: str, format: str = "parquet", **options
) -> DataFrame:
    """Files that arrive in a folder (a glob is taken as it is), or one
    single file. At most ``MAX_FILES`` make a micro-batch unless
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` says otherwise."""
    if not options.keys() & {"maxFilesPerTrigger", "maxBytesPerTrigger"}:
        options["maxFilesPerTrigger"] = MAX_FILES
    found, system = hadoop_path(spark, path)
    if system.exists(found) and system.getFileStatus(found).isFile():
        options["pathGlobFilter"] = found.getName()  # compares names of files
        path = found.getParent().toString()
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def _folder(spark: SparkSession, path: str) -> None:
    """A stream that meets no file writes nothing: its sink reads as empty."""
    found, system = hadoop_path(spark, path)
    system.mkdirs(found)


def _scan(batch: DataFrame, with_markers: bool) -> DataFrame:
    parts = [secrets.scan_secrets(batch)]
    if with_markers:
        parts.append(markers.work_markers(batch))
    return union_findings(*parts)


def _facts(batch: DataFrame, *more) -> DataFrame:
    """What the rules need of each text, and ``more``."""
    path, content = F.col("path"), F.col("content")
    return batch.withColumn("lowered", F.lower(content)).select("repo_id", "path", *more, once(
        markers=F.when(paths.quality_category(path) != "generated", markers.marker_hits(content, F.col("lowered"))),
        secrets=F.when(paths.security_category(path) != "generated", secrets.secret_pieces(content, None, F.col("lowered"))),
    ))


def _findings(facts: DataFrame, with_markers: bool) -> DataFrame:
    """``_scan`` from written facts."""
    parts = [secrets.dedup_secret_findings(secrets.judged_secrets(secrets.located_secrets(facts)))]
    if with_markers:
        parts.append(markers.marker_findings(facts))
    return union_findings(*parts)


def scan_new_files(
    files: DataFrame, out_dir: str, checkpoint_dir: str, with_markers: bool = True
) -> StreamingQuery:
    """Scan each micro-batch of new (repo_id, path, content) rows once.

    A batch writes its own folder and replaces it when retried, so a restart
    neither loses nor repeats findings. ``read_findings`` reads them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _scan(batch, with_markers).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    _folder(files.sparkSession, out_dir)
    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def read_findings(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(FINDING_SCHEMA + ", batch long").parquet(out_dir).drop("batch")


_SCANNED = "repo_id string, path string, version long, batch long"


def scan_changed_files(
    files: DataFrame, out_dir: str, checkpoint_dir: str, with_markers: bool = True
) -> StreamingQuery:
    """Scan (repo_id, path, version, content) rows in which a path may come again.

    A batch scans the last version that it has of each path, and writes the
    findings beside a log of what it scanned, with the version. Nothing that
    was written is changed: ``current_findings`` takes the findings of the
    batch that saw the last version. Versions may arrive in any order; of
    equal ones the later batch counts, within a batch the greater hash.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        key = F.struct("version", F.xxhash64("content").alias("mark"))
        # texts are read once, where they are; only what was found in them meets the other versions
        facts = stage(_facts(batch, key.alias("key")), "scanned")
        latest = facts.groupBy("repo_id", "path").agg(F.max("key").alias("key"))
        # a file that a batch has twice has each finding once
        found = facts.join(latest, ["repo_id", "path", "key"], "left_semi")
        _findings(found, with_markers).distinct().write.mode("overwrite").parquet(f"{out_dir}/findings/batch={batch_id}")
        scanned = latest.select("repo_id", "path", "key.version")
        scanned.write.mode("overwrite").parquet(f"{out_dir}/scanned/batch={batch_id}")  # last: findings count from here on

    for part in ("findings", "scanned"):
        _folder(files.sparkSession, f"{out_dir}/{part}")
    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def current_findings(spark: SparkSession, out_dir: str) -> DataFrame:
    """Findings of the last version of every file that ``scan_changed_files`` has seen."""
    scanned = spark.read.schema(_SCANNED).parquet(f"{out_dir}/scanned")
    latest = scanned.groupBy("repo_id", F.col("path").alias("file")).agg(F.max_by("batch", F.struct("version", "batch")).alias("batch"))
    found = spark.read.schema(FINDING_SCHEMA + ", batch long").parquet(f"{out_dir}/findings")
    return found.join(latest, ["repo_id", "file", "batch"], "left_semi").drop("batch")


KEPT = "key string, ts timestamp"


def first_lookups(lookups: DataFrame, hours: int = 24) -> DataFrame:
    """Lookups that were due: a key's first one, and each that comes ``hours``
    or more after the last one kept.

    A key's rows are handled in event-time order within a micro-batch, so
    batches that arrive in order give what one batch gives; of a batch a key
    holds eight bytes a row, and the source bounds the batch
    (``read_new_files``). ``first_in_window`` needs no order. A row older than
    the last one kept counts as a repeat; one older than the watermark
    (``hours`` behind the newest row of earlier batches) is dropped. Only the
    last kept time is held per key, until the watermark passes its window.
    """
    window = hours * 3_600_000_000

    def due(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = [part["ts"].dropna().to_numpy("datetime64[us]").astype("int64") for part in parts]
        times = np.unique(np.concatenate(times)) if times else np.zeros(0, "int64")
        kept = []
        at = 0 if last is None else int(np.searchsorted(times, last + window))
        while at < len(times):
            last = int(times[at])
            kept.append(last)
            at = int(np.searchsorted(times, last + window))
        if last is not None:
            state.update((last,))
            over = last // 1000 + hours * 3_600_000
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "ts": np.array(kept, "int64").astype("datetime64[us]")})

    return (
        lookups.withWatermark("ts", f"{hours} hours")
        .groupBy("key")
        .applyInPandasWithState(due, KEPT, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def write_new_lookups(lookups: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    _folder(lookups.sparkSession, out_dir)
    return (
        first_lookups(lookups).writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


FIRST = "key string, window_start timestamp, ts timestamp, batch long"


def first_in_window(
    lookups: DataFrame, out_dir: str, checkpoint_dir: str, hours: int = 24
) -> StreamingQuery:
    """The first lookup of each key in each window of ``hours``.

    The state is one time per key and window, kept by Spark until the
    watermark passes; a key's rows are reduced to it where they are read, so
    a key with much of the data gathers nowhere. A batch writes what it has
    changed and replaces its folder when retried; ``read_first_in_window``
    takes the least time per window, whatever the batches were. Only a row
    older than the watermark (``hours`` behind the newest of earlier
    batches), whose window is closed, is dropped.
    """
    first = (
        lookups.withWatermark("ts", f"{hours} hours")
        .groupBy("key", F.window("ts", f"{hours} hours").alias("w"))
        .agg(F.min("ts").alias("first"))
        .select("key", F.col("w.start").alias("window_start"), F.col("first").alias("ts"))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    _folder(lookups.sparkSession, out_dir)
    return (
        first.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def read_first_in_window(spark: SparkSession, out_dir: str) -> DataFrame:
    found = spark.read.schema(FIRST).parquet(out_dir)
    return found.groupBy("key", "window_start").agg(F.min("ts").alias("ts"))
