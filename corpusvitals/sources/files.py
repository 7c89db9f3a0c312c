"""Source trees as tables."""

import collections
import itertools
import os
import time
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..functions import paths, text as tx
from ..operators.profile import scan_manifests, scan_source_files
from ..session import stage

_LISTING = "repo_id string, path string, size_bytes long, root string"
_LISTING_COLUMNS = ["repo_id", "path", "size_bytes", "root"]


_LISTING_ROWS = 10_000
#: Folders that a task lists from where it starts, before the rest is dealt out anew.
FOLDERS = 200

_FOUND = _LISTING + ", is_folder boolean"


def _folder(full: str):
    """Names of a folder; one that cannot be entered has none."""
    try:
        with os.scandir(full) as entries:
            yield from entries
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return


def _walk(root: str, folder: str):
    """(relative path, size, is_folder) below ``root/folder``, no links
    followed: the files of up to ``FOLDERS`` folders, and the folders that are
    left. Only folders that neither scan enters are pruned; the rules
    themselves are columns."""
    pruned = {d for d in rules.IGNORED_DIRECTORIES if d == d.lower()}
    waiting = collections.deque([folder])
    for _ in range(FOLDERS):
        if not waiting:
            return
        folder = waiting.popleft()
        for entry in _folder(os.path.join(root, folder)):
            path = os.path.join(folder, entry.name)
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in pruned:
                    waiting.append(path)
            elif entry.is_file(follow_symlinks=False):
                yield path, entry.stat(follow_symlinks=False).st_size, False
    for folder in waiting:
        yield folder, None, True


def _walk_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = (
            (row.repo_id, path, size, row.root, is_folder)
            for row in batch.itertuples(index=False) for path, size, is_folder in _walk(row.root, row.folder)
        )
        while rows := list(itertools.islice(found, _LISTING_ROWS)):
            listed = pd.DataFrame(rows, columns=[*_LISTING_COLUMNS, "is_folder"])
            listed["size_bytes"] = listed["size_bytes"].astype("Int64")
            yield listed


#: Tasks for each core that visit a file system.
_TASKS = 4


def _dealt(rows: DataFrame, *by) -> DataFrame:
    """Deal rows that name files or folders out. The number of tasks is given:
    such rows are small, so adaptive execution would put very many into one."""
    return rows.repartition(_TASKS * rows.sparkSession.sparkContext.defaultParallelism, *by)


def list_trees(repos: DataFrame) -> DataFrame:
    """List files of every (repo_id, root) on a file system all executors see.

    Spark's own file listing hides names starting with ``_`` or ``.`` (such
    as ``__init__.py``), so folders are listed by tasks. A task lists a
    bounded number of folders below the one it was given; those that are left
    are a frontier, written and dealt out anew, until none is left. So a big
    tree is listed by many tasks, in rounds that grow with its depth. A root
    that does not exist has no files.
    """
    spark = repos.sparkSession
    frontier = repos.select("repo_id", "root", F.lit("").alias("folder"))
    listed = spark.createDataFrame([], _LISTING)
    while True:
        spread = _dealt(frontier, F.xxhash64("repo_id", "folder"))
        found = stage(spread.mapInPandas(_walk_all, _FOUND), "listed")
        listed = listed.union(found.where(~F.col("is_folder")).drop("is_folder"))
        frontier = found.where("is_folder").select("repo_id", "root", F.col("path").alias("folder"))
        if not frontier.limit(1).count():
            return listed


#: What reading a file may find once and for all; other faults are tried again.
_FINAL = {
    FileNotFoundError: "missing", PermissionError: "not permitted",
    IsADirectoryError: "a folder", NotADirectoryError: "missing",
}
_TRIES = 3
#: Contents that a task holds before it hands them on.
_HELD_BYTES = 32 << 20


def _read(full: str) -> tuple:
    """(content, reason). A fault that may pass is raised after some tries: the
    task fails and is run again, no file goes missing without a trace."""
    for trial in range(_TRIES):
        try:
            with open(full, "rb") as f:
                return f.read(), None
        except tuple(_FINAL) as fault:
            return None, _FINAL[type(fault)]
        except OSError:
            if trial + 1 == _TRIES:
                raise
            time.sleep(trial + 1)


def _load(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in files:
        rows, held = [], 0
        for row in batch.itertuples(index=False):
            content, reason = _read(os.path.join(row.root, row.path))
            rows.append((*row, content, reason))
            held += len(content or b"")
            if held >= _HELD_BYTES:
                yield pd.DataFrame(rows, columns=[*batch.columns, "content", "reason"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=[*batch.columns, "content", "reason"])


def read_contents(listing: DataFrame) -> DataFrame:
    """Read and decode listed files, spread over the cluster by path so that
    a big tree is not read by the task that listed it.

    A file that cannot be read keeps its row: ``content`` is NULL and
    ``reason`` says why.
    """
    listed = _dealt(listing.select(*_LISTING_COLUMNS), "repo_id", "path")
    raw = listed.mapInPandas(_load, _LISTING + ", content binary, reason string")
    return raw.select(
        "repo_id", "path", "size_bytes", tx.decode_utf8(F.col("content")).alias("content"), "reason"
    )


def skipped_files(listing: DataFrame, contents: DataFrame | None = None, max_bytes: int | None = rules.MAX_SOURCE_BYTES) -> DataFrame:
    """(repo_id, path, size_bytes, reason): source files that no rule sees,
    because of their size or, with ``contents``, because they cannot be read."""
    too_large = scan_source_files(listing, None).select(
        "repo_id", "path", "size_bytes", F.lit("too large").alias("reason")
    )
    found = too_large.where(F.col("size_bytes") > max_bytes if max_bytes is not None else F.lit(False))
    if contents is not None:
        unread = contents.where("reason IS NOT NULL")
        found = found.unionByName(unread.select("repo_id", "path", "size_bytes", "reason"))
    return found


def read_binary_table(df: DataFrame) -> DataFrame:
    """Decode a (repo_id, path, size_bytes, content binary) table."""
    return df.withColumn("content", tx.decode_utf8(F.col("content")))


def read_object_store(spark: SparkSession, root: str) -> DataFrame:
    """``root/<repo_id>/<path>`` through Spark's binary reader.

    For stores no task can walk. Files Spark hides (leading ``_`` or ``.``)
    are missing; prefer ``list_trees`` or an ingested table. No file is left
    out for its size: ``scan_source_files`` has that bound, and a filter on
    ``size_bytes`` is applied to metadata before contents are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    marker = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.substring_index(F.col("path"), f"/{marker}/", -1)
    return raw.select(
        F.substring_index(relative, "/", 1).alias("repo_id"),
        F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
        F.col("length").alias("size_bytes"),
        tx.decode_utf8(F.col("content")).alias("content"),
    )


def read_sources(listing: DataFrame) -> DataFrame:
    return read_contents(scan_source_files(listing))


def read_manifests(listing: DataFrame) -> DataFrame:
    return read_contents(scan_manifests(listing))


def read_configs(listing: DataFrame, name: str = ".corpusvitals.json") -> DataFrame:
    return read_contents(listing.where(F.col("path") == name))
