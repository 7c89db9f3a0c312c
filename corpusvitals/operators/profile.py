"""Corpus profile: languages, sizes, line counts, oversized files."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions import paths, text as tx


def scan_source_files(listing: DataFrame, max_bytes: int | None = rules.MAX_SOURCE_BYTES) -> DataFrame:
    """Files worth analysing: known suffix, no ignored folder, size bound.

    ``max_bytes`` bounds source files only and may be None;
    ``sources.files.skipped_files`` lists what it leaves out. Uses ``path`` and ``size_bytes`` only, so a columnar source is pruned to
    them and contents of dropped files are never read.
    """
    path = F.col("path")
    fits = F.lit(True) if max_bytes is None else F.col("size_bytes") <= max_bytes
    return listing.where(
        fits
        & paths.extension(path).isin(list(rules.LANGUAGE_BY_EXTENSION))
        & ~paths.base_name(path).isin(rules.IGNORED_FILES)
        & ~paths.in_ignored_directory(path)
    )


def scan_manifests(listing: DataFrame) -> DataFrame:
    path = F.col("path")
    return listing.where(
        F.lower(paths.base_name(path)).isin(list(rules.MANIFEST_ECOSYSTEM))
        & ~paths.in_ignored_directory(path, fold_case=True)
    ).dropDuplicates(["repo_id", "path"])


def classify(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        "repo_id",
        "path",
        paths.file_type(path).alias("file_type"),
        paths.quality_category(path).alias("quality_category"),
        paths.security_category(path).alias("security_category"),
    )


def language_profile(files: DataFrame) -> DataFrame:
    return (
        files.select("repo_id", paths.language(F.col("path")).alias("language"))
        .where("language IS NOT NULL")
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("n_files"))
    )


def ranked_languages(profile: DataFrame) -> DataFrame:
    """``language_profile`` with ``rank``: by count, the largest first, then by name."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("n_files"), "language")
    return profile.withColumn("rank", F.row_number().over(order))


def corpus_size(files: DataFrame) -> DataFrame:
    return size_of(files.select("repo_id", "path", tx.read_line_count(F.col("content")).alias("read_lines")))


def size_of(facts: DataFrame) -> DataFrame:
    """``corpus_size`` from ``read_lines`` columns; a file that could not be read counts without lines."""
    known = paths.language(F.col("path")).isNotNull()
    lines = F.coalesce(F.when(known, F.col("read_lines")), F.lit(0))
    return facts.groupBy("repo_id").agg(
        F.count("*").alias("n_files"), F.sum(lines.cast("long")).alias("n_lines")
    )


def large_file_severity(lines: Column, threshold: Column) -> Column:
    # compared without division: ratio >= 1.75 is 4 * lines >= 7 * threshold
    lines, threshold = lines.cast("long"), threshold.cast("long")
    return (
        F.when((threshold <= 0) | (lines >= threshold * 3), "HIGH")
        .when(lines * 4 >= threshold * 7, "MEDIUM")
        .otherwise("LOW")
    )


def measure_files(files: DataFrame) -> DataFrame:
    """Line counts of files the quality rules look at; the text stops here."""
    path = F.col("path")
    return (
        files.where((paths.quality_category(path) != "generated") & (F.col("content") != ""))
        .select("repo_id", "path", tx.once(lines=tx.split_line_count(F.col("content"))))
    )


def flag_large(measured: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Rows of ``measure_files`` above their threshold, as findings.

    ``thresholds`` (repo_id, language_key, max_lines) grows with the number
    of configured repositories; it is joined to line counts only, never to
    text, and the join strategy is left to Spark's size estimates.
    """
    path = F.col("path")
    rows = measured.withColumns({
        "language_key": paths.threshold_key(path),
        "threshold": paths.default_threshold(path),
    })
    if thresholds is not None:
        rows = (
            rows.join(thresholds, ["repo_id", "language_key"], "left")
            .withColumn("threshold", F.coalesce("max_lines", "threshold"))
            .drop("max_lines")
        )
    lines, limit = F.col("lines"), F.col("threshold")
    over = (lines - limit) / limit * 100
    kind = paths.file_type(path)
    large = rows.where(lines > limit)
    why, advice = rules.EXPLANATIONS["Large File"]
    return large.select(
        "repo_id",
        F.lit("quality").alias("domain"),
        F.lit("Large File").alias("type"),
        path.alias("file"),
        large_file_severity(lines, limit).alias("severity"),
        large_file_severity(lines, limit).alias("priority"),
        F.lit(100).alias("confidence"),
        lines.cast("int").alias("lines"),
        limit.cast("int").alias("threshold"),
        over.alias("over_percentage"),
        F.format_string(
            rules.DETAILS["large_file"],
            # quarters are exact: half of a tenth goes to the even one
            kind, lines, limit, F.when((over * 4) % 1 == 0, F.bround(over, 1)).otherwise(over),
        ).alias("details"),
        F.lit(why).alias("why"),
        F.lit(advice).alias("recommendation"),
    )


def large_files(files: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    return flag_large(measure_files(files), thresholds)
