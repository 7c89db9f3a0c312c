"""Snapshots that stand in for web services, caches and child processes."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import versions


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(schema).load(path)


def read_registry(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.REGISTRY_SCHEMA, format)


def read_commits(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.COMMIT_SCHEMA, format)


def read_branches(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.BRANCH_SCHEMA, format)


def read_lookups(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.LOOKUP_SCHEMA, format)


def read_advisories(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Flat advisory rows; rows without an id cannot be told apart and are
    left out."""
    return read_table(spark, path, schemas.ADVISORY_SCHEMA, format).where("vuln_id IS NOT NULL")


_RECORD = """
    id string, severity variant, database_specific struct<severity: variant>,
    affected array<struct<
        package: struct<ecosystem: string, name: string>, versions: array<string>,
        ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>
    >>
"""


def _affected(spark: SparkSession, path: str) -> DataFrame:
    """One row per record and package that it affects; severities count only where they are plain strings."""
    records = spark.read.schema(_RECORD).json(path).where("id IS NOT NULL")

    def text(value):
        return F.when(
            F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
        )

    return records.select(
        F.col("id").alias("vuln_id"),
        text(F.col("severity")).alias("severity"),
        text(F.col("database_specific.severity")).alias("db_severity"),
        F.explode_outer("affected").alias("a"),
    ).select(
        F.col("a.package.ecosystem").alias("ecosystem"),
        F.col("a.package.name").alias("name"),
        F.col("a.versions").alias("versions"),
        F.col("a.ranges").alias("ranges"),
        "vuln_id", "severity", "db_severity",
    )


def read_advisory_dump(spark: SparkSession, path: str) -> DataFrame:
    """Nested advisory records (JSON lines), one row per affected version that
    they list. What they say by ranges: ``read_advisory_ranges``."""
    return (
        _affected(spark, path)
        .select("ecosystem", "name", F.explode("versions").alias("version"), "vuln_id", "severity", "db_severity")
        .distinct()
    )


def _usable(ranges: Column) -> Column:
    """Ranges over versions; those over commits name none."""
    return F.filter(ranges, lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")


def _intervals(ecosystem: Column, events: Column) -> Column:
    """``low``, ``high`` and ``closed`` (whether ``high`` is inside) for each version of introduction.

    Events may stand in any order. An interval ends at the next fix above its
    start, or behind the next last affected version at or above it.
    """
    named = F.flatten(
        F.transform(
            events,
            lambda e: F.array(
                *[F.struct(F.lit(kind).alias("kind"), e[kind].alias("version")) for kind in ("introduced", "fixed", "last_affected")]
            ),
        )
    )
    keyed = F.transform(
        F.filter(named, lambda e: e["version"].isNotNull()),
        lambda e: F.struct(
            e["kind"].alias("kind"),
            F.when((e["kind"] == "introduced") & (e["version"] == "0"), versions.FIRST_KEY)
            .otherwise(versions.sort_key(ecosystem, e["version"])).alias("key"),
        ),
    )
    known = F.filter(keyed, lambda e: e["key"].isNotNull())

    def interval(events: Column, start: Column) -> Column:
        stops = F.filter(
            events,
            lambda e: ((e["kind"] == "fixed") & (e["key"] > start)) | ((e["kind"] == "last_affected") & (e["key"] >= start)),
        )
        stop = F.array_min(F.transform(stops, lambda e: F.struct(e["key"].alias("high"), (e["kind"] == "last_affected").alias("closed"))))
        return F.struct(
            start.alias("low"),
            F.coalesce(stop["high"], F.lit(versions.LAST_KEY)).alias("high"),
            F.coalesce(stop["closed"], F.lit(False)).alias("closed"),
        )

    starts = F.filter(known, lambda e: e["kind"] == "introduced")
    return F.transform(starts, lambda s: interval(known, s["key"]))


def read_advisory_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The affected ranges of versions in nested records, as intervals of sort keys."""
    return (
        _affected(spark, path)
        .select("*", F.explode(_usable(F.col("ranges"))).alias("range"))
        .select("*", F.inline(_intervals(F.col("ecosystem"), F.col("range.events"))))
        .select("ecosystem", "name", "low", "high", "closed", "vuln_id", "severity", "db_severity")
        .distinct()
    )


def unplaced_advisories(spark: SparkSession, path: str) -> DataFrame:
    """(vuln_id, ecosystem, name, reason) of records that no version can be held against."""
    rows = _affected(spark, path).withColumn("usable", _usable(F.col("ranges")))
    places = F.flatten(F.transform("usable", lambda r: _intervals(F.col("ecosystem"), r["events"])))
    empty = lambda column: F.coalesce(F.size(column), F.lit(0)) <= 0
    reason = (
        F.when(F.col("name").isNull() | F.col("ecosystem").isNull(), "no package")
        .when(~empty(F.col("versions")), None)
        .when(empty(F.col("ranges")), "neither versions nor ranges")
        .when(empty(F.col("usable")), "ranges of commits only")
        .when(empty(places), "no range with a version to start from")
    )
    return rows.select("vuln_id", "ecosystem", "name", reason.alias("reason")).where("reason IS NOT NULL")
