"""Dependencies against advisories, and reuse of earlier lookups."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions import paths, versions
from ..functions.text import once
from ..session import stage

KEY = ["ecosystem", "name", "version"]


def _rank(severity: Column) -> Column:
    return paths.lookup(rules.SEVERITY_RANK, F.upper(severity))


def _label(rank: Column) -> Column:
    return paths.lookup({v: k for k, v in rules.SEVERITY_RANK.items()}, rank)


def advisory_summary(advisories: DataFrame) -> DataFrame:
    """Per package version: number of advisories and the highest severity of
    both severity fields; unknown values count as LOW.

    Counts instead of lists, so a package with very many advisories costs no
    more than any other.
    """
    rank = F.greatest(_rank(F.col("severity")), _rank(F.col("db_severity")))
    return advisories.groupBy(*KEY).agg(
        F.count("*").alias("n_vulns"),
        F.coalesce(_label(F.max(rank)), F.lit("LOW")).alias("max_severity"),
    )


#: Versions whose first signs of the sort key agree share a bin; of a bin so many go to one task.
BIN_SIGNS = 10
BIN_VERSIONS = 5000


def affected_versions(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Advisory rows, as in a flat snapshot, for every declared version that
    lies in a range of ``ranges`` (``low <= key < high``, ``<=`` if closed).

    A package's declared versions are put into bins by the first signs of
    their sort keys. A range goes to the bins that it touches and only meets
    the versions in them, so far apart versions and ranges never do. A bin
    with many versions is dealt over shares, each with the ranges of the bin.
    """
    return _in_ranges(deps, ranges).distinct()


def _in_ranges(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """``affected_versions``, with a row for each range of an advisory that holds a version."""
    package = ["ecosystem", "name"]
    bin_of = lambda key: F.substring(key, 1, BIN_SIGNS)
    declared = (
        deps.where(versions.is_checkable(F.col("name"), F.col("version")))
        .select(*KEY).distinct()
        # behind a generator: the filter would else run the key's patterns on every declared row
        .select(*KEY, once(key=versions.sort_key(F.col("ecosystem"), F.col("version"))))
        .where("key IS NOT NULL")
        .withColumn("bin", bin_of(F.col("key")))
    )
    bins = declared.groupBy(*package, "bin").agg(F.ceil(F.count("*") / BIN_VERSIONS).cast("int").alias("shares"))
    placed = (
        ranges.join(bins, package)
        .where((bin_of(F.col("low")) <= F.col("bin")) & (F.col("bin") <= bin_of(F.col("high"))))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .drop("shares")
    )
    dealt = declared.join(bins, [*package, "bin"]).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")).drop("shares")
    inside = (F.col("low") <= F.col("key")) & ((F.col("key") < F.col("high")) | (F.col("closed") & (F.col("key") == F.col("high"))))
    return (
        dealt.join(placed, [*package, "bin", "share"]).where(inside)
        .select(*KEY, "vuln_id", "severity", "db_severity")
    )


def with_ranges(deps: DataFrame, advisories: DataFrame, ranges: DataFrame) -> DataFrame:
    """Flat advisories for the declared versions: those listed and those in a
    range, an advisory that says both once."""
    columns = [*KEY, "vuln_id", "severity", "db_severity"]
    declared = deps.select(*KEY).distinct()
    listed = advisories.select(*columns).join(declared, KEY, "left_semi")
    return listed.unionByName(_in_ranges(deps, ranges)).distinct()


def dependency_vulnerabilities(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every dependency with its advisory count (0 when none).

    Only versions that are both declared and listed enter the summary that is
    joined back, so that side stays small even for a big snapshot.
    """
    declared = (
        deps.where(versions.is_checkable(F.col("name"), F.col("version")))
        .select(*KEY).distinct()
    )
    relevant = advisory_summary(advisories.join(declared, KEY, "left_semi"))
    return deps.join(relevant, KEY, "left").select(
        "repo_id", "manifest_path", "ecosystem", "name", "version",
        F.coalesce("n_vulns", F.lit(0)).cast("long").alias("n_vulns"),
        "max_severity",
    )


def vulnerable_findings(results: DataFrame) -> DataFrame:
    why, advice = rules.EXPLANATIONS["Vulnerable Dependency"]
    return results.where("n_vulns > 0").select(
        "repo_id",
        F.lit("security").alias("domain"),
        F.lit("Vulnerable Dependency").alias("type"),
        F.col("manifest_path").alias("file"),
        F.col("max_severity").alias("severity"),
        F.col("max_severity").alias("priority"),
        F.lit(100).alias("confidence"),
        F.col("name").alias("package"),
        "version",
        F.col("n_vulns").cast("int").alias("vuln_count"),
        F.lit(why).alias("why"),
        F.lit(advice).alias("recommendation"),
    )


def dependency_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("repo_id").agg(
        F.count("*").alias("n_dependencies"),
        F.count_if(F.col("n_vulns") > 0).alias("n_vulnerable"),
        F.sum("n_vulns").alias("n_vulnerabilities"),
    )


def manifest_summary(manifests: DataFrame, results: DataFrame) -> DataFrame:
    """Per manifest, also those declaring nothing. Results are counted before
    the join."""
    counts = results.groupBy("repo_id", "manifest_path").agg(
        F.count("*").alias("n_direct"),
        F.count_if(F.col("n_vulns") > 0).alias("n_vulnerable"),
        F.count_if(F.col("version") == rules.UNSPECIFIED).alias("n_unspecified"),
    )
    listed = manifests.select("repo_id", F.col("path").alias("manifest_path")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(counts, ["repo_id", "manifest_path"], "left").select(
        "repo_id", "manifest_path", zero("n_direct"), zero("n_vulnerable"), zero("n_unspecified")
    )


def package_vulnerability_ids(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(repo_id, name, version, vuln_id, severity): the advisories behind each
    vulnerable package, manifests and ecosystems merged."""
    declared = (
        deps.where(versions.is_checkable(F.col("name"), F.col("version")))
        .select("repo_id", *KEY).distinct()
    )
    listed = advisories.where("vuln_id IS NOT NULL").select(*KEY, "vuln_id", "severity").distinct()
    return (
        declared.join(listed, KEY)
        .groupBy("repo_id", "name", "version", "vuln_id")
        .agg(F.max(F.when(F.upper("severity") == "CRITICAL", 1).otherwise(0)).alias("critical"))
    )


#: As many package versions with advisories are sent to all tasks that read dependencies.
BROADCAST_KEYS = 200_000


def _advised(keys: DataFrame, advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, version, kind, n, critical): advisories of the package
    versions ``keys``, counted. Those of a name and version that list it in the
    same ecosystems are one kind, which has a row for each of them: whoever
    declares several ecosystems counts a kind once."""
    critical = F.when(F.upper("severity") == "CRITICAL", 1).otherwise(0).alias("critical")
    kinds = Window.partitionBy("name", "version").orderBy("places")
    return (
        advisories.where("vuln_id IS NOT NULL").join(keys, KEY, "left_semi")
        .groupBy("name", "version", "vuln_id")
        .agg(F.array_sort(F.collect_set(F.struct("ecosystem", critical))).alias("places"))
        .groupBy("name", "version", "places").agg(F.count("*").alias("n"))
        .withColumn("kind", F.row_number().over(kinds))
        .select("name", "version", "kind", "n", F.inline("places"))
    )


def vulnerable_package_rollup(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row per vulnerable (repo, package, version) over all manifests.

    Severity starts at HIGH and only an advisory marked CRITICAL at top level
    raises it. Manifest names are base names of the four kinds, so that set
    is bounded; advisory ids stay rows (``package_vulnerability_ids``).

    Advisories are counted before they meet the repositories, and declared
    rows are shuffled once, with a number for the package version. Where few
    versions have advisories, they are sent to all tasks and other rows are not
    shuffled at all. What is written lets go of its shuffles.
    """
    declared = deps.where(F.col("repo_id").isNotNull() & versions.is_checkable(F.col("name"), F.col("version")))
    advised = stage(_advised(stage(declared.select(*KEY).distinct(), "declared"), advisories), "advised")
    few = advised.count() <= BROADCAST_KEYS
    sent = F.broadcast if few else lambda table: table
    hits = sent(stage(advised.select(*KEY).distinct().withColumn("hit", F.monotonically_increasing_id()), "hits"))
    rows = declared.select("repo_id", *KEY, paths.base_name(F.col("manifest_path")).alias("manifest"))
    numbered = (rows if few else rows.distinct()).join(hits, KEY).select("repo_id", "hit", "manifest")
    package = ["repo_id", "name", "version"]
    return (
        stage(numbered.distinct() if few else numbered, "used").join(hits, "hit")
        .groupBy(*package)
        .agg(F.collect_set("ecosystem").alias("ecosystems"), F.array_sort(F.collect_set("manifest")).alias("manifests"))
        .withColumn("ecosystem", F.explode("ecosystems"))
        .join(sent(advised), KEY)
        .groupBy(*package, "kind")
        .agg(F.first("manifests").alias("manifests"), F.first("n").alias("n"), F.max("critical").alias("critical"))
        .groupBy(*package)
        .agg(F.sum("n").alias("vuln_count"), F.max("critical").alias("critical"), F.first("manifests").alias("manifests"))
        .select(
            "repo_id",
            F.col("name").alias("package"),
            "version",
            F.when(F.col("critical") == 1, "CRITICAL").otherwise("HIGH").alias("severity"),
            "vuln_count",
            "manifests",
        )
    )


def recent_lookups(
    requests: DataFrame, lookups: DataFrame, max_age_seconds: int = 86400, bucket_seconds: int = 300
) -> DataFrame:
    """Latest earlier lookup of each request's key, and whether it is younger
    than ``max_age_seconds``.

    Both inputs are (key, ts), ``ts`` an instant. Rows meet per (key, time bucket), so a key
    holding much of the data is spread over its buckets; between buckets only
    their latest lookup is carried on, one row per (key, bucket).
    """
    at = F.col("ts").cast("timestamp")
    requests, lookups = requests.withColumn("ts", at), lookups.withColumn("ts", at)
    bucket = F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)).alias("bucket")
    asked = requests.select(*requests.columns, bucket, F.lit(True).alias("is_request"))
    done = lookups.select("key", "ts", bucket, F.lit(False).alias("is_request"))
    rows = asked.unionByName(done, allowMissingColumns=True).withColumn(
        "done_at", F.when(~F.col("is_request"), F.col("ts"))
    )

    so_far = (
        Window.partitionBy("key", "bucket").orderBy("ts")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = rows.withColumn("in_bucket", F.max("done_at").over(so_far)).where("is_request")

    buckets = rows.groupBy("key", "bucket").agg(F.max("done_at").alias("latest"))
    past = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("key", "bucket", F.max("latest").over(past).alias("carried"))

    found = F.coalesce("in_bucket", "carried")
    age = F.unix_micros("ts") - F.unix_micros("looked_up_at")
    return (
        within.join(carried, ["key", "bucket"])
        .withColumn("looked_up_at", found)
        .withColumn("reused", F.coalesce(age < max_age_seconds * 1_000_000, F.lit(False)))
        .select(*requests.columns, "looked_up_at", "reused")
    )
