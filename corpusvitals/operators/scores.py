"""Scores per repository."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import paths
from ..schemas import occurrences


def security_score(repos: DataFrame, findings: DataFrame, scored_types=None) -> DataFrame:
    """100 minus capped penalties for secrets and vulnerable packages.

    The same package version counts once per repository, with its largest
    advisory count. Repositories without findings keep 100.
    """
    scored = list(scored_types or rules.SCORED_SECRET_TYPES)
    vulnerable = (F.col("type") == "Vulnerable Dependency") & (F.col("vuln_count") > 0)
    package = F.when(vulnerable, F.nullif(F.col("package"), F.lit("")))
    per_package = (
        findings.select(
            "repo_id",
            package.alias("package"),
            F.when(package.isNotNull(), F.coalesce("version", F.lit(rules.UNSPECIFIED))).alias("version"),
            F.when(package.isNotNull(), F.col("vuln_count")).alias("vuln_count"),
            F.col("type").isin(scored).cast("long").alias("is_secret"),
        )
        .groupBy("repo_id", "package", "version")
        .agg(F.max("vuln_count").alias("vuln_count"), F.sum("is_secret").alias("n_secrets"))
    )
    totals = per_package.groupBy("repo_id").agg(
        F.sum("n_secrets").alias("n_secrets"),
        F.count("package").alias("n_packages"),
        F.coalesce(F.sum("vuln_count"), F.lit(0)).alias("n_vulns"),
    )
    packages, extra = F.col("n_packages"), F.col("n_vulns") - F.col("n_packages")
    penalty = (
        F.least(F.col("n_secrets") * 15, F.lit(60))
        + F.when(packages > 0, F.least((packages - 1) * 8 + 12, F.lit(40))).otherwise(0)
        + F.greatest(F.least(extra * 2, F.lit(20)), F.lit(0))
    )
    return (
        repos.select("repo_id").distinct()
        .join(totals.select("repo_id", penalty.alias("penalty")), "repo_id", "left")
        .select(
            "repo_id",
            F.greatest(100 - F.coalesce("penalty", F.lit(0)), F.lit(0)).cast("int").alias("security"),
        )
    )


def _scored_severity() -> Column:
    upper = F.upper(F.coalesce("severity", F.lit("LOW")))
    return F.when(upper.isin(list(rules.QUALITY_WEIGHTS)), upper).otherwise("LOW")


def _weight(severity: Column, kind: Column) -> Column:
    light = paths.lookup(rules.LIGHT_LOW_WEIGHTS, kind)
    return (
        F.when(kind == "Large File", paths.lookup(rules.LARGE_FILE_WEIGHTS, severity))
        .when((severity == "LOW") & light.isNotNull(), light)
        .otherwise(paths.lookup(rules.QUALITY_WEIGHTS, severity))
    )


def quality_deductions(findings: DataFrame) -> DataFrame:
    """The itemised breakdown: every finding with the points that each of its occurrences costs."""
    kind = F.coalesce("type", F.lit("Quality issue"))
    return findings.select(
        "repo_id", "file", "line", kind.alias("type"), "details",
        _scored_severity().alias("severity"), occurrences(findings).alias("occurrences"),
    ).withColumn("deduction", _weight(F.col("severity"), F.col("type")))


def finding_counts(findings: DataFrame) -> DataFrame:
    """(repo_id, type, severity, n): all the quality score needs to know."""
    kind = F.coalesce("type", F.lit("Quality issue")).alias("type")
    return findings.groupBy("repo_id", kind, _scored_severity().alias("severity")).agg(
        F.sum(occurrences(findings)).alias("n")
    )


def duplicate_counts(pair_counts: DataFrame) -> DataFrame:
    """``duplicate_pair_counts`` in the shape of ``finding_counts``."""
    return pair_counts.select(
        "repo_id",
        F.lit("Duplicate Code").alias("type"),
        F.lit("LOW").alias("severity"),
        F.col("n_pairs").alias("n"),
    )


def _with_weight(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Add ``weight``; ``weights`` (repo_id, type, severity, weight) replaces some of the rules' in a repository."""
    given = _weight(F.col("severity"), F.col("type"))
    if weights is None:
        return rows.withColumn("weight", given)
    own = weights.select("repo_id", "type", "severity", F.col("weight").alias("own"))
    return rows.join(own, ["repo_id", "type", "severity"], "left").withColumn("weight", F.coalesce("own", given)).drop("own")


def quality_score(repos: DataFrame, counts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Score, capped deduction and its split by severity.

    Beyond the cap the split is scaled to it, half to even, and the rounding
    remainder goes to HIGH.
    """
    cap = F.lit(rules.MAX_QUALITY_DEDUCTION)
    totals = (
        _with_weight(counts, weights).withColumn("points", F.col("n") * F.col("weight"))
        .groupBy("repo_id")
        .agg(
            *[
                F.sum(F.when(F.col("severity") == s, F.col("points")).otherwise(0)).alias(s.lower())
                for s in rules.QUALITY_WEIGHTS
            ]
        )
    )
    rows = repos.select("repo_id").distinct().join(totals, "repo_id", "left").fillna(
        0, ["high", "medium", "low"]
    )
    raw = F.col("high") + F.col("medium") + F.col("low")
    over = F.col("raw_deduction") > cap
    scaled = lambda c: F.rint(F.col(c) * (F.lit(50.0) / F.col("raw_deduction"))).cast("long")
    fitted = lambda c: F.when(over, scaled(c)).otherwise(F.col(c))
    high = F.when(over, cap - scaled("medium") - scaled("low")).otherwise(F.col("high"))
    return (
        rows.withColumn("raw_deduction", raw)
        .select(
            "repo_id",
            (100 - F.least("raw_deduction", cap)).cast("int").alias("quality"),
            high.cast("long").alias("deduct_high"),
            fitted("medium").alias("deduct_medium"),
            fitted("low").alias("deduct_low"),
            F.least("raw_deduction", cap).cast("long").alias("total_deduction"),
            "raw_deduction",
        )
    )


def documentation_score(listing: DataFrame) -> DataFrame:
    """100 with a readme in the root, else 30; over all files, not only
    source files."""
    is_readme = F.lower("path").isin(rules.README_NAMES)
    return listing.groupBy("repo_id").agg(
        F.when(F.bool_or(is_readme), 100).otherwise(30).alias("documentation")
    )


def overall_score(security: DataFrame, quality: DataFrame, documentation: DataFrame) -> DataFrame:
    w = rules.OVERALL_WEIGHTS
    blended = (
        F.col("security") * w["security"]
        + F.col("quality") * w["quality"]
        + F.col("documentation") * w["documentation"]
    )
    # a repository without any file has no readme either
    documented = documentation.select("repo_id", F.col("documentation").alias("found"))
    return (
        security.join(quality, "repo_id").join(documented, "repo_id", "left")
        .withColumn("documentation", F.coalesce("found", F.lit(30))).drop("found")
        .withColumn("overall", F.rint(blended).cast("int"))
    )
