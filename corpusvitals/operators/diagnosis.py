"""Severity-ranked diagnosis."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import rules
from ..functions import paths
from ..schemas import occurrences

GROUP = ["repo_id", "severity", "category", "type"]


def _issues(findings: DataFrame, category: str, fallback: str) -> DataFrame:
    upper = F.upper(F.coalesce("severity", F.lit("LOW")))
    return findings.select(
        "repo_id",
        F.when(upper.isin(rules.DIAGNOSIS_SEVERITIES), upper).otherwise("LOW").alias("severity"),
        F.lit(category).alias("category"),
        F.coalesce("type", F.lit(fallback)).alias("type"),
        "file",
        "line",
        F.coalesce("details", F.lit("")).alias("details"),
        occurrences(findings).cast("long").alias("occurrences"),
    )


def diagnosis(secrets: DataFrame, quality: DataFrame, packages: DataFrame) -> DataFrame:
    """Secrets, quality findings and the package rollup under one scheme."""
    count = F.col("vuln_count")
    noun = F.when(count == 1, "advisory").otherwise("advisories")
    declared = F.when(
        F.size("manifests") > 0,
        F.concat(F.lit(" for what is declared in "), F.array_join("manifests", ", ")),
    ).otherwise("")
    dependency = packages.select(
        "repo_id", "severity",
        F.lit("Dependency Security").alias("category"),
        F.lit("Vulnerable Dependency").alias("type"),
        "package", "version", "vuln_count", "manifests",
        F.concat(
            F.concat_ws(" ", "package", F.concat("version", F.lit(":")), count.cast("string"), noun),
            declared,
        ).alias("details"),
        F.lit(1).cast("long").alias("occurrences"),
    )
    return (
        _issues(secrets, "Security", "Security issue")
        .unionByName(_issues(quality, "Code Quality", "Quality issue"))
        .unionByName(dependency, allowMissingColumns=True)
    )


def diagnosis_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(*GROUP).agg(F.sum(occurrences(issues)).alias("n"))


def counts_of(secrets: DataFrame, quality_counts: DataFrame, packages: DataFrame) -> DataFrame:
    """``diagnosis_counts`` without the issues: quality comes as
    ``findings.quality_counts``, which lists no pairs of duplicates."""
    listed = diagnosis_counts(diagnosis(secrets, secrets.where(F.lit(False)), packages))
    quality = quality_counts.select(
        "repo_id", "severity", F.lit("Code Quality").alias("category"), "type", "n"
    )
    return listed.unionByName(quality.groupBy(*GROUP).agg(F.sum("n").alias("n")))


def ranked_counts(counts: DataFrame) -> DataFrame:
    """``rank`` of each group within its repository: by severity, then category and type."""
    order = Window.partitionBy("repo_id").orderBy(severity_rank(F.col("severity")), "category", "type")
    return counts.withColumn("rank", F.row_number().over(order))


def diagnosis_top(issues: DataFrame, k: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """The first ``k`` entries of every group and how many are left out.

    With ``counts``, ``issues`` need hold no more than the first ``k`` of a
    group (``findings.first_quality_findings``). Counting and ranking are separate on purpose: a bare ``row_number <= k``
    lets Spark cut every group to ``k`` rows before the shuffle.
    """
    order = [F.asc_nulls_last(c) for c in ("file", "line", "package", "version", "details")]
    ranked = (
        issues.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order)))
        .where(F.col("rank") <= k)
    )
    return ranked.join(diagnosis_counts(issues) if counts is None else counts, GROUP).select(
        *GROUP, "rank", "file", "line", "package", "version", "vuln_count", "details",
        F.greatest(F.col("n") - k, F.lit(0)).alias("n_more"),
    )


def severity_rank(severity):
    order = {s: i for i, s in enumerate(rules.DIAGNOSIS_SEVERITIES)}
    return paths.lookup(order, severity)


def recommended_actions(counts: DataFrame) -> DataFrame:
    """Actions in fixed order from ``diagnosis_counts``; a repository without
    issues has no row."""
    severity, kind = F.col("severity"), F.col("type")
    tests = {
        "critical": severity == "CRITICAL",
        "dependency": (severity == "HIGH") & (F.col("category") == "Dependency Security"),
        "complexity": (severity != "LOW") & kind.contains("Complexity"),
        "large_file": kind == "Large File",
        "duplicate": kind == "Duplicate Code",
    }
    seen = counts.groupBy("repo_id").agg(*[F.bool_or(t).alias(n) for n, t in tests.items()])
    wanted = F.array_compact(
        F.array(*[F.when(F.col(n), F.lit(rules.ACTIONS[n])) for n in tests])
    )
    chosen = F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit(rules.ACTIONS["default"])))
    return seen.select("repo_id", F.posexplode(chosen).alias("i", "action")).select(
        "repo_id", (F.col("i") + 1).alias("position"), "action"
    )
