"""Declared versions against the latest release."""

from pyspark.sql import DataFrame, functions as F

from ..functions import versions


def outdated_dependencies(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Only npm and PyPI; rows exist only where a newer release is known."""
    current = versions.version_triple(F.col("version"))
    latest = versions.version_triple(F.col("latest"))
    declared = deps.where(
        F.col("ecosystem").isin("npm", "PyPI")
        & versions.is_checkable(F.col("name"), F.col("version"))
        & current.isNotNull()
    )
    released = registry.where(F.col("ecosystem").isin("npm", "PyPI") & latest.isNotNull())
    severity = (
        F.when(F.col("l.major") > F.col("c.major"), "HIGH")
        .when(F.col("l.minor") > F.col("c.minor"), "MEDIUM")
        .otherwise("LOW")
    )
    return (
        declared.join(released, ["ecosystem", "name"])
        .withColumns({"c": current, "l": latest})
        .where(F.col("l") > F.col("c"))
        .select(
            "repo_id", "manifest_path", "ecosystem", "name",
            F.col("version").alias("current"), "latest", severity.alias("severity"),
        )
    )
