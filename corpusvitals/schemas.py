"""Column sets shared by the operators."""

from pyspark.sql import DataFrame, functions as F

FINDING_SCHEMA = """
    repo_id string, domain string, type string, file string, line int,
    function string, file_2 string, line_2 int, severity string, priority string,
    confidence int, details string, why string, recommendation string,
    lines int, threshold int, over_percentage double, complexity int,
    duplicate_lines int, similarity double, file_category string,
    test_file boolean, package string, version string, vuln_count int,
    occurrences long
"""

FINDING_COLUMNS = {
    name: dtype
    for name, dtype in (
        field.split() for field in FINDING_SCHEMA.replace("\n", " ").split(",")
    )
}

FILES_SCHEMA = "repo_id string, path string, size_bytes long, content string"
DEPENDENCY_SCHEMA = (
    "repo_id string, manifest_path string, ecosystem string, name string, version string"
)
ADVISORY_SCHEMA = (
    "ecosystem string, name string, version string, vuln_id string, "
    "severity string, db_severity string"
)
ADVISORY_RANGE_SCHEMA = (
    "ecosystem string, name string, low string, high string, closed boolean, "
    "vuln_id string, severity string, db_severity string"
)
REGISTRY_SCHEMA = "ecosystem string, name string, latest string"
COMMIT_SCHEMA = (
    "repo_id string, commit_id string, author_name string, author_email string, "
    "ts timestamp, subject string"
)
BRANCH_SCHEMA = "repo_id string, name string"
LOOKUP_SCHEMA = "key string, ts timestamp"


def occurrences(findings: DataFrame):
    """How many findings a row stands for: pairs of files in two classes of copies are one row."""
    return F.coalesce("occurrences", F.lit(1)) if "occurrences" in findings.columns else F.lit(1)


def as_findings(df: DataFrame) -> DataFrame:
    """Project to the finding columns; missing ones become typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(dtype).alias(name)
            for name, dtype in FINDING_COLUMNS.items()
        ]
    )
