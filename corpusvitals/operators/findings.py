"""Combining, deduplicating and ordering findings."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions import paths
from ..schemas import as_findings
from ..session import stage
from . import duplicates, facts as fct, markers, modules, profile, scores, scripts, secrets

FINDING_KEY = ["repo_id", "type", "file", "line", "function", "details", "file_2", "line_2"]


def flag_test_files(findings: DataFrame) -> DataFrame:
    in_test = paths.quality_category(F.col("file")) == "test"
    return findings.withColumn("test_file", F.when(in_test, True))


def dedup_quality_findings(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(FINDING_KEY)


def _severity_order() -> Column:
    return F.coalesce(paths.lookup(rules.FINDING_ORDER, F.col("severity")), F.lit(9))


def finding_order() -> list:
    """HIGH to LOW, then file, line and type; the last columns only make the
    order of equal rows repeatable."""
    text = lambda column: F.coalesce(column, F.lit(""))
    return [_severity_order(), F.col("file"), F.coalesce("line", F.lit(0)), F.col("type"), text("details"), text("function")]


def with_position(rows: DataFrame, *order, partitions: int | None = None) -> DataFrame:
    """``position`` of each row in the whole order, from 1, without one task
    that sees them all.

    Rows are dealt into ranges of the order and sorted there. Each has its
    number within its range when it is written; the sizes of the ranges, one
    row each, give what comes before.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # the upper bits of this number are the partition's, the lower 33 count from 0
    numbered = stage(numbered.withColumn("__n", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = sizes.select("__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .select(*rows.columns, (F.col("__before") + within + 1).alias("position"))
    )


def globally_ranked(findings: DataFrame, partitions: int | None = None) -> DataFrame:
    """``position`` among the findings of all repositories."""
    return with_position(findings, *finding_order(), F.col("repo_id"), partitions=partitions)


def ranked_findings(findings: DataFrame, partitions: int | None = None) -> DataFrame:
    """``rank`` within each repository: its place in the order by repository,
    less that of the repository's first finding."""
    placed = with_position(findings, F.col("repo_id"), *finding_order(), partitions=partitions)
    first = placed.groupBy("repo_id").agg(F.min("position").alias("first"))
    return placed.join(first, "repo_id").select(
        *findings.columns, (F.col("position") - F.col("first") + 1).cast("int").alias("rank")
    )


def order_findings(findings: DataFrame) -> DataFrame:
    """Sorted by repository and ``finding_order``: a range sort."""
    return findings.orderBy("repo_id", *finding_order())


def union_findings(*parts: DataFrame) -> DataFrame:
    """Append findings of any detectors in the common shape."""
    whole = as_findings(parts[0])
    for part in parts[1:]:
        whole = whole.unionByName(as_findings(part))
    return whole


def python_findings(facts: DataFrame) -> list:
    """All Python rules from the facts of one parse."""
    parsed = fct.python_facts(facts)
    functions = modules.python_functions(parsed)
    return [
        modules.unused_python_imports(parsed),
        modules.python_complexity(functions),
        modules.long_functions(functions),
    ]


def script_findings(facts: DataFrame) -> list:
    return [
        scripts.unused_import_findings(facts),
        scripts.js_complexity(fct.script_functions(facts)),
    ]


def local_quality_findings(facts: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Everything that needs one file at a time (all but duplicate blocks)."""
    return union_findings(
        profile.flag_large(facts.select("repo_id", "path", "lines"), thresholds),
        markers.marker_findings(facts),
        *python_findings(facts),
        *script_findings(facts),
    )


def quality_findings(facts: DataFrame, thresholds: DataFrame | None = None, pairs: bool = False) -> DataFrame:
    """All quality findings, flagged and deduplicated, from written ``code_facts``.
    Duplicates come per member of a class of copies and per pair of classes, with the number of file pairs in ``occurrences``;
    with ``pairs`` each file pair is a finding of its own."""
    comparable = duplicates.comparable_facts(facts)
    found = duplicates.blocks(comparable) if pairs else duplicates.class_blocks(comparable, members=True)
    return _with_blocks(facts, thresholds, found)


def _with_blocks(facts: DataFrame, thresholds: DataFrame | None, found: DataFrame) -> DataFrame:
    local = flag_test_files(local_quality_findings(facts, thresholds))
    # duplicates have a row for each pair already
    return dedup_quality_findings(local).unionByName(flag_test_files(as_findings(duplicates.block_findings(found))))


def quality_counts(facts: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """(repo_id, type, severity, n) of ``quality_findings``, with pairs of duplicates counted, not listed."""
    local = dedup_quality_findings(local_quality_findings(facts, thresholds))
    return scores.finding_counts(local).unionByName(
        scores.duplicate_counts(duplicates.pair_counts(duplicates.comparable_facts(facts)))
    )


def first_quality_findings(facts: DataFrame, k: int, thresholds: DataFrame | None = None) -> DataFrame:
    """Quality findings with as many file pairs of duplicates as the first ``k`` in order can need."""
    return _with_blocks(facts, thresholds, duplicates.first_blocks(duplicates.comparable_facts(facts), k))


def secret_findings(facts: DataFrame, placeholders: DataFrame | None = None) -> DataFrame:
    """Deduplicated secrets from written ``code_facts``."""
    return secrets.dedup_secret_findings(secrets.judged_secrets(secrets.located_secrets(facts), placeholders))


def script_quality_findings(facts: DataFrame) -> DataFrame:
    """The script-only subset."""
    return dedup_quality_findings(union_findings(*script_findings(facts)))
