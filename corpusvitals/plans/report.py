"""The whole report: every section as a table."""

from dataclasses import dataclass
import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import (
    advisories as adv, commits as git, diagnosis as diag, duplicates as dup, facts as fct, findings as fnd,
    freshness, manifests as man, profile, scores,
)
from ..session import dropped_shuffles, stage
from ..sources import config

#: Entries of a group that the report lists.
TOP = 5


@dataclass
class Inputs:
    """Tables of one run. ``listing`` holds every file of every tree; the
    others may be left out. ``repos`` names repositories that must have rows
    even if they hold no file; without it they are those of the listing.

    Listing and files are read several times: a lazy walk of trees should be
    written first (``session.stage``).
    """

    listing: DataFrame
    files: DataFrame
    manifests: DataFrame | None = None
    configs: DataFrame | None = None
    advisories: DataFrame | None = None
    advisory_ranges: DataFrame | None = None
    registry: DataFrame | None = None
    commits: DataFrame | None = None
    branches: DataFrame | None = None
    repos: DataFrame | None = None
    #: Rules of single repositories: (repo_id, type, keywords), (repo_id, word), (repo_id, type, severity, weight).
    secret_overrides: DataFrame | None = None
    placeholders: DataFrame | None = None
    weights: DataFrame | None = None


def score_table(
    repos: DataFrame, listing: DataFrame, security: DataFrame, quality_counts: DataFrame,
    weights: DataFrame | None = None,
) -> DataFrame:
    return scores.overall_score(
        scores.security_score(repos, security),
        scores.quality_score(repos, quality_counts, weights),
        scores.documentation_score(listing),
    )


def build_report(inputs: Inputs) -> dict[str, DataFrame]:
    """Section name -> table.

    The texts are read once, for the table of facts; facts and findings feed
    several sections, so they are written and read back.
    """
    named = inputs.listing if inputs.repos is None else inputs.repos
    repos = named.select("repo_id").distinct()
    facts = stage(fct.code_facts(inputs.files, inputs.secret_overrides), "facts")
    sections: dict[str, DataFrame] = {
        "languages": profile.ranked_languages(profile.language_profile(facts)),
        "corpus_size": profile.size_of(facts),
    }

    thresholds = None
    if inputs.configs is not None:
        sections["thresholds"] = config.resolve_thresholds(repos, inputs.configs)
        thresholds = config.configured_thresholds(inputs.configs)

    secret = stage(fnd.union_findings(fnd.secret_findings(facts, inputs.placeholders)), "secrets")
    comparable = dup.comparable_facts(facts)
    matches = stage(dup.class_matches(comparable), "matches")
    local = stage(fnd.dedup_quality_findings(fnd.flag_test_files(fnd.local_quality_findings(facts, thresholds))), "local")
    with_blocks = lambda found: fnd.union_findings(local, fnd.flag_test_files(dup.block_findings(found)))
    quality = with_blocks(stage(dup.class_blocks(comparable, matches), "blocks"))
    first = with_blocks(dup.first_blocks(comparable, TOP, matches))
    sections["duplicate_classes"] = dup.class_members(comparable).where("n_files > 1")
    security = secret
    packages = None
    if inputs.manifests is not None:
        deps = stage(man.dependencies(inputs.manifests), "dependencies")
        sections["dependencies"] = deps
        advisories = inputs.advisories
        if advisories is not None and inputs.advisory_ranges is not None:
            advisories = stage(adv.with_ranges(deps, advisories, inputs.advisory_ranges), "advisories")
        if advisories is not None:
            results = stage(adv.dependency_vulnerabilities(deps, advisories), "results")
            security = fnd.union_findings(secret, adv.vulnerable_findings(results))
            packages = adv.vulnerable_package_rollup(deps, advisories)
            sections["dependency_results"] = results
            sections["dependency_summary"] = adv.dependency_summary(results)
            sections["manifests"] = adv.manifest_summary(inputs.manifests, results)
            sections["package_vulnerabilities"] = adv.package_vulnerability_ids(deps, advisories)
        if inputs.registry is not None:
            sections["outdated"] = freshness.outdated_dependencies(deps, inputs.registry)
    if packages is None:
        packages = _no_packages(repos)

    sections["security_findings"] = security
    sections["quality_findings"] = quality
    sections["quality_deductions"] = scores.quality_deductions(quality)
    sections["scores"] = score_table(
        repos, inputs.listing, security, scores.finding_counts(quality), inputs.weights
    )
    issues = stage(diag.diagnosis(secret, quality, packages), "diagnosis")
    counts = diag.diagnosis_counts(issues)
    sections["diagnosis"] = issues
    sections["diagnosis_counts"] = counts
    sections["diagnosis_top"] = diag.diagnosis_top(diag.diagnosis(secret, first, packages), TOP, counts)
    sections["actions"] = diag.recommended_actions(counts)
    if inputs.commits is not None and inputs.branches is not None:
        sections["commit_health"] = git.commit_health(repos, inputs.commits, inputs.branches)
    return sections


def _no_packages(repos: DataFrame) -> DataFrame:
    return repos.where(F.lit(False)).select(
        "repo_id",
        *[
            F.lit(None).cast(t).alias(c)
            for c, t in {
                "package": "string", "version": "string", "severity": "string",
                "vuln_count": "long", "manifests": "array<string>",
            }.items()
        ],
    )


def quick_scores(
    listing: DataFrame, facts: DataFrame, security: DataFrame,
    thresholds: DataFrame | None = None, repos: DataFrame | None = None,
) -> DataFrame:
    """Scores from written facts, without listing duplicate pairs: those are only counted."""
    named = listing if repos is None else repos
    return score_table(
        named.select("repo_id").distinct(), listing, security, fnd.quality_counts(facts, thresholds)
    )


def write_report(sections: dict[str, DataFrame], out_dir: str, run: str = "0", format: str = "parquet") -> None:
    """Write the sections of one run, by severity where they have it.

    Runs stand side by side in folders ``section/run=...`` and replace
    nothing but their own earlier attempt. A run counts once its manifest is
    written, at the end: the sections with their schemas and numbers of rows,
    and the repositories that the run covers. ``read_section`` takes each
    repository from the last run that covers it, by the order of run names.
    """
    spark = next(iter(sections.values())).sparkSession
    rows, written = [], {}
    for name, table in sections.items():
        writer = table.write.mode("overwrite").format(format)
        if "severity" in table.columns:
            writer = writer.partitionBy("severity")
        path = f"{out_dir}/{name}/run={run}"
        with dropped_shuffles(spark):
            writer.save(path)
        written[name] = spark.read.format(format).schema(table.schema).load(path)
        rows.append((name, written[name].count(), format, table.schema.json()))
    covered = written["scores"].select("repo_id").distinct()
    covered.write.mode("overwrite").parquet(f"{out_dir}/covered/run={run}")
    manifest = spark.createDataFrame(rows, "section string, n_rows long, format string, schema string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out_dir}/manifest/run={run}")


_MANIFEST = "section string, n_rows long, format string, schema string, run string"


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(section, n_rows, format, schema, run) of the runs that were written to their end."""
    return spark.read.schema(_MANIFEST).json(f"{out_dir}/manifest")


def read_section(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A section as the last finished runs have it, with the run in ``run``."""
    manifest = read_manifest(spark, out_dir)
    known = manifest.where(F.col("section") == name).orderBy(F.desc("run")).first()
    if known is None:
        raise ValueError(f"no finished run has a section {name!r}")
    schema = T.StructType.fromJson(json.loads(known.schema)).add("run", "string")
    covered = spark.read.schema("repo_id string, run string").parquet(f"{out_dir}/covered")
    finished = covered.join(manifest.select("run").distinct(), "run", "left_semi")
    latest = finished.groupBy("repo_id").agg(F.max("run").alias("run"))
    rows = spark.read.format(known.format).schema(schema).load(f"{out_dir}/{name}")
    return rows.join(latest, ["repo_id", "run"], "left_semi")


def as_json(table: DataFrame, ignore_nulls: bool = True) -> DataFrame:
    """Rows as JSON documents; NULL fields are left out unless asked for."""
    options = {"ignoreNullFields": str(ignore_nulls).lower()}
    return table.select(F.to_json(F.struct(*table.columns), options).alias("json"))
