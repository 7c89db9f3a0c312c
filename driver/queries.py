"""The registered queries: every operator over whole driver tables."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusvitals import rules
from corpusvitals.functions import paths, text as tx, versions
from corpusvitals.operators import (
    advisories as adv, commits as git, diagnosis as diag, duplicates as dup,
    facts as fct, findings as fnd, freshness, manifests as man, markers, modules, profile,
    scores, scripts, secrets,
)
from corpusvitals.plans import report
from corpusvitals.session import stage, track, work_dir
from corpusvitals.sources import config, files, snapshots
from corpusvitals.streaming import scan
from . import adapters as a

# the driver's texts are short: this stands in for the configured thresholds
SHORT_LINES = 20

REPORT_KEYS = ["repo_id", "type", "file", "line", "severity", "confidence", "details"]


class Tables:
    """Lazily loaded views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return a.load(self._spark, self._dir, getattr(a, name.upper()))


def query(build):
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def facts_of(files: DataFrame) -> DataFrame:
    """The one pass over the texts, written."""
    return stage(fct.code_facts(files), "facts")


def short_thresholds(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct().select(
        "repo_id",
        F.explode(F.array(*[F.lit(k) for k in ("python", "javascript", "css", "html")])).alias("language_key"),
        F.lit(SHORT_LINES).alias("max_lines"),
    )


# --- scans and classification ---------------------------------------------------

def file_type_profile(t):
    return (
        t.listing.select("repo_id", paths.file_type(F.col("path")).alias("file_type"))
        .groupBy("repo_id", "file_type").agg(F.count("*").alias("n_files"))
    )


def category(column):
    def build(t):
        return profile.classify(t.listing).select("repo_id", "path", F.col(column).alias("category"))

    return build


def ignored_paths_anti(t):
    """Files outside ignored folders, written as an anti join."""
    folders = t.listing.select(
        "repo_id", "path", F.explode(paths.directories(F.col("path"))).alias("folder")
    )
    ignored = folders.where(F.col("folder").isin(rules.IGNORED_DIRECTORIES))
    return t.listing.select("repo_id", "path").join(ignored, ["repo_id", "path"], "left_anti")


def line_counts(t):
    return t.files_breaks.select(
        "repo_id", "path",
        tx.read_line_count(F.col("content")).cast("long").alias("n_read"),
        tx.split_line_count(F.col("content")).cast("long").alias("n_split"),
    )


def corpus_size(t):
    return profile.corpus_size(t.files_decorated)


def large_files(t):
    return profile.large_files(t.files_decorated, short_thresholds(t.files_decorated)).select(
        "repo_id", "file", "severity", "lines", "threshold", "over_percentage"
    )


def large_files_by_type(t):
    """Limits that differ by type and repository, from configuration files."""
    limits = config.configured_thresholds(t.repo_configs)
    return profile.large_files(t.files_typed, limits).select("repo_id", "file", "severity", "lines", "threshold", "details")


# --- secrets and markers ------------------------------------------------------------

def placeholder_filter(t):
    return secrets.secret_matches(t.files_decorated).select(
        "repo_id", "file", "line", "type", secrets.is_placeholder(F.col("value")).alias("placeholder")
    )


def secret_confidence(t):
    return secrets.secret_matches(t.files_decorated).select(
        "repo_id", "file", "line", "type",
        secrets.confidence(F.col("type"), F.col("value")).alias("confidence"),
    )


def secret_input_suppression(t):
    return secrets.secret_matches(t.files_decorated).select(
        "repo_id", "file", "line", "type", "suppressed"
    )


def secret_scan(files):
    def build(t):
        return secrets.scan_secrets(getattr(t, files)).select(*REPORT_KEYS, "file_category")

    return build


def secret_scan_overrides(t):
    """Repositories with patterns and placeholder words of their own."""
    found = secrets.scan_secrets(t.files_decorated, t.secret_overrides.drop("m"), t.placeholders)
    return found.select(*REPORT_KEYS, "file_category")


def secret_findings_dedup(t):
    repeated = secrets.secret_findings(t.files_decorated)
    return secrets.dedup_secret_findings(repeated.unionByName(repeated)).select(
        "repo_id", "type", "file", "line", "confidence"
    )


def work_markers(t):
    return markers.work_markers(t.files_decorated).select(*REPORT_KEYS)


# --- duplicates -----------------------------------------------------------------------

def normalized_lines(t):
    return dup.normalized_lines(t.files_decorated)


def sliding_blocks(t):
    """Windows summed up per file: hashes differ between engines."""
    return (
        dup.sliding_blocks(t.files_by_lang)
        .groupBy("repo_id", "path")
        .agg(
            F.count("*").alias("n_blocks"),
            F.sum("line_no").alias("sum_line_no"),
            F.max("pos").cast("long").alias("last_pos"),
            F.max(F.size("hashes")).cast("long").alias("width"),
        )
    )


def duplicate_blocks(t):
    return dup.duplicate_blocks(t.files_by_lang)


def duplicate_members(t):
    return dup.class_members(dup.staged_files(t.files_by_lang))


def duplicate_first_pairs(t):
    return dup.first_blocks(dup.staged_files(t.files_by_lang), 3)


def duplicate_pair_counts(t):
    return dup.duplicate_pair_counts(t.files_by_lang)


# --- dependencies -----------------------------------------------------------------------

def clean_versions(t):
    raw = F.concat(F.lit("^"), "version", F.lit("-rc.1 || x"))
    return t.deps.select("name", raw.alias("raw")).distinct().select(
        "name", "raw", versions.clean_npm_version(F.col("raw")).alias("cleaned")
    )


def version_triple(t):
    triple = versions.version_triple(F.col("version"))
    return t.deps.select("version").distinct().select("version", triple.alias("t")).select(
        "version", *[F.col(f"t.{c}.digits").cast("long").alias(c) for c in ("major", "minor", "patch")]
    )


def results(t):
    return adv.dependency_vulnerabilities(man.dedup_dependencies(t.deps), t.advisories)


def max_vuln_severity(t):
    return adv.advisory_summary(t.advisories)


def manifest_summary(t):
    manifests = t.deps.select("repo_id", F.col("manifest_path").alias("path"))
    return adv.manifest_summary(manifests, results(t))


def package_rollup(t):
    return adv.vulnerable_package_rollup(t.deps, t.advisories).withColumn(
        "manifests", F.array_join("manifests", ",")
    )


def outdated(t):
    return freshness.outdated_dependencies(man.dedup_dependencies(t.deps), t.registry)


def lookup_reuse(t):
    return adv.recent_lookups(t.requests, t.lookups).select("key", "event_id", "reused")


# --- code facts -----------------------------------------------------------------------------

def js_stripped(t):
    return scripts.script_files(t.files_code).select(
        "repo_id", "path", scripts.strip_comments_and_strings(F.col("content")).alias("stripped")
    )


def js_complexity(t):
    return scripts.js_complexity(scripts.js_functions(t.files_code)).select(
        *REPORT_KEYS, "function", "complexity"
    )


def python_functions(t):
    return modules.python_functions(modules.python_facts(t.files_code))


def python_complexity(t):
    return modules.python_complexity(python_functions(t)).select(*REPORT_KEYS, "function", "complexity")


def long_functions(t):
    return modules.long_functions(python_functions(t)).select(*REPORT_KEYS, "function", "lines")


def unused_python_imports(t):
    return modules.unused_python_imports(modules.python_facts(t.files_code)).select(*REPORT_KEYS)


def unused_js_imports(t):
    return scripts.unused_js_imports(t.files_code).select(*REPORT_KEYS)


# --- findings, scores, diagnosis ----------------------------------------------------------------

def all_files(t):
    """Decorated texts and code side by side, in repositories of their own."""
    code = t.files_code.withColumn("repo_id", F.concat(F.lit("code-"), "repo_id"))
    return t.files_decorated.unionByName(code)


def quality(t):
    facts = facts_of(all_files(t))
    return fnd.quality_findings(facts, short_thresholds(facts))


def quality_findings(t):
    return quality(t).select(*REPORT_KEYS, "function", "file_2", "line_2", "test_file", F.coalesce("occurrences", F.lit(1)).alias("occurrences"))


def js_quality_findings(t):
    return fnd.script_quality_findings(facts_of(t.files_code)).select(*REPORT_KEYS, "function")


def findings_dedup(t):
    found = fnd.union_findings(markers.work_markers(t.files_decorated))
    return fnd.dedup_quality_findings(found.unionByName(found)).select("repo_id", "type", "file", "line")


def findings_test_flag(t):
    found = fnd.flag_test_files(fnd.union_findings(markers.work_markers(t.files_decorated)))
    return found.groupBy("repo_id", "type", F.coalesce("test_file", F.lit(False)).alias("test_file")).agg(
        F.count("*").alias("n")
    )


def code_findings(t):
    facts = facts_of(t.files_code)
    return fnd.dedup_quality_findings(
        fnd.union_findings(*fnd.python_findings(facts), *fnd.script_findings(facts))
    )


def findings_ordered(t):
    return fnd.ranked_findings(code_findings(t)).select(*REPORT_KEYS, "rank")


def findings_global_rank(t):
    return fnd.globally_ranked(code_findings(t)).select(*REPORT_KEYS, "position")


def security_findings(t):
    """Secrets and vulnerable dependencies; the n-th text source and the n-th
    dependency repository are taken as one."""
    found = fnd.union_findings(
        secrets.scan_secrets(t.files_decorated), adv.vulnerable_findings(results(t))
    )
    return found.withColumn("repo_id", F.regexp_replace("repo_id", "^(src|repo)", "r"))


def all_security_findings(t):
    return security_findings(t).select(
        "repo_id", "type", "file", "line", "severity", "confidence", "package", "version", "vuln_count"
    )


def security_score(t):
    found = security_findings(t)
    return scores.security_score(found, found)


def quality_scores(t):
    facts = facts_of(all_files(t))
    return scores.quality_score(facts, fnd.quality_counts(facts, short_thresholds(facts)))


def quality_score(t):
    return quality_scores(t).select("repo_id", "quality", "total_deduction", "raw_deduction")


def quality_breakdown(t):
    return quality_scores(t).select("repo_id", "deduct_high", "deduct_medium", "deduct_low")


def quality_deductions(t):
    return scores.quality_deductions(quality(t)).groupBy("repo_id", "type", "severity", "deduction").agg(
        F.sum("occurrences").alias("n")
    )


def overall_health(t):
    files = all_files(t)
    listing = files.select("repo_id", "path").unionByName(
        t.roots.select(F.regexp_replace("repo_id", "^repo", "src").alias("repo_id"), "path")
    ).join(files.select("repo_id").distinct(), "repo_id", "left_semi")
    facts = facts_of(files)
    security = fnd.union_findings(fnd.secret_findings(facts))
    return report.quick_scores(listing, facts, security, short_thresholds(facts)).select(
        "repo_id", "security", "quality", "documentation", "overall"
    )


def packages(t):
    return adv.vulnerable_package_rollup(t.deps, t.advisories)


def text_secrets(facts):
    """Secrets of the decorated texts; code stands in repositories of its own."""
    return fnd.secret_findings(facts.where(~F.col("repo_id").startswith("code-")))


def issues(t):
    facts = facts_of(all_files(t))
    found = fnd.quality_findings(facts, short_thresholds(facts), pairs=True)
    return diag.diagnosis(text_secrets(facts), found, packages(t))


def issue_counts(t):
    facts = facts_of(all_files(t))
    counted = fnd.quality_counts(facts, short_thresholds(facts))
    return diag.counts_of(text_secrets(facts), counted, packages(t))


def diagnosis(t):
    return issues(t).select(
        "repo_id", "severity", "category", "type", "file", "details", "package", "version", "vuln_count", "occurrences"
    )


def diagnosis_top(t):
    facts = facts_of(all_files(t))
    limits, k = short_thresholds(facts), report.TOP
    comparable = dup.comparable_facts(facts)
    matches = stage(dup.class_matches(comparable), "matches")
    local = stage(fnd.dedup_quality_findings(fnd.local_quality_findings(facts, limits)), "local")
    first = fnd.union_findings(local, dup.block_findings(dup.first_blocks(comparable, k, matches)))
    counted = scores.finding_counts(local).unionByName(scores.duplicate_counts(dup.pair_counts(comparable, matches)))
    # both are listed and counted
    found, vulnerable = stage(text_secrets(facts), "secrets"), stage(packages(t), "packages")
    return diag.diagnosis_top(diag.diagnosis(found, first, vulnerable), k, diag.counts_of(found, counted, vulnerable)).select(
        *diag.GROUP, "rank", "file", "line", "package", "version", "n_more"
    )


def report_json(t):
    found = secrets.scan_secrets(t.files_decorated).select(*REPORT_KEYS)
    return report.as_json(found)


def report_written(t):
    """The whole report, written twice and read back; rows of some sections by repository."""
    listing = all_files(t).select("repo_id", "path")
    limits = F.lit(json.dumps({"thresholds": dict.fromkeys(("python", "javascript", "css", "html"), SHORT_LINES)}))
    configs = listing.select("repo_id").distinct().select("repo_id", limits.alias("content"))
    sections = report.build_report(report.Inputs(listing=listing, files=all_files(t), configs=configs))
    kept = {"scores": F.lit(1), "languages": F.lit(1), "security_findings": F.lit(1), "quality_findings": F.coalesce("occurrences", F.lit(1)),
            "diagnosis_counts": F.col("n"), "actions": F.lit(1)}
    spark = t.files_decorated.sparkSession
    out = track(spark, work_dir(spark, "report"))
    for _ in range(2):
        report.write_report({name: sections[name] for name in kept}, out, run="1")
    found = None
    for name, weight in kept.items():
        rows = report.read_section(spark, out, name)
        part = rows.groupBy("repo_id").agg(F.sum(weight).cast("long").alias("n")).select(F.lit(name).alias("section"), "repo_id", "n")
        found = part if found is None else found.unionByName(part)
    return found


# --- sources: the tables through the real readers -----------------------------------------------------

def tree_sources(t):
    """Texts written as trees of files, listed folder by folder and read back."""
    spark = t.files_listed.sparkSession
    root = track(spark, work_dir(spark, "trees")).removeprefix("file://")
    a.write_trees(t.files_listed, root)
    roots = t.files_listed.select("repo_id").distinct().select("repo_id", F.concat(F.lit(root + "/"), "repo_id").alias("root"))
    found = files.read_sources(files.list_trees(roots))
    return found.select("repo_id", "path", "size_bytes", F.md5("content").alias("digest"))


def written(table: DataFrame, label: str, format: str = "parquet") -> str:
    path = work_dir(table.sparkSession, label)
    table.write.format(format).save(path)
    return track(table.sparkSession, path)


def lossy_decode(t):
    """Texts with stray bytes around them and other line ends."""
    raw = F.concat(F.lit(b"\xff\r"), F.encode(F.replace("content", F.lit("\n"), F.lit("\r\n")), "UTF-8"), F.lit(b"\xc3"))
    table = t.files_decorated.select("repo_id", "path", F.lit(0).cast("long").alias("size_bytes"), raw.alias("content"))
    return files.read_binary_table(table).select("repo_id", "path", F.md5("content").alias("digest"))


def advisory_dump(t):
    """Flat advisories as nested records, written as JSON lines and read back."""
    record = F.struct(
        F.col("vuln_id").alias("id"), "severity",
        F.struct(F.col("db_severity").alias("severity")).alias("database_specific"),
        F.array(F.struct(F.struct("ecosystem", "name").alias("package"), F.array("version").alias("versions"))).alias("affected"),
    )
    path = written(t.advisories.select(F.to_json(record).alias("value")), "dump", "text")
    return snapshots.read_advisory_dump(t.advisories.sparkSession, path)


def advisory_ranges(t):
    """Dependencies against records that give ranges of versions, written as JSON lines and read back."""
    none = lambda kind: F.lit(None).cast("string").alias(kind)
    events = [
        F.struct(*[F.col(c).alias(k) if k == kind else none(k) for k in ("introduced", "fixed", "last_affected")])
        for kind, c in (("fixed", "fixed_again"), ("introduced", "introduced"), ("introduced", "again"), ("fixed", "fixed"), ("last_affected", "last_affected"))
    ]
    ranges = F.array(
        F.struct(F.lit("GIT").alias("type"), F.array(events[1]).alias("events")),
        F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(*events).alias("events")),
    )
    affected = F.struct(F.struct("ecosystem", "name").alias("package"), F.array_compact(F.array("listed")).alias("versions"), ranges.alias("ranges"))
    record = F.struct(F.col("vuln_id").alias("id"), "severity", F.struct(F.col("db_severity").alias("severity")).alias("database_specific"), F.array(affected).alias("affected"))
    spark = t.advisory_records.sparkSession
    path = written(t.advisory_records.select(F.to_json(record).alias("value")), "records", "text")
    deps = man.dedup_dependencies(t.deps)
    found = adv.with_ranges(deps, snapshots.read_advisory_dump(spark, path), snapshots.read_advisory_ranges(spark, path))
    return adv.dependency_vulnerabilities(deps, stage(found, "found"))


def snapshot(view, reader):
    def build(t):
        table = getattr(t, view)
        return reader(table.sparkSession, written(table, view))

    return build


def commit_snapshot(t):
    commits = snapshot("commits", snapshots.read_commits)(t)
    branches = snapshot("branches", snapshots.read_branches)(t)
    return git.commit_health(t.all_repos, commits, branches)


def secret_explanations(t):
    return secrets.scan_secrets(t.files_decorated).select("repo_id", "type", "file", "line", "why", "recommendation")


# --- streams ---------------------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def document_files(docs):
    return docs.select(
        F.col("source").alias("repo_id"),
        F.concat(F.lit("src/f"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
    )


def stream_secret_scan(spark, sf_dir):
    """The documents as a file stream, through to the written findings."""
    docs = scan.read_new_files(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)
    out = work_dir(spark, "stream-findings")
    scan.scan_new_files(document_files(docs), out, work_dir(spark, "stream-state")).awaitTermination()
    return scan.read_findings(spark, track(spark, out)).select(*REPORT_KEYS)


def stream_changed_files(t):
    """Files that come as decorated texts and, one in three, again as plain
    ones: later versions in an earlier batch for one half of them."""
    files = t.files_decorated
    spark = files.sparkSession
    number = F.regexp_extract("path", "f([0-9]+)", 1).cast("int")
    third, early = number % 3 == 0, number % 2 == 0
    plain = files.where(third).withColumn("content", F.substring_index("content", "\n", 1)).withColumn("version", F.lit(2).cast("long"))
    versions = files.withColumn("version", F.lit(1).cast("long")).unionByName(plain)
    incoming = track(spark, work_dir(spark, "stream-in"))
    for part, first in enumerate((True, False)):
        now = F.when(F.col("version") == 1, ~early).otherwise(early)
        versions.where(now if first else ~now).write.parquet(f"{incoming}/{part}")
    schema = "repo_id string, path string, content string, version long"
    stream = scan.read_new_files(spark, f"{incoming}/*", schema, maxFilesPerTrigger=5)
    out = work_dir(spark, "stream-current")
    scan.scan_changed_files(stream, out, work_dir(spark, "stream-state")).awaitTermination()
    return scan.current_findings(spark, track(spark, out)).select(*REPORT_KEYS)


def event_lookups(spark, sf_dir):
    events = scan.read_new_files(spark, f"{sf_dir}/events.parquet", EVENTS)
    return events.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("key"), "ts")


def stream_lookup_dedup(spark, sf_dir):
    out = work_dir(spark, "stream-lookups")
    scan.write_new_lookups(event_lookups(spark, sf_dir), out, work_dir(spark, "stream-state")).awaitTermination()
    return spark.read.schema(scan.KEPT).parquet(track(spark, out)).select("key", F.unix_micros("ts").alias("ts_us"))


def stream_first_in_window(spark, sf_dir):
    out = work_dir(spark, "stream-windows")
    scan.first_in_window(event_lookups(spark, sf_dir), out, work_dir(spark, "stream-state")).awaitTermination()
    found = scan.read_first_in_window(spark, track(spark, out))
    return found.select("key", F.unix_micros("window_start").alias("window_us"), F.unix_micros("ts").alias("ts_us"))


QUERIES = {
    # scans, sources
    "scan_source_files": query(lambda t: profile.scan_source_files(t.listing)),
    "tree_sources": query(tree_sources),
    "scan_manifests": query(lambda t: profile.scan_manifests(t.listing)),
    "resolve_thresholds": query(lambda t: config.resolve_thresholds(t.configs, t.configs)),
    "file_type_profile": query(file_type_profile),
    "file_category_quality": query(category("quality_category")),
    "file_category_security": query(category("security_category")),
    "ignored_paths_anti": query(ignored_paths_anti),
    "lossy_decode": query(lossy_decode),
    "advisory_dump": query(advisory_dump),
    "advisory_ranges": query(advisory_ranges),
    "advisory_snapshot": query(snapshot("advisories", snapshots.read_advisories)),
    "registry_snapshot": query(snapshot("registry", snapshots.read_registry)),
    "commit_snapshot": query(commit_snapshot),
    # profile
    "language_profile": query(lambda t: profile.ranked_languages(profile.language_profile(t.listing))),
    "corpus_size": query(corpus_size),
    "line_counts": query(line_counts),
    "large_files": query(large_files),
    "large_files_by_type": query(large_files_by_type),
    # secrets and markers
    "placeholder_filter": query(placeholder_filter),
    "secret_confidence": query(secret_confidence),
    "secret_input_suppression": query(secret_input_suppression),
    "secret_scan": query(secret_scan("files_decorated")),
    "secret_scan_by_lang": query(secret_scan("files_by_lang")),
    "secret_scan_overrides": query(secret_scan_overrides),
    "secret_explanations": query(secret_explanations),
    "secret_findings_dedup": query(secret_findings_dedup),
    "work_markers": query(work_markers),
    # duplicates
    "normalized_lines": query(normalized_lines),
    "sliding_blocks": query(sliding_blocks),
    "duplicate_blocks": query(duplicate_blocks),
    "duplicate_members": query(duplicate_members),
    "duplicate_first_pairs": query(duplicate_first_pairs),
    "duplicate_pair_counts": query(duplicate_pair_counts),
    # dependencies
    "deps_requirements": query(lambda t: man.parse_requirements(t.manifests_requirements)),
    "deps_package_json": query(lambda t: man.parse_package_json(t.manifests_package)),
    "deps_pom": query(lambda t: man.parse_pom(t.manifests_pom)),
    "deps_gradle": query(lambda t: man.parse_gradle(t.manifests_gradle)),
    "dependencies_all": query(lambda t: man.dependencies(t.manifests)),
    "dependency_dedup": query(lambda t: man.dedup_dependencies(t.deps)),
    "clean_versions": query(clean_versions),
    "version_triple": query(version_triple),
    "dependency_vulnerabilities": query(results),
    "dependency_summary": query(lambda t: adv.dependency_summary(results(t))),
    "manifest_summary": query(manifest_summary),
    "max_vuln_severity": query(max_vuln_severity),
    "vulnerable_package_rollup": query(package_rollup),
    "package_vulnerability_ids": query(lambda t: adv.package_vulnerability_ids(t.deps, t.advisories)),
    "outdated_dependencies": query(outdated),
    "lookup_reuse_24h": query(lookup_reuse),
    # history
    "commit_health": query(lambda t: git.commit_health(t.all_repos, t.commits, t.branches)),
    # code facts
    "js_imports": query(lambda t: scripts.js_imports(t.files_code)),
    "js_stripped": query(js_stripped),
    "js_identifier_counts": query(lambda t: scripts.js_identifier_counts(t.files_code)),
    "js_branch_counts": query(lambda t: scripts.js_branch_counts(t.files_code)),
    "js_functions": query(lambda t: scripts.js_functions(t.files_code)),
    "js_complexity": query(js_complexity),
    "unused_imports": query(unused_js_imports),
    "unused_python_imports": query(unused_python_imports),
    "python_functions": query(python_functions),
    "python_complexity": query(python_complexity),
    "long_functions": query(long_functions),
    # findings, scores, diagnosis
    "quality_findings": query(quality_findings),
    "js_quality_findings": query(js_quality_findings),
    "findings_dedup": query(findings_dedup),
    "findings_test_flag": query(findings_test_flag),
    "findings_ordered": query(findings_ordered),
    "findings_global_rank": query(findings_global_rank),
    "all_security_findings": query(all_security_findings),
    "security_score": query(security_score),
    "quality_score": query(quality_score),
    "quality_breakdown": query(quality_breakdown),
    "quality_deductions": query(quality_deductions),
    "documentation_score": query(lambda t: scores.documentation_score(t.roots)),
    "overall_health": query(overall_health),
    "diagnosis": query(diagnosis),
    "diagnosis_counts": query(lambda t: diag.ranked_counts(issue_counts(t))),
    "diagnosis_top5": query(diagnosis_top),
    "recommended_actions": query(lambda t: diag.recommended_actions(issue_counts(t))),
    "report_json": query(report_json),
    "report_written": query(report_written),
    # streams
    "stream_secret_scan": stream_secret_scan,
    "stream_changed_files": query(stream_changed_files),
    "stream_lookup_dedup": stream_lookup_dedup,
    "stream_first_in_window": stream_first_in_window,
}
