from datetime import datetime, timedelta
import json
import random
import time

import pytest

from corpusvitals.operators import diagnosis as diag, findings as fnd, scores
from corpusvitals.operators.facts import code_facts
from corpusvitals.plans import report
from corpusvitals.schemas import ADVISORY_SCHEMA, FINDING_SCHEMA
from corpusvitals.sources import files as src
from corpusvitals.streaming import scan


def finding_rows(spark, rows):
    return fnd.union_findings(spark.createDataFrame(rows)) if rows else spark.createDataFrame([], FINDING_SCHEMA)


def repos(spark):
    return spark.createDataFrame([("r",)], "repo_id string")


def vulnerable(package, count, file="m"):
    return {"repo_id": "r", "type": "Vulnerable Dependency", "package": package, "version": "1", "vuln_count": count, "file": file}


SECRET = {"repo_id": "r", "type": "Token", "package": None, "version": None, "vuln_count": None, "file": "f"}


@pytest.mark.parametrize(
    "rows,score",
    [
        ([SECRET] * 5, 40),
        ([vulnerable("p", 3)], 84),
        ([vulnerable("p", 3), vulnerable("p", 3, "other")], 84),
        ([{**SECRET, "type": "Secret Key"}] * 10, 100),
        ([SECRET] * 9 + [vulnerable(f"p{i}", 30) for i in range(9)], 0),
        ([vulnerable("p", 0)], 100),
    ],
)
def test_security_score(spark, rows, score):
    schema = "repo_id string, type string, package string, version string, vuln_count int, file string"
    df = spark.createDataFrame([tuple(r[k] for k in ("repo_id", "type", "package", "version", "vuln_count", "file")) for r in rows], schema)
    assert scores.security_score(repos(spark), df).first().security == score


@pytest.mark.parametrize(
    "counts,expected",
    [
        ([], (100, 0, 0, 0)),
        ([("HIGH", "x", 8)], (50, 50, 0, 0)),
        ([("HIGH", "x", 10), ("MEDIUM", "x", 10), ("LOW", "x", 10)], (50, 27, 15, 8)),
        ([("LOW", "Duplicate Code", 4), ("HIGH", "Large File", 1), ("odd", "y", 1)], (88, 6, 0, 6)),
    ],
)
def test_quality_score(spark, counts, expected):
    rows = [("r", kind, severity) for severity, kind, n in counts for _ in range(n)]
    df = spark.createDataFrame(rows, "repo_id string, type string, severity string")
    r = scores.quality_score(repos(spark), scores.finding_counts(df)).first()
    assert (r.quality, r.deduct_high, r.deduct_medium, r.deduct_low) == expected
    assert r.deduct_high + r.deduct_medium + r.deduct_low == r.total_deduction


@pytest.mark.parametrize("parts,overall", [((100, 75, 100), 92), ((85, 96, 30), 77)])
def test_overall_rounds_half_to_even(spark, parts, overall):
    tables = [
        spark.createDataFrame([("r", v)], f"repo_id string, {n} int")
        for n, v in zip(("security", "quality", "documentation"), parts)
    ]
    assert scores.overall_score(*tables).first().overall == overall


def issue(severity, kind, category="Code Quality", file="f"):
    return ("r", severity, category, kind, file, 1, None, None, None, "d")


ISSUES = (
    "repo_id string, severity string, category string, type string, file string, line int, "
    "package string, version string, vuln_count long, details string"
)


def test_top_five_and_overflow(spark):
    rows = [issue("LOW", "TODO Marker", file=f"f{i}") for i in range(6)]
    top = diag.diagnosis_top(spark.createDataFrame(rows, ISSUES)).collect()
    assert sorted((r["rank"], r.file) for r in top) == [(i + 1, f"f{i}") for i in range(5)]
    assert {r.n_more for r in top} == {1}


@pytest.mark.parametrize(
    "rows,actions",
    [
        ([], []),
        ([issue("LOW", "High JavaScript Complexity")], ["default"]),
        ([issue("CRITICAL", "Vulnerable Dependency", "Dependency Security"), issue("LOW", "Duplicate Code")], ["critical", "duplicate"]),
        ([issue("HIGH", "Vulnerable Dependency", "Dependency Security"), issue("MEDIUM", "High Python Complexity")], ["dependency", "complexity"]),
    ],
)
def test_actions(spark, rows, actions):
    from corpusvitals.rules import ACTIONS

    counts = diag.diagnosis_counts(spark.createDataFrame(rows, ISSUES))
    got = sorted((r.position, r.action) for r in diag.recommended_actions(counts).collect())
    assert [a for _, a in got] == [ACTIONS[a] for a in actions]


def test_dedup_is_idempotent_and_order_free(spark):
    rows = [{"repo_id": "r", "type": f"T{i % 3}", "file": "f", "line": i % 4, "details": None} for i in range(40)]
    schema = "repo_id string, type string, file string, line int, details string"
    make = lambda rs: fnd.dedup_quality_findings(fnd.union_findings(spark.createDataFrame([tuple(r.values()) for r in rs], schema)))
    once = make(rows)
    random.Random(2).shuffle(rows)
    key = lambda df: sorted((r.type, r.line) for r in df.collect())
    assert key(once) == key(make(rows)) == key(fnd.dedup_quality_findings(once)) and len(key(once)) == 12


@pytest.fixture
def sample_tree(tmp_path):
    tests = tmp_path / "repo" / "tests"
    tests.mkdir(parents=True)
    (tests / "bad_code.py").write_text(
        "# TODO: later\n# FIXME: soon\n\ndef risky(user):\n    if user:\n        if user.a:\n            print(1)\n"
    )
    (tests / "config.py").write_text(
        'API_KEY = "fake_demo_key_1"\n\nPASSWORD = "demo_password_12345"\n\npassword = input("Enter your password: ")\n\nTOKEN = "AbC123456789XYZ987"'
    )
    (tests / "requirements.txt").write_text("flask==2.0.1\nrequests==2.25.1\nnumpy==1.19.0")
    return tmp_path


def test_whole_report(spark, sample_tree, tmp_path):
    roots = spark.createDataFrame([("repo", str(sample_tree / "repo"))], "repo_id string, root string")
    listing = src.list_trees(roots)
    inputs = report.Inputs(
        listing=listing, files=src.read_sources(listing), manifests=src.read_manifests(listing),
        configs=src.read_configs(listing), advisories=spark.createDataFrame([], ADVISORY_SCHEMA),
    )
    sections = report.build_report(inputs)
    out = str(tmp_path / "out")
    report.write_report(sections, out)
    score = spark.read.parquet(f"{out}/scores").first()
    assert (score.security, score.quality, score.documentation, score.overall) == (85, 96, 30, 77)
    assert {(r.name, r.version) for r in spark.read.parquet(f"{out}/dependencies").collect()} == {
        ("flask", "2.0.1"), ("requests", "2.25.1"), ("numpy", "1.19.0"),
    }
    quality = spark.read.parquet(f"{out}/quality_findings").collect()
    assert {(r.type, r.line, r.test_file) for r in quality} == {("TODO Marker", 1, True), ("FIXME Marker", 2, True)}
    doc = json.loads(report.as_json(spark.read.parquet(f"{out}/security_findings")).first().json)
    assert doc["line"] == 7 and "vuln_count" not in doc
    facts = code_facts(inputs.files)
    quick = report.quick_scores(inputs.listing, facts, sections["security_findings"]).first()
    assert quick.overall == 77
    counts = sorted(map(tuple, diag.diagnosis_counts(sections["diagnosis"]).collect()))
    packages = report._no_packages(roots)
    secret = fnd.union_findings(fnd.secret_findings(facts))
    assert sorted(map(tuple, diag.counts_of(secret, fnd.quality_counts(facts), packages).collect())) == counts


def test_repositories_without_files_keep_their_row(spark, sample_tree):
    roots = spark.createDataFrame([("repo", str(sample_tree / "repo")), ("none", str(sample_tree / "none"))], "repo_id string, root string")
    listing = src.list_trees(roots)
    sections = report.build_report(report.Inputs(listing=listing, files=src.read_sources(listing), repos=roots))
    scores = {r.repo_id: (r.security, r.quality, r.documentation) for r in sections["scores"].collect()}
    assert scores["none"] == (100, 100, 30) and len(scores) == 2
    ranks = [(r.severity, r.rank) for r in diag.ranked_counts(sections["diagnosis_counts"]).orderBy("rank").collect()]
    assert [r for _, r in ranks] == list(range(1, len(ranks) + 1))


def test_lookups_do_not_depend_on_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hours = [0, 1, 23, 24, 25, 47, 48, 80, 81, 103, 104]
    rows = [(key, start + timedelta(hours=h + i)) for i, key in enumerate("ab") for h in hours]
    wanted = {(key, start + timedelta(hours=h + i)) for i, key in enumerate("ab") for h in (0, 24, 48, 80, 104)}
    for name, parts in (("one", [rows]), ("many", [sorted(rows, key=lambda r: r[1])[i : i + 5] for i in range(0, 22, 5)])):
        for n, part in enumerate(parts):
            spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"{name}/{n}"))
            time.sleep(0.05)
        stream = scan.read_new_files(spark, str(tmp_path / f"{name}/*"), "key string, ts timestamp", maxFilesPerTrigger=1 if name == "many" else 100)
        scan.write_new_lookups(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")).awaitTermination()
        found = spark.read.schema(scan.KEPT).parquet(str(tmp_path / f"{name}-out")).collect()
        assert sorted((r.key, r.ts) for r in found) == sorted(wanted)


def test_stream_equals_batch(spark, files, tmp_path):
    from corpusvitals.operators import secrets

    tree = {f"f{i}.py": 'token = "AbC123456789XYZ987"\n# todo\n' * (i + 1) for i in range(6)}
    for part, names in enumerate([list(tree)[:3], list(tree)[3:]]):
        files({n: tree[n] for n in names}).write.parquet(str(tmp_path / f"in/{part}"))
    schema = "repo_id string, path string, size_bytes long, content string"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a second run finds nothing new
        stream = scan.read_new_files(spark, str(tmp_path / "in/*"), schema, maxFilesPerTrigger=1)
        scan.scan_new_files(stream, out, state, with_markers=False).awaitTermination()
    key = lambda df: sorted((r.file, r.line, r.type, r.confidence) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(secrets.scan_secrets(files(tree)))


def test_streams_read_a_folder_as_a_file(spark, tmp_path):
    from driver.queries import QUERIES

    names = ("stream_secret_scan", "stream_lookup_dedup", "stream_first_in_window")
    for table in ("documents", "events"):
        rows = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
        rows.repartition(3).write.parquet(str(tmp_path / f"parts/{table}.parquet"))
        (tmp_path / f"none/{table}.parquet").mkdir(parents=True)
    for name in names:
        whole = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
        assert whole and sorted(QUERIES[name](spark, str(tmp_path / "parts")).collect()) == sorted(whole)
        assert QUERIES[name](spark, str(tmp_path / "none")).collect() == []


def test_changed_files_replace_their_findings(spark, tmp_path):
    secret = 'token = "AbC123456789XYZ987"\n'
    schema = "repo_id string, path string, content string, version long"
    arrivals = [
        [("r", "a.py", secret, 1), ("r", "b.py", secret, 1), ("r", "c.py", "x = 1\n", 5), ("r", "d.py", secret, 1), ("r", "d.py", secret, 1)],
        [("r", "a.py", "x = 1\n", 2), ("r", "c.py", secret, 4), ("s", "a.py", "# todo\n", 1)],
        [("r", "b.py", "\n\n" + secret, 2), ("r", "b.py", secret * 2, 3)],
    ]
    last = [("r", "a.py", "x = 1\n", 2), ("r", "c.py", "x = 1\n", 5), ("r", "d.py", secret, 1), ("s", "a.py", "# todo\n", 1), ("r", "b.py", secret * 2, 3)]
    found = {}
    for name, parts in (("many", arrivals), ("one", [[row for part in arrivals for row in part]]), ("last", [last])):
        out, state = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")
        for n, part in enumerate(parts):  # a run for each arrival: the state is what restarts leave
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/{n}"))
            stream = scan.read_new_files(spark, str(tmp_path / f"{name}/*"), schema)
            scan.scan_changed_files(stream, out, state).awaitTermination()
        rows = scan.current_findings(spark, out).select("repo_id", "file", "type", "line").collect()
        found[name] = sorted(tuple(r) for r in rows)
    assert found["many"] == found["one"] == found["last"]
    assert {r[:2] for r in found["last"]} == {("r", "d.py"), ("s", "a.py"), ("r", "b.py")}
    assert sum(r[1] == "b.py" for r in found["last"]) == 2 and sum(r[1] == "d.py" for r in found["last"]) == 1


def test_first_in_window_survives_a_restart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(minutes=7 * i)) for i in range(900)] + [("k", start + timedelta(hours=h)) for h in (3, 2, 30, 29, 90)]
    wanted = {}
    for key, ts in rows:
        day = start + timedelta(days=(ts - start).days)
        wanted[key, day] = min(ts, wanted.get((key, day), ts))
    rows.sort(key=lambda r: r[1])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, part in enumerate((rows[:300], rows[300:600], rows[600:])):
        spark.createDataFrame(part, "key string, ts timestamp").repartition(2).write.parquet(str(tmp_path / f"in/{n}"))
        stream = scan.read_new_files(spark, str(tmp_path / "in/*"), "key string, ts timestamp")
        scan.first_in_window(stream, out, state).awaitTermination()
    found = {(r.key, r.window_start): r.ts for r in scan.read_first_in_window(spark, out).collect()}
    assert found == wanted


def test_positions_need_no_single_task(spark):
    rows = [("hot" if i % 3 else f"r{i}", ["HIGH", "LOW", "odd", None][i % 4], f"f{i * 7 % 50}", None if i % 5 == 0 else i % 9, "T", None, str(i)) for i in range(400)]
    found = spark.createDataFrame(rows, "repo_id string, severity string, file string, line int, type string, details string, function string")
    order = {"HIGH": 0, "LOW": 2}
    key = lambda r: (order.get(r[1], 9), r[2], r[3] or 0, r[4], r[5] or "", r[6])
    wanted = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (*key(r), r[0])), 1)}
    for partitions in (1, 7, 60):
        got = fnd.globally_ranked(found, partitions)
        assert got.rdd.getNumPartitions() > 0 and {tuple(r[:-1]): r.position for r in got.collect()} == wanted
        ranked = {tuple(r[:-1]): r.rank for r in fnd.ranked_findings(found, partitions).collect()}
        for repo in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == repo), key=key)
            assert [ranked[r] for r in own] == list(range(1, len(own) + 1))
    assert fnd.globally_ranked(found.limit(0)).collect() == fnd.ranked_findings(found.limit(0)).collect() == []


def test_a_report_counts_once_it_is_finished(spark, tmp_path):
    out = str(tmp_path / "out")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    scores_ = "repo_id string, overall int"
    found = "repo_id string, severity string, file string"
    first = {"scores": table([("a", 1), ("b", 2)], scores_), "found": table([("a", "HIGH", "x"), ("a", "LOW", "y"), ("b", "LOW", "z")], found)}
    for _ in range(2):
        report.write_report(first, out, run="1")
    read = lambda name: sorted(tuple(r)[:-1] for r in report.read_section(spark, out, name).select(*first[name].columns, "run").collect())
    assert read("found") == [("a", "HIGH", "x"), ("a", "LOW", "y"), ("b", "LOW", "z")] and read("scores") == [("a", 1), ("b", 2)]
    # one repository again: it has nothing left, the other stays
    report.write_report({"scores": table([("a", 9)], scores_), "found": table([], found)}, out, run="2")
    assert read("found") == [("b", "LOW", "z")] and read("scores") == [("a", 9), ("b", 2)]
    assert {(r.section, r.run): r.n_rows for r in report.read_manifest(spark, out).collect()} == {
        ("scores", "1"): 2, ("found", "1"): 3, ("scores", "2"): 1, ("found", "2"): 0,
    }
    # a run that broke off has no manifest
    table([("b", 0)], scores_).write.parquet(f"{out}/scores/run=3")
    table([("b",)], "repo_id string").write.parquet(f"{out}/covered/run=3")
    assert read("scores") == [("a", 9), ("b", 2)]


def test_weights_of_a_repository(spark):
    counts = spark.createDataFrame([(r, "Large File", "HIGH", 2) for r in "ab"], "repo_id string, type string, severity string, n long")
    own = spark.createDataFrame([("a", "Large File", "HIGH", 1), ("z", "Large File", "HIGH", 50)], "repo_id string, type string, severity string, weight int")
    rows = scores.quality_score(counts, counts, own).collect()
    assert {r.repo_id: r.quality for r in rows} == {"a": 98, "b": 88}


def test_a_batch_reads_its_texts_once(spark, tmp_path, monkeypatch):
    labels, whole = [], scan.stage
    monkeypatch.setattr(scan, "stage", lambda df, label, **o: labels.append((label, df.columns)) or whole(df, label, **o))
    incoming = str(tmp_path / "in")
    rows = [("r", "a.py", "# TODO\n", 1), ("r", "a.py", "# FIXME\n", 2), ("r", "b.py", "# HACK\n", 1)]
    schema = "repo_id string, path string, content string, version long"
    spark.createDataFrame(rows, schema).write.parquet(incoming)
    out = str(tmp_path / "out")
    scan.scan_changed_files(scan.read_new_files(spark, incoming, schema), out, str(tmp_path / "state")).awaitTermination()
    assert {(r.file, r.type) for r in scan.current_findings(spark, out).collect()} == {("a.py", "FIXME Marker"), ("b.py", "HACK Marker")}
    # what meets the other versions holds no text
    assert labels and all("content" not in columns for _, columns in labels)
