import datetime as dt
import itertools
import json
import random
import time

from pyspark.sql import functions as F
import pytest

from corpusvitals.functions import versions
from corpusvitals.operators import advisories as adv, commits, freshness, manifests as man
from corpusvitals.schemas import ADVISORY_SCHEMA, DEPENDENCY_SCHEMA, REGISTRY_SCHEMA
from corpusvitals.session import stage
from corpusvitals.sources import snapshots


def parsed(rows):
    return sorted((r.name, r.version) for r in rows.collect())


def test_requirements(files):
    text = "a==1.0\nb[x]==1\nc!=1\nd===1\n-r e\nf>=1,<2\ng ; python_version<'3'\ngit+https://h\n# z==1\n h ~= 2 # x\n"
    assert parsed(man.parse_requirements(files({"requirements.txt": text}))) == [
        ("a", "1.0"), ("b", "unspecified"), ("c", "unspecified"), ("d", "unspecified"), ("f", "1"),
        ("g", "unspecified"), ("git", "unspecified"), ("h", "2"),
    ]


def test_package_json(files):
    text = """{"dependencies": {"a": "^5.3.1", "b": "1.x", "c": "latest", "d": ">=1.2.3 <2.0.0", "e": {"version": "1.2.3"}},
        "devDependencies": {"a": "9.9.9", "f": "1.0.0-rc.1"}, "peerDependencies": "none"}"""
    assert parsed(man.parse_package_json(files({"package.json": text, "x/package.json": text[:-1], "y/package.json": "[]"}))) == [
        ("a", "5.3.1"), ("b", "unspecified"), ("c", "unspecified"), ("d", "1.2.3"), ("e", "unspecified"), ("f", "1.0.0-rc.1"),
    ]


@pytest.mark.parametrize("root", ["<project>", '<project xmlns="http://maven.apache.org/POM/4.0.0">'])
def test_pom(files, root):
    def dep(version, artifact="<artifactId>a</artifactId>"):
        return f"<dependency><groupId>g</groupId>{artifact}{version}</dependency>"

    text = (
        f'<?xml version="1.0" encoding="UTF-8"?>{root}<dependencyManagement>' + dep("<version>1</version>")
        + "</dependencyManagement><dependencies>" + dep("") + dep("<version>${v}</version>")
        + dep("<version>1.${v}</version>") + dep("<version>2</version>", "") + "</dependencies></project>"
    )
    got = parsed(man.parse_pom(files({"pom.xml": text, "bad/pom.xml": "<a>"})))
    assert got == [("g:a", "1"), ("g:a", "1.${v}"), ("g:a", "unspecified"), ("g:a", "unspecified")]


def test_gradle(files):
    text = """api("g:a:1")\nimplementation 'g:b:$v'\n// api 'g:c:1'\nruntimeOnly 'g:a:2'\ncompile 'g:d:1'\n/* api 'g:e:1'\n*/"""
    assert parsed(man.parse_gradle(files({"build.gradle": text}))) == [("g:a", "1"), ("g:b", "unspecified")]


def test_freshness(spark):
    declared = [("a", "1.9.9"), ("b", "1.2.3"), ("c", "1.2.3"), ("d", "1.0.0"), ("e", "1.2"), ("f", "unspecified")]
    released = [("a", "1.10.0"), ("b", "2.0.0"), ("c", "1.2.4"), ("d", "1.0.0"), ("e", "2.0.0"), ("f", "1.0.0")]
    deps = spark.createDataFrame(
        [("r", "m", e, n, v) for n, v in declared for e in ("npm", "Maven")], DEPENDENCY_SCHEMA
    )
    registry = spark.createDataFrame([(e, n, v) for n, v in released for e in ("npm", "Maven")], REGISTRY_SCHEMA)
    got = freshness.outdated_dependencies(deps, registry).collect()
    assert {(r.name, r.severity) for r in got} == {("a", "MEDIUM"), ("b", "HIGH"), ("c", "LOW")}


def test_huge_version_numbers(spark):
    row = spark.range(1).select(versions.version_triple(F.lit("1.99999999999999999999.2")).alias("t")).first()
    assert row.t.minor.digits == "99999999999999999999"
    pair = [F.lit(f"1.{"9" * 60}.2"), F.lit(f"1.1{"0" * 60}.0"), F.lit("01.002.3"), F.lit("1.2.3")]
    low, high, padded, plain = map(versions.version_triple, pair)
    assert spark.range(1).select(low < high, padded == plain).first() == (True, True)


def test_advisory_severities_and_rollup(spark):
    deps = spark.createDataFrame(
        [("r", "x/pom.xml", "Maven", n, "1") for n in "abcd"] + [("r", "build.gradle", "Maven", "a", "1")],
        DEPENDENCY_SCHEMA,
    )
    rows = [
        ("Maven", "a", "1", "V1", None, None), ("Maven", "b", "1", "V2", "medium", None),
        ("Maven", "c", "1", "V3", "critical", None), ("Maven", "c", "1", "V3", "critical", None),
        ("Maven", "d", "1", "V4", None, "critical"), ("Maven", "e", "1", "V5", None, None),
    ]
    advisories = spark.createDataFrame(rows, ADVISORY_SCHEMA)
    results = adv.dependency_vulnerabilities(deps, advisories)
    assert {(r.name, r.n_vulns, r.max_severity) for r in results.collect()} == {
        ("a", 1, "LOW"), ("b", 1, "MEDIUM"), ("c", 2, "CRITICAL"), ("d", 1, "CRITICAL"),
    }
    rolled = adv.vulnerable_package_rollup(deps, advisories).collect()
    assert {(r.package, r.severity, r.vuln_count, tuple(r.manifests)) for r in rolled} == {
        ("a", "HIGH", 1, ("build.gradle", "pom.xml")), ("b", "HIGH", 1, ("pom.xml",)),
        ("c", "CRITICAL", 1, ("pom.xml",)), ("d", "HIGH", 1, ("pom.xml",)),
    }


def test_recent_lookups_against_direct_search(spark):
    rnd, start = random.Random(5), dt.datetime(2024, 3, 1)
    at = lambda: start + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 400000), 3600 * rnd.randint(0, 90)]))
    requests = [(rnd.choice("aab"), at()) for _ in range(300)]
    lookups = [(rnd.choice("aab"), at()) for _ in range(25)]
    schema = "key string, ts timestamp"
    got = adv.recent_lookups(spark.createDataFrame(requests, schema), spark.createDataFrame(lookups, schema))
    expected = []
    for key, ts in requests:
        past = [t for k, t in lookups if k == key and t <= ts]
        latest = max(past, default=None)
        expected.append((key, ts, latest, latest is not None and ts - latest < dt.timedelta(hours=24)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_commit_health(spark):
    log = [("r", "c1", "A", "a@x", dt.datetime(2024, 1, 1), "one"), ("r", "c2", "A", "a@x", dt.datetime(2024, 1, 2), "two|x")]
    schema = "repo_id string, commit_id string, author_name string, author_email string, ts timestamp, subject string"
    repos = spark.createDataFrame([("r",), ("q",)], "repo_id string")
    branches = spark.createDataFrame([("r", "main"), ("r", "dev")], "repo_id string, name string")
    got = {r.repo_id: r for r in commits.commit_health(repos, spark.createDataFrame(log, schema), branches).collect()}
    assert (got["r"].n_commits, got["r"].n_branches, got["r"].n_contributors, got["r"].last_subject) == (2, 2, 1, "two|x")
    assert not got["q"].is_git and got["q"].n_commits == 0


def test_advisory_dump(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id":"V1","severity":[{"score":"x"}],"database_specific":{"severity":"HIGH"},'
        '"affected":[{"package":{"ecosystem":"npm","name":"p"},"versions":["1.0.0","1.0.1"]}]}\n'
        '{"affected":[]}\n'
    )
    rows = snapshots.read_advisory_dump(spark, str(tmp_path)).collect()
    assert {(r.vuln_id, r.name, r.version, r.severity, r.db_severity) for r in rows} == {
        ("V1", "p", "1.0.0", None, "HIGH"), ("V1", "p", "1.0.1", None, "HIGH"),
    }


ORDERS = {
    "npm": "1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 1.0.0 1.0.1 1.2 1.10.0 2 10.0.0",
    "PyPI": "1.dev0 1.0.dev456 1.0a1 1.0a2.dev456 1.0a12.dev456 1.0a12 1.0b2 1.0b2.post345.dev456 1.0b2.post345 1.0rc1.dev456 1.0rc1 1.0 "
    "1.0+abc.5 1.0+abc.7 1.0+5 1.0.post456.dev34 1.0.post456 1.0.15 1.1.dev1 1.1 10 1!0.5",
    "Maven": "1-alpha2 1-alpha-123 1-beta-2 1-beta123 1-m2 1-m11 1-rc 1-cr2 1-rc123 1-SNAPSHOT 1 1-sp 1-sp2 1-abc 1-def 1-pom-1 1-1-snapshot 1-1 1-2 1-123 1.0.1 1.1 2 10",
}
SAME = {
    "npm": ["1.0.0", "v1.0.0", "1", "1.0", "1.0.0+build.5"],
    "PyPI": ["1.0", "1", "v1.0.0", "0!1.0"],
    "Maven": ["1", "1.0", "1-0", "1.ga", "1-FINAL", "1.0-final.0"],
}


def test_version_keys_sort_like_versions(spark):
    rows = [(e, v, i) for e, text in ORDERS.items() for i, v in enumerate(text.split())]
    table = spark.createDataFrame(rows, "ecosystem string, version string, i int")
    keyed = table.select("*", versions.sort_key(F.col("ecosystem"), F.col("version")).alias("key")).collect()
    for ecosystem in ORDERS:
        keys = [r.key for r in sorted(keyed, key=lambda r: r.i) if r.ecosystem == ecosystem]
        assert all(a < b for a, b in zip(keys, keys[1:]))
    for ecosystem, texts in SAME.items():
        table = spark.createDataFrame([(t,) for t in texts], "v string").select(versions.sort_key(F.lit(ecosystem), F.col("v")).alias("k"))
        assert table.distinct().count() == 1
    bad = spark.createDataFrame([("npm", "x.y"), ("PyPI", "not a version"), ("Maven", " "), ("npm", None)], "e string, v string")
    assert [r.k for r in bad.select(versions.sort_key(F.col("e"), F.col("v")).alias("k")).collect()] == [None] * 4


def record(vuln_id, name, *events, kind="SEMVER", listed=(), ecosystem="npm"):
    ranges = [{"type": kind, "events": list(events)}] if events else []
    return {"id": vuln_id, "severity": "HIGH", "affected": [{"package": {"ecosystem": ecosystem, "name": name}, "versions": list(listed), "ranges": ranges}]}


def test_ranges_against_the_events_in_order(spark, tmp_path, monkeypatch):
    """Every declared version against events applied one by one in order of their versions."""
    rnd = random.Random(8)
    dotted = lambda v: ".".join(map(str, v))
    number = lambda: (rnd.randint(0, 12), rnd.randint(0, 3), rnd.randint(0, 2))
    records, wanted = [], set()
    declared = {("hot" if rnd.random() < 0.6 else f"p{rnd.randint(0, 3)}", number()) for _ in range(250)}
    for i in range(120):
        name = "hot" if i % 3 else f"p{i % 4}"
        points = sorted({number() for _ in range(rnd.randint(1, 4))})
        events, state = [], True
        for point in points:
            kind = "introduced" if state else rnd.choice(["fixed", "last_affected"])
            events.append((point, kind))
            state = not state
        if rnd.random() < 0.3:
            events[0] = ((0, 0, 0), "introduced")
        for pkg, v in declared:
            hit = False
            for point, kind in events:
                if kind == "introduced" and v >= point:
                    hit = True
                elif kind == "fixed" and v >= point or kind == "last_affected" and v > point:
                    hit = False
            if hit and pkg == name:
                wanted.add((pkg, dotted(v), f"V{i}"))
        shuffled = [{k: "0" if p == (0, 0, 0) else dotted(p)} for p, k in events]
        rnd.shuffle(shuffled)
        records.append(record(f"V{i}", name, *shuffled))
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, records)))
    deps = spark.createDataFrame([("r", "m", "npm", n, dotted(v)) for n, v in declared], DEPENDENCY_SCHEMA)
    ranges = snapshots.read_advisory_ranges(spark, str(tmp_path))
    for signs, most in ((10, 5000), (3, 7), (14, 1), (0, 2)):
        monkeypatch.setattr(adv, "BIN_SIGNS", signs)
        monkeypatch.setattr(adv, "BIN_VERSIONS", most)
        found = adv.affected_versions(deps, ranges).collect()
        assert len(found) == len(wanted) and {(r.name, r.version, r.vuln_id) for r in found} == wanted


def test_no_record_vanishes(spark, tmp_path):
    records = [
        record("listed", "a", listed=["1.0.0"]),
        record("both", "a", {"introduced": "0"}, {"fixed": "2.0.0"}, listed=["1.0.0", "9.0.0"]),
        record("open", "b", {"introduced": "1.0.0-rc.1"}),
        record("commits", "c", {"introduced": "0"}, kind="GIT"),
        record("nothing", "c"),
        record("odd", "c", {"introduced": "???"}),
        {"id": "bare"},
        record("py", "a", {"introduced": "0"}, {"fixed": "1.0"}, ecosystem="PyPI", kind="ECOSYSTEM"),
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, records)))
    path = str(tmp_path)
    assert {(r.vuln_id, r.reason) for r in snapshots.unplaced_advisories(spark, path).collect()} == {
        ("commits", "ranges of commits only"), ("nothing", "neither versions nor ranges"),
        ("odd", "no range with a version to start from"), ("bare", "no package"),
    }
    rows = [("npm", "a", "1.0.0"), ("npm", "a", "9.0.0"), ("npm", "b", "1.0.0"), ("npm", "b", "0.9.0"), ("npm", "c", "1.0.0"),
            ("PyPI", "a", "1.0.0rc1"), ("PyPI", "a", "1.0.0"), ("npm", "a", "unspecified"), ("npm", "a", "")]
    deps = spark.createDataFrame([("r", "m", *row) for row in rows], DEPENDENCY_SCHEMA)
    flat = adv.with_ranges(deps, snapshots.read_advisory_dump(spark, path), snapshots.read_advisory_ranges(spark, path))
    assert {(r.ecosystem, r.name, r.version, r.vuln_id) for r in flat.collect()} == {
        ("npm", "a", "1.0.0", "listed"), ("npm", "a", "1.0.0", "both"), ("npm", "a", "9.0.0", "both"),
        ("npm", "b", "1.0.0", "open"), ("PyPI", "a", "1.0.0rc1", "py"),
    }
    results = adv.dependency_vulnerabilities(deps, flat)
    assert {(r.name, r.version): r.n_vulns for r in results.where("ecosystem = 'npm'").collect()} == {
        ("a", "1.0.0"): 2, ("a", "9.0.0"): 1, ("b", "1.0.0"): 1, ("b", "0.9.0"): 0, ("c", "1.0.0"): 0, ("a", "unspecified"): 0, ("a", ""): 0,
    }


def test_sort_keys_are_made_once_per_version(spark):
    deps = spark.createDataFrame([("r", f"m{i}", "npm", "a", "1.2.3") for i in range(6)], DEPENDENCY_SCHEMA)
    ranges = spark.createDataFrame(
        [("npm", "a", "V", "HIGH", None, "", "~", False)],
        "ecosystem string, name string, vuln_id string, severity string, db_severity string, low string, high string, closed boolean",
    )
    found = adv.affected_versions(deps, ranges)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # no filter below the aggregate that makes versions distinct computes a key
    assert "Generate inline" in plan
    assert [tuple(r) for r in found.collect()] == [("npm", "a", "1.2.3", "V", "HIGH", None)]


@pytest.mark.parametrize("bound", [0, 1000])  # versions with advisories by a shuffle, and sent to all tasks
def test_rollup_counts_an_advisory_of_two_ecosystems_once(spark, monkeypatch, bound):
    monkeypatch.setattr(adv, "BROADCAST_KEYS", bound)
    rnd = random.Random(7)
    pick = lambda *values: rnd.choice(values)
    deps = [(pick("r", "s", None), pick("x/pom.xml", "y/pom.xml", "package.json"), pick("PyPI", "npm", "Maven"), pick("a", "b", "c", ""), pick("1", "2", "unspecified", None)) for _ in range(60)]
    rows = [(pick("PyPI", "npm", "Maven", None), pick("a", "b", "d"), pick("1", "2"), pick("V1", "V2", "V3", "V4", None), pick("critical", "low", None), "critical") for _ in range(50)]
    got = adv.vulnerable_package_rollup(spark.createDataFrame(deps, DEPENDENCY_SCHEMA), spark.createDataFrame(rows, ADVISORY_SCHEMA))
    expected = {}
    for (repo, path, *key), (*listed, vuln, severity, _) in itertools.product(deps, rows):
        if repo and key == listed and vuln:
            ids, critical, manifests = expected.setdefault((repo, *key[1:]), (set(), set(), set()))
            ids.add(vuln), critical.add(severity == "critical"), manifests.add(path.rpartition("/")[2])
    assert len(expected) > 4 and any(len(ids) > 2 for ids, _, _ in expected.values())
    assert {(r.repo_id, r.package, r.version): (r.vuln_count, r.severity, r.manifests) for r in got.collect()} == {
        k: (len(ids), "CRITICAL" if True in critical else "HIGH", sorted(manifests)) for k, (ids, critical, manifests) in expected.items()
    }
    assert got.count() == len(expected)


def test_staged_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in map(blocks.apply, range(blocks.size())) if f.getName().startswith("shuffle_")}
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = manager.getAllFiles()
    before = files()
    stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):  # they are deleted in the background
        blocks = manager.getAllFiles()
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
