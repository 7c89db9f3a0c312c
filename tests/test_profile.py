from pyspark.sql import functions as F
import pytest

from corpusvitals.functions import paths, text as tx
from corpusvitals.operators import profile
from corpusvitals.sources import config, files as src

TEXTS = [
    "", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0cb", "a\x85b", "a b ", "\n", "a\x1cb\x1d\x1ec", "x\x0b",
]


def test_line_counts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", tx.split_line_count(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: len(t.splitlines()) for t in TEXTS}


def test_normalized_lines(spark):
    text = 'x = 1  # c\nu = "http://a"\n   \n\ty\t  z\r\nw'
    row = spark.createDataFrame([(text,)], "t string").select(tx.normalized_lines(F.col("t")).alias("l")).first()
    assert [(x.line_no, x.text) for x in row.l] == [(1, "x = 1"), (2, 'u = "http:'), (4, "y z"), (5, "w")]


def test_lossy_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\r\nc\rd"),)], "c binary")
    assert df.select(tx.decode_utf8(F.col("c")).alias("t")).first().t == "ab\nc\nd"


@pytest.mark.parametrize(
    "path,quality,security",
    [
        ("a/test_x.py", "test", "source"),
        ("tests/dist/x.py", "test", "generated"),
        ("vite.config.mjs", "config", "source"),
        ("Build/x.py", "generated", "generated"),
        ("a/x_test.py", "test", "test"),
    ],
)
def test_categories(spark, path, quality, security):
    p = F.lit(path)
    row = spark.range(1).select(paths.quality_category(p).alias("q"), paths.security_category(p).alias("s")).first()
    assert (row.q, row.s) == (quality, security)


def test_source_scan(spark):
    limit = 10 * 1024 * 1024
    rows = [("r", "a.py", limit), ("r", "b.py", limit + 1), ("r", "Build/x.py", 1), ("r", "build/x.py", 1), ("r", "x.PY", 1), ("r", ".py", 1)]
    df = spark.createDataFrame(rows, "repo_id string, path string, size_bytes long")
    assert sorted(r.path for r in profile.scan_source_files(df).collect()) == ["Build/x.py", "a.py", "x.PY"]


def test_manifest_scan(spark):
    rows = [("r", p, 1) for p in ["Requirements.TXT", "Build/pom.xml", "Pods/package.json", "a/build.gradle", "x.py"]]
    df = spark.createDataFrame(rows, "repo_id string, path string, size_bytes long")
    assert sorted(r.path for r in profile.scan_manifests(df).collect()) == [
        "Pods/package.json", "Requirements.TXT", "a/build.gradle",
    ]


def test_thresholds(spark):
    docs = {
        "bool": '{"thresholds": {"python": true}}', "zero": '{"thresholds": {"python": 0}}',
        "neg": '{"thresholds": {"python": -1}}', "text": '{"thresholds": {"python": "9"}}',
        "nine": '{"thresholds": {"python": 9}}', "bad": "{", "none": "{}", "list": "[]",
    }
    df = spark.createDataFrame(list(docs.items()), "repo_id string, content string")
    got = {r.repo_id: r.max_lines for r in config.resolve_thresholds(df, df).where("language_key = 'python'").collect()}
    assert got == {k: 9 if k == "nine" else 500 for k in docs}


@pytest.mark.parametrize("lines,severity", [(100, None), (101, "LOW"), (175, "MEDIUM"), (300, "HIGH")])
def test_large_files(spark, files, lines, severity):
    limits = spark.createDataFrame([("r", "python", 100)], "repo_id string, language_key string, max_lines int")
    found = profile.large_files(files({"a.py": "x\n" * lines}), limits).collect()
    assert [r.severity for r in found] == ([severity] if severity else [])


def test_tree_listing_sees_underscore_names(spark, tmp_path):
    for name in ["pkg/__init__.py", "__tests__/a.js", ".hidden/b.py", "node_modules/c.js", "README.md"]:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x\r\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "pkg/__init__.py")
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    read = src.read_sources(src.list_trees(roots)).collect()
    assert {(r.path, r.content) for r in read} == {
        ("pkg/__init__.py", "x\n"), ("__tests__/a.js", "x\n"), (".hidden/b.py", "x\n"),
    }


def test_reading_leaves_no_file_out(spark, tmp_path):
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.py").write_bytes(b"x = 1\n\xff")
    (tree / "big.py").write_bytes(b"#" * (11 << 20))
    (tree / "README.md").write_bytes(b"m" * (11 << 20))
    listing = src.list_trees(spark.createDataFrame([("t", str(tree))], "repo_id string, root string"))
    gone = spark.createDataFrame([("t", "gone.py", 3, str(tree))], "repo_id string, path string, size_bytes long, root string")
    contents = src.read_sources(listing.union(gone))
    assert {(r.path, r.content, r.reason) for r in contents.collect()} == {("a.py", "x = 1\n", None), ("gone.py", None, "missing")}
    skipped = {(r.path, r.reason) for r in src.skipped_files(listing, contents).collect()}
    assert skipped == {("big.py", "too large"), ("gone.py", "missing")}
    assert src.skipped_files(listing, max_bytes=None).count() == 0
    assert profile.scan_source_files(listing, None).count() == 2
    store = src.read_object_store(spark, str(tmp_path))
    assert {(r.repo_id, r.path, r.size_bytes) for r in store.collect()} == {
        ("t", "a.py", 7), ("t", "big.py", 11 << 20), ("t", "README.md", 11 << 20),
    }


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from corpusvitals import session

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Fake:
        def __init__(self, master, shared=None):
            self.conf = Conf(**{"spark.master": master} | ({"spark.checkpoint.dir": shared} if shared else {}))

    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.work_dir(Fake(master), "x")
        assert session.work_dir(Fake(master, "hdfs://n/c/"), "x").startswith("hdfs://n/c/x-")
    for master in ("local", "local[4]", "local[*]"):
        assert session.work_dir(Fake(master), "x").endswith("/x")


def test_large_limits(spark):
    content = '{"thresholds": {"python": 100000000000000000000000, "css": 3.5, "html": true}}'
    configs = spark.createDataFrame([("r", content)], "repo_id string, content string")
    assert {(r.language_key, r.max_lines) for r in config.configured_thresholds(configs).collect()} == {("python", 2**63 - 1)}


def test_staged_tables_can_be_cleared(spark):
    from corpusvitals import session

    session.clear_staged(spark)
    app = spark.sparkContext.applicationId
    with pytest.warns(UserWarning, match="not deleted"):
        session.stage(spark.range(3), "kept")
        session.track(spark, "nowhere://host/x")
        session.stage(spark.range(3), "also")
        paths = list(session._written[app])
        assert session.clear_staged(spark) == 2  # one fault does not lose the others
    assert [session.exists(spark, p) for p in (paths[0], paths[2])] == [False, False]
    assert session._written.pop(app) == ["nowhere://host/x"]
    assert session.clear_staged(spark) == 0


def test_queries_run_again_after_clearing(spark):
    from corpusvitals import session
    from driver.queries import QUERIES

    first = sorted(QUERIES["corpus_size"](spark, "/root/testdata/sf0.001").collect())
    assert session.clear_staged(spark) > 0
    assert sorted(QUERIES["corpus_size"](spark, "/root/testdata/sf0.001").collect()) == first


def test_a_tree_is_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    import os
    from corpusvitals.sources import files as src

    wanted = set()
    for r, (folders, deep) in enumerate([(40, 9), (1, 0), (0, 0)]):
        root = tmp_path / f"r{r}"
        root.mkdir()
        for i in range(folders):
            folder = root / "/".join(f"l{j}" for j in range(i % (deep + 1))) / f"d{i}"
            folder.mkdir(parents=True)
            for name in ("__init__.py", ".hidden.js"):
                (folder / name).write_text("x" * i)
                wanted.add((f"r{r}", os.path.relpath(folder / name, root), i))
    (tmp_path / "r0/node_modules/x").mkdir(parents=True)
    (tmp_path / "r0/node_modules/x/no.js").write_text("")
    (tmp_path / "r0/link").symlink_to(tmp_path / "r1")
    (tmp_path / "r0/link.py").symlink_to(tmp_path / "r1/d0/__init__.py")
    repos = spark.createDataFrame([(f"r{r}", str(tmp_path / f"r{r}")) for r in (0, 1, 2, 9)], "repo_id string, root string")
    for most in (200, 3, 1):
        monkeypatch.setattr(src, "FOLDERS", most)
        rows = src.list_trees(repos).collect()
        assert len(rows) == len(wanted) and {(r.repo_id, r.path, r.size_bytes) for r in rows} == wanted
    walked = list(src._walk(str(tmp_path / "r0"), ""))  # one folder, and the folders in it
    assert walked and all(is_folder for _, _, is_folder in walked)


def test_many_small_folders_are_listed_and_read_by_many_tasks(spark, tmp_path):
    for n in range(400):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "a.py").write_text(f"x = {n}\n")
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    listing = src.list_trees(roots)
    read = src.read_sources(listing)
    assert {r.path for r in read.select("path").collect()} == {f"d{n}/a.py" for n in range(400)}
    assert read.where("content IS NOT NULL").select(F.spark_partition_id().alias("task")).distinct().count() > 4
    # of the frontier, 200 folders at least are left to the second round
    written = {r.task for r in listing.select(F.input_file_name().alias("task")).distinct().collect()}
    assert len(written) > 4


def test_looks_for_bytes_say_what_the_patterns_say(spark):
    signs = [chr(n) for n in (*range(0x21), 0x7f, 0x85, 0xa0, 0x1680, *range(0x1fff, 0x2012), 0x2028, 0x2029, 0x202f, 0x205f, 0x2060, 0x3000, 0xe9, 0x41)]
    texts = [*TEXTS, *signs, *[f"{s}a" for s in signs], *[f"a  {s}{s}b{s}" for s in signs], *[f"x{s}# y // z\nb // c{s}d" for s in signs]]
    c = F.col("t")
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.trimmed(c).alias("a"), tx.strip(c).alias("b"), tx.split_lines(c).alias("c"), F.split(c, tx.LINE_BREAK, -1).alias("d"),
        tx.split_line_count(c).alias("n"), tx.holds(c, tx._UNCOMMON).alias("e"), c.rlike(tx.UNCOMMON_SPACE).alias("f"), tx.normalized_lines(c).alias("l"),
    ).collect():
        assert (r.a, r.c, r.n, r.e) == (r.b, r.d, len(r.t.splitlines()), r.f), r
        assert all("#" not in x.text and "//" not in x.text for x in r.l)
