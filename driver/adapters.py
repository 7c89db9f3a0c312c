"""Views that turn the driver's tables into the inputs the library works on.

Each view is one SELECT in the dialect Spark and DuckDB share, so both sides
of a comparison read the same rows. ``@name`` stands for a driver table.
"""

import os
import re

from pyspark.sql import DataFrame, SparkSession

from corpusvitals.session import exists, track, work_dir


def lit(text: str) -> str:
    """SQL expression for a text; no escapes, which the engines read apart."""
    special = {"\n": "chr(10)", "'": "chr(39)", "\\": "chr(92)", "$": "chr(36)"}
    parts = [
        special.get(part) or f"'{part}'" for part in re.split(r"([\n'\\$])", text) if part
    ]
    return "(" + " || ".join(parts or ["''"]) + ")"


def choose(expr: str, values: list) -> str:
    """CASE over 0, 1, 2, ... with texts."""
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {arms} END)"


TREE_DIRS = ["src", "tests", "generated", "lib/__tests__", "build/out", "pkg", "app/components"]
TREE_EXTENSIONS = [".py", ".js", ".css"]

SNIPPETS = [
    "",
    "# TODO: tidy up\nx = 1\n",
    'API_KEY = "aB3dE5gH7jK9mN1p"\napi_key = "aB3dE5gH7jK9mN1p"\n',
    "pwd = 'ab12'\n",
    'secret_key: "your_secret_here"\n',
    'password = input("password: ")\ny = "z"\n',
    "import Main, { useState as state, unused } from 'lib';\n"
    "function show(a) {\n  if (a) { return state(Main); }\n  return a ? 1 : 2;\n}\n",
    "import os\nimport sys as system\nfrom json import loads\n\n"
    "def read(x):\n    return loads(os.name) if x else None\n",
    "# hack, fixme: todo TODO\n",
    'token = "abcdefghijklmnopqrstuvwxyz0123456789"\n',
]

_ID = "CAST(doc_id AS STRING)"
_NUMBER = f"lpad({_ID}, 9, '0')"

FILES_PLAIN = f"""
SELECT source AS repo_id, 'src/f' || {_NUMBER} || '.py' AS path, text AS content
FROM @documents"""

# line ends of three kinds: counts of either sort differ
FILES_BREAKS = f"""
SELECT source AS repo_id, 'src/f' || {_NUMBER} || '.py' AS path,
       replace(replace(text, '. ', chr(12)), ', ', chr(133)) AS content
FROM @documents"""

# whole corpus grouped so that most duplicated texts share a repository
FILES_BY_LANG = f"""
SELECT lang AS repo_id, 'src/f' || {_NUMBER} || '.py' AS path, text AS content
FROM @documents"""

FILES_DECORATED = f"""
SELECT source AS repo_id,
       {choose('doc_id % 7', TREE_DIRS)} || '/f' || {_NUMBER} || {choose('doc_id % 3', TREE_EXTENSIONS)} AS path,
       text || chr(10) || {choose('doc_id % 10', SNIPPETS)} AS content
FROM @documents"""

LISTING_DIRS = [
    "src/", "tests/", "node_modules/x/", "build/", "Build/", "app/.git/", "Pods/",
    "lib/vendor/a/", "docs/", "out/", "", "pkg/env/", "a/coverage/",
]
LISTING_NAMES = [
    "mod.py", "mod.js", "MOD.PY", "notes.txt", "Mod.java", "view.tsx", "Makefile", "x.h",
    "a.css", "a.min.js", "Cargo.lock", "main.go", "x.scss", "x.spec.js", "test_x.py",
    "vite.config.mjs", "jest.config.ts", "x_test.py", "requirements.txt", "Package.json",
    "pom.xml", "BUILD.gradle", ".hidden.py", ".py", "x.",
]

# names, folders and sizes around every scan rule
LISTING = f"""
SELECT source AS repo_id,
       {choose('doc_id % 13', LISTING_DIRS)} || 'd' || {_ID} || '/'
         || {choose('doc_id % 25', LISTING_NAMES)} AS path,
       n_chars * 2500 AS size_bytes
FROM @documents"""

# the same paths with the texts, one folder for each file
FILES_LISTED = f"""
SELECT source AS repo_id,
       {choose('doc_id % 13', LISTING_DIRS)} || 'd' || {_ID} || '/'
         || {choose('doc_id % 25', LISTING_NAMES)} AS path,
       text AS content
FROM @documents"""

ROOT_NAMES = ["README.md", "docs/readme.md", "ReadMe", "main.py", "README.rst", "readme.TXT", "x/README"]
ROOTS = f"""
SELECT 'repo' || CAST(doc_id % 49 AS STRING) AS repo_id, {choose('doc_id % 7', ROOT_NAMES)} AS path
FROM @documents"""

CONFIGS_SHAPES = [
    '{"thresholds": {"python": 20, "css": 0, "html": true}}',
    '{"thresholds": {"python": -1, "javascript": "9", "css": 30}}',
    "not json",
    '["thresholds"]',
    '{"thresholds": [1]}',
    '{"thresholds": {"javascript": 25, "html": 2.5}}',
    '{"other": 1}',
]
CONFIGS = f"""
SELECT 'src' || CAST(doc_id AS STRING) AS repo_id, {choose('doc_id % 7', CONFIGS_SHAPES)} AS content
FROM (SELECT doc_id FROM @documents) d"""

# thresholds that differ by type of file and by repository
REPO_CONFIGS_SHAPES = [
    '{"thresholds": {"python": 12, "javascript": 30, "css": 16}}',
    '{"thresholds": {"css": 9, "python": "x", "html": 14}}',
    "broken",
]
REPO_CONFIGS = f"""
SELECT repo_id, {choose('CAST(substr(repo_id, 4) AS INT) % 3', REPO_CONFIGS_SHAPES)} AS content
FROM (SELECT DISTINCT source AS repo_id FROM @documents) d"""

# texts under names of many types, longer by the row's number
FILES_TYPED = f"""
SELECT source AS repo_id,
       'src/d' || {_ID} || '/' || {choose('doc_id % 7', ['a.py', 'b.js', 'c.tsx', 'd.css', 'e.scss', 'f.html', 'g.go'])} AS path,
       text || repeat(chr(10) || 'x', CAST(doc_id * 37 % 1500 AS INT)) AS content
FROM @documents"""

# rules of single repositories: another keyword, a type of their own, a type switched off; words that are no secrets
SECRET_OVERRIDES = """
SELECT * FROM (SELECT DISTINCT source AS repo_id FROM @documents) d,
  (SELECT 'API Key' AS type, 'nothing' AS keywords, 1 AS m UNION ALL SELECT 'Letter', 'y|x', 1 UNION ALL SELECT 'Password', NULL, 2) o
WHERE CAST(substr(repo_id, 4) AS INT) % 4 = m"""
PLACEHOLDERS = """
SELECT DISTINCT source AS repo_id, 'AB3DE5GH7JK9MN1P' AS word FROM @documents WHERE CAST(substr(source, 4) AS INT) % 4 = 3"""

# --- code: the text as comments, then code whose shape depends on the row ----



_PY_BODY = " || ".join(
    [
        lit("\nimport os\nimport sys as system\nfrom json import loads\n\n"),
        f"'def work_' || {_ID}",
        lit("(x, y):\n    total = 0\n"),
        f"repeat({lit('    if x and y_')} || {_ID} || {lit(':') } || chr(10) || {lit('        total += x')} || chr(10), CAST(doc_id % 23 AS INT))",
        lit("    return total if x else y\n\n"),
        f"'def tail_' || {_ID}",
        lit("(z):\n    value = os.name\n"),
        f"repeat({lit('    value = value + ')} || {_ID} || chr(10), CAST((doc_id * 7) % 190 AS INT))",
        lit("    return [i for i in value for j in z if j]\n"),
        f"CASE WHEN doc_id % 3 = 0 THEN {lit('loads(1)')} || chr(10) ELSE '' END",
    ]
)
_JS_BODY = " || ".join(
    [
        lit(
            "\nimport React, { useState, useEffect as effect, type Props } from 'react';\n"
            'import helper from "./helper";\n'
        ),
        f"'function main_' || {_ID}",
        lit("(a, b) {\n  const out = [];\n"),
        f"repeat({lit('  if (a) { b(' + chr(39) + '(' + chr(39) + ', ')} || {_ID} || {lit('); }')} || chr(10), CAST(doc_id % 19 AS INT))",
        lit(
            "  const pick = a ? b : a ?? b;\n  out.map((item) => {\n"
            "    if (item) { return helper("
        ),
        _ID,
        lit("); }\n    return item;\n  });\n  return useState(out);\n}\n"),
        f"'const arrow_' || {_ID}",
        lit(" = async (q) => {\n  switch (q) {\n    case 1: return "),
        _ID,
        lit(";\n    case 2: return 0;\n  }\n"),
        f"repeat({lit('  while (q) { q = q.next; q.id(')} || {_ID} || {lit('); }')} || chr(10), CAST(doc_id % 13 AS INT))",
        lit("  return q;\n};\n"),
        f"CASE WHEN doc_id % 5 = 0 THEN {lit('const view = <Panel />;')} || chr(10) ELSE '' END",
    ]
)

FILES_CODE = f"""
SELECT source AS repo_id,
       {choose('doc_id % 7', TREE_DIRS)} || '/f' || {_NUMBER}
         || (CASE doc_id % 2 WHEN 0 THEN '.py' ELSE '.js' END) AS path,
       CASE doc_id % 2
         WHEN 0 THEN '# ' || replace(text, chr(10), chr(10) || '# ') || {_PY_BODY}
         ELSE '// ' || replace(text, chr(10), chr(10) || '// ') || {_JS_BODY}
       END AS content
FROM @documents"""

# --- manifests ----------------------------------------------------------------

_PINS = [
    "flask==2.0.1  # web\nrequests>=2.25.1,<3\n",
    "numpy\n-r other.txt\n#none==1\npandas[all]==1.0\n",
    "scipy!=1.2\nattrs===1\n  black ~= 22.1\n",
    "torch<2 ; python_version<'3'\ngit+https://host/x\n",
    "flask==2.0.1\nflask==2.0.1\n",
]
MANIFESTS_REQUIREMENTS = f"""
SELECT source AS repo_id, 'd' || {_ID} || '/requirements.txt' AS path,
       text || chr(10) || {choose('doc_id % 5', _PINS)} AS content
FROM @documents"""

_NPM_TAIL = [
    '},"devDependencies":{"tool":"^1.2.3"}}',
    '},"devDependencies":{"tool":"latest"},"peerDependencies":{"tool":"2.0.0"}}',
    '},"devDependencies":"none","optionalDependencies":{"opt":">=1.2.3 <2.0.0"}}',
    '},"peerDependencies":{"host":{"version":"1.2.3"},"num":5}}',
    "}",
]
MANIFESTS_PACKAGE = f"""
SELECT 'repo' || CAST(o_custkey % 50 AS STRING) AS repo_id,
       'o' || CAST(o_orderkey AS STRING) || '/package.json' AS path,
       {lit('{"name":"x","dependencies":{"pkg')} || CAST(o_custkey % 200 AS STRING)
         || {lit('":"^')} || CAST(o_orderkey % 9 AS STRING) || '.' || CAST(o_custkey % 7 AS STRING)
         || {lit('.0-rc.1","lib')} || CAST(o_orderkey % 11 AS STRING) || {lit('":"~1.x"')}
         || {choose('o_orderkey % 5', _NPM_TAIL)} AS content
FROM @orders"""

_POM_VERSIONS = [
    "<version>6.1.0</version>", "", "<version>${spring.version}</version>",
    "<version>1.${minor}</version>", "<version> 2.0 </version>",
]
MANIFESTS_POM = f"""
SELECT 'repo' || CAST(p_partkey % 50 AS STRING) AS repo_id,
       'p' || CAST(p_partkey AS STRING) || '/pom.xml' AS path,
       {choose('p_partkey % 2', ['<project>', '<project xmlns="http://maven.apache.org/POM/4.0.0">'])}
         || '<dependencies><dependency><groupId>org.' || lower(p_type) || '</groupId>'
         || '<exclusions><exclusion><groupId>no</groupId></exclusion></exclusions>'
         || (CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '<artifactId>' || replace(p_name, ' ', '-') || '</artifactId>' END)
         || {choose('p_partkey % 5', _POM_VERSIONS)} || '</dependency></dependencies></project>' AS content
FROM @part"""

_GRADLE = [
    "implementation 'org.a:one:1.0'\napi(\"org.a:two:2.0\")\n",
    "// api 'org.no:no:1'\n/* runtimeOnly 'org.no:no:2'\n*/ testImplementation 'org.b:x:$v'\n",
    "compileOnly \"org.c:y:${ver}\"\ncompileOnly 'org.c:y:3'\ncompile 'org.d:z:1'\n",
]
MANIFESTS_GRADLE = f"""
SELECT source AS repo_id, 'd' || {_ID} || '/build.gradle' AS path,
       text || chr(10) || {choose('doc_id % 3', _GRADLE)} AS content
FROM @documents"""

MANIFESTS = " UNION ALL ".join(
    [MANIFESTS_REQUIREMENTS, MANIFESTS_PACKAGE, MANIFESTS_POM, MANIFESTS_GRADLE]
)

# --- dependencies, advisories, registry, history --------------------------------

DEPS = """
SELECT 'repo' || CAST(l_orderkey % 50 AS STRING) AS repo_id,
       'm' || CAST(l_orderkey % 4 AS STRING) AS manifest_path,
       CASE l_returnflag WHEN 'A' THEN 'PyPI' WHEN 'N' THEN 'npm' ELSE 'Maven' END AS ecosystem,
       'pkg' || CAST(l_partkey % 200 AS STRING) AS name,
       CASE WHEN l_suppkey % 10 = 0 THEN 'unspecified'
            ELSE CAST(l_linenumber AS STRING) || '.' || CAST(CAST(floor(l_quantity) AS INT) % 5 AS STRING)
                 || '.' || CAST(l_suppkey % 3 AS STRING) END AS version
FROM @lineitem"""

ADVISORIES = """
SELECT CASE event_id % 3 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'npm' ELSE 'Maven' END AS ecosystem,
       'pkg' || CAST(user_id AS STRING) AS name,
       CAST(event_id % 7 + 1 AS STRING) || '.' || CAST(event_id % 5 AS STRING) || '.'
         || CAST(CAST(floor(value) AS INT) % 3 AS STRING) AS version,
       'ADV-' || CAST(event_id AS STRING) AS vuln_id,
       CASE WHEN value < 5 THEN 'LOW' WHEN value < 20 THEN 'medium' WHEN value < 60 THEN 'HIGH'
            WHEN value < 90 THEN 'CRITICAL' END AS severity,
       CASE WHEN event_id % 4 = 0 THEN 'critical' WHEN event_id % 4 = 1 THEN 'odd' END AS db_severity
FROM @events WHERE event_type = 'error'"""

# records that give ranges: from 0 or a version on, up to a fix (one in ten a pre-release),
# a last affected version or nothing; some with a second range, some with a listed version
ADVISORY_RECORDS = """
SELECT *, CASE WHEN event_id % 4 = 0 THEN '0'
            ELSE CAST(major AS STRING) || '.' || CAST(minor AS STRING) || '.' || CAST(event_id % 3 AS STRING) END AS introduced,
       CASE WHEN event_id % 3 = 0 THEN CAST(major + 1 AS STRING) || '.' || CAST(minor AS STRING) || '.0'
            || (CASE WHEN event_id % 10 <> 0 THEN '' WHEN ecosystem = 'npm' THEN '-rc.1' WHEN ecosystem = 'PyPI' THEN 'rc1' ELSE '-rc-1' END) END AS fixed,
       CASE WHEN event_id % 3 = 1 THEN CAST(major AS STRING) || '.' || CAST(minor + 2 AS STRING) || '.0' END AS last_affected,
       CASE WHEN event_id % 5 = 0 THEN CAST(major + 3 AS STRING) || '.0.0' END AS again,
       CASE WHEN event_id % 5 = 0 THEN CAST(major + 4 AS STRING) END AS fixed_again,
       CASE WHEN event_id % 7 = 0 THEN '7.0.0' END AS listed
FROM (SELECT event_id, event_id % 7 AS major, event_id % 5 AS minor,
             CASE event_id % 3 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'npm' ELSE 'Maven' END AS ecosystem,
             'pkg' || CAST(user_id AS STRING) AS name, 'RNG-' || CAST(event_id AS STRING) AS vuln_id,
             CASE WHEN value < 20 THEN 'medium' WHEN value < 60 THEN 'HIGH' WHEN value < 90 THEN 'CRITICAL' END AS severity,
             CASE WHEN event_id % 4 = 1 THEN 'critical' END AS db_severity
      FROM @events WHERE event_type = 'error') e"""

REGISTRY = """
SELECT CASE p_partkey % 2 WHEN 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem,
       'pkg' || CAST(p_partkey AS STRING) AS name,
       CAST(p_size % 8 AS STRING) || '.' || CAST(p_partkey % 6 AS STRING) || '.'
         || CAST(p_partkey % 4 AS STRING) AS latest
FROM @part"""

COMMITS = """
SELECT 'repo' || CAST(user_id % 10 AS STRING) AS repo_id, CAST(event_id AS STRING) AS commit_id,
       'user' || CAST(user_id AS STRING) AS author_name,
       'u' || CAST(user_id % 40 AS STRING) || '.mail' AS author_email, ts, event_type AS subject
FROM @events"""

BRANCHES = """
SELECT DISTINCT 'repo' || CAST(user_id % 10 AS STRING) AS repo_id, event_type AS name
FROM @events"""

ALL_REPOS = """
SELECT DISTINCT 'repo' || CAST(user_id % 13 AS STRING) AS repo_id FROM @events"""

REQUESTS = """
SELECT CAST(user_id AS STRING) AS key, ts, event_id FROM @events WHERE event_type = 'view'"""

LOOKUPS = """
SELECT CAST(user_id AS STRING) AS key, ts FROM @events WHERE event_type = 'purchase'"""


def for_duckdb(view: str) -> str:
    return re.sub(r"@(\w+)", r"\1", view)


_spread = {}


def _spread_out(spark: SparkSession, path: str) -> str:
    """A table in one single file is one task for whatever reads it, so it
    is rewritten once per session into a file per core."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _spread or not exists(spark, _spread[key]):  # the copy may have been cleared
        table = spark.read.parquet(path)
        _spread[key] = path
        if len(table.inputFiles()) == 1:
            copy = work_dir(spark, "spread")
            table.repartition(spark.sparkContext.defaultParallelism).write.parquet(copy)
            _spread[key] = track(spark, copy)
    return _spread[key]


def _spark_table(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = f"{sf_dir}/{name}.parquet"
    if name == "documents":
        path = _spread_out(spark, path)
    return f"parquet.`{path}`"


def write_trees(table: DataFrame, root: str) -> None:
    """Files ``root/repo_id/path`` on a file system that all executors see."""

    def write(rows) -> None:
        for row in rows:
            full = os.path.join(root, row.repo_id, row.path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as file:
                file.write(row.content.encode())

    table.select("repo_id", "path", "content").foreachPartition(write)


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return spark.sql(re.sub(r"@(\w+)", lambda m: _spark_table(spark, sf_dir, m.group(1)), view))
