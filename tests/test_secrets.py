import random
import re

from pyspark.sql import functions as F
import pytest

from corpusvitals import rules
from corpusvitals.operators import findings as fnd, markers, secrets
from corpusvitals.operators.facts import code_facts


def scan(files, tree):
    return {
        (r.file, r.line, r.type, r.confidence, r.severity)
        for r in secrets.scan_secrets(files(tree)).collect()
    }


@pytest.mark.parametrize(
    "value,expected",
    [("xxxx", 15), ("0000", 15), ("xxx", 20), ("fake-1", 15), ("abcdefg", 20), ("abcdefgh", 55), (" Test ", 15)],
)
def test_confidence(spark, value, expected):
    row = spark.range(1).select(secrets.confidence(F.lit("Password"), F.lit(value)).alias("c"))
    assert row.first().c == expected


def test_shapes(files):
    found = scan(
        files,
        {
            "a.py": 'MY_API_KEY="v"\naccess-token="v"\n',
            "b.json": '"password": "x"\npwd=\'a"\n',
        },
    )
    assert found == {("a.py", 2, "Token", 20, "LOW"), ("b.json", 2, "Password", 20, "LOW")}


def test_sample_configuration(files):
    text = (
        'API_KEY = "fake_demo_key_123456789"\n\nPASSWORD = "demo_password_12345"\n\n'
        'password = input("Enter your password: ")\n\nTOKEN = "AbC123456789XYZ987"'
    )
    assert scan(files, {"tests/config.py": text}) == {("tests/config.py", 7, "Token", 90, "MEDIUM")}


def reference_matches(text):
    """Line, type, value and suppression by scanning one text directly."""
    out = []
    for kind, words in rules.SECRET_KEYWORDS.items():
        pattern = rf"""(?i)\b({words})\b\s*[:=]\s*["']([^"']+)["']"""
        for m in re.finditer(pattern, text):
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.end())
            line = text[start : len(text) if end < 0 else end].lower()
            out.append(
                (kind, text.count("\n", 0, m.start()) + 1, m.group(2), any(c in line for c in rules.INPUT_CALLS))
            )
    return sorted(out)


def test_lines_values_and_suppression_on_random_text(files):
    rnd = random.Random(1)
    bits = ['pwd = "a1"', "token: 'x\ny'", "\n", " ", "input(", "getpass(", '"', "api_key=\n'k'", "z\n", "PROMPT("]
    tree = {f"f{i}.py": "".join(rnd.choices(bits, k=rnd.randint(1, 25))) for i in range(150)}
    got = {p: [] for p in tree}
    for r in secrets.secret_matches(files(tree)).collect():
        got[r.file].append((r.type, r.line, r.value, r.suppressed))
    assert {p: sorted(v) for p, v in got.items()} == {p: reference_matches(t) for p, t in tree.items()}


def test_generated_wins_over_test(files):
    assert scan(files, {"tests/dist/x.py": 'token = "AbC123456789XYZ987"'}) == set()


def test_markers(files):
    found = markers.work_markers(files({"a.py": "TODO todo\nTODOS\n# fixme:", "dist/a.py": "TODO"}))
    assert sorted((r.line, r.type) for r in found.collect()) == [
        (1, "TODO Marker"), (1, "TODO Marker"), (3, "FIXME Marker"),
    ]


def test_every_keyword_has_a_stem():
    for words in ("api_key", "apikey", "API-KEY", "secretkey", "secret_key", "password", "passwd", "pwd", "token", "auth_token"):
        assert any(re.fullmatch(p, words, re.I) for p in rules.SECRET_KEYWORDS.values())
        assert any(stem in words.lower() for stem in rules.SECRET_STEMS)
    for pattern in rules.SECRET_KEYWORDS.values():
        for option in pattern.split("|"):
            assert any(stem in option for stem in rules.SECRET_STEMS)


def test_own_rules_of_a_repository_differ_only_there(spark):
    text = 'api_key = "AbC123456789XYZ987"\nsession = "AbC123456789XYZ987"\npwd = "AbC123456789XYZ000"\n'
    files = spark.createDataFrame([(r, "a.py", text) for r in ("own", "other", "off")], "repo_id string, path string, content string")
    overrides = spark.createDataFrame([("own", "Session", "session"), ("own", "API Key", "[x]"), ("off", "Password", None), ("gone", "Token", "t")], "repo_id string, type string, keywords string")
    words = spark.createDataFrame([("own", "abc123456789xyz000"), ("gone", "x")], "repo_id string, word string")
    found = {(r.repo_id, r.type, r.line) for r in secrets.scan_secrets(files, overrides, words).collect()}
    plain = {(r.repo_id, r.type, r.line) for r in secrets.scan_secrets(files).collect()}
    assert found == {("own", "Session", 2), ("other", "API Key", 1), ("other", "Password", 3), ("off", "API Key", 1)}
    assert {f for f in plain if f[0] == "other"} == {f for f in found if f[0] == "other"}
    facts = code_facts(files.withColumn("size_bytes", F.lit(1)), overrides)
    assert {(r.repo_id, r.type, r.line) for r in fnd.secret_findings(facts, words).collect()} == found
