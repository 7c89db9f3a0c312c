"""Duplicate blocks against a direct all-pairs comparison."""

import itertools
import random
import re
from types import SimpleNamespace

import pytest

from corpusvitals.operators import duplicates
from corpusvitals.schemas import ADVISORY_SCHEMA, DEPENDENCY_SCHEMA
from driver import queries


def normalized(text):
    lines = []
    for number, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"\s+", " ", re.sub("#.*$", "", re.sub("//.*$", "", line))).strip()
        if line:
            lines.append((line, number))
    return lines


def brute_force(rows):
    texts = {(r, p): normalized(c) for r, p, c in rows}
    found = set()
    for (ra, a), (rb, b) in itertools.combinations(sorted(texts), 2):
        if ra != rb:
            continue
        x, y, best = texts[ra, a], texts[rb, b], None
        for i, j in itertools.product(range(len(x) - 7), range(len(y) - 7)):
            same = [x[i + k][0] == y[j + k][0] for k in range(8)]
            if not all(same[:3]) or sum(same) < 7:
                continue
            n = 8
            while i + n < len(x) and j + n < len(y) and x[i + n][0] == y[j + n][0]:
                n += 1
            if best is None or (n, sum(same)) > best[:2]:
                best = (n, sum(same), x[i][1], y[j][1])
        if best:
            found.add((ra, a, best[2], b, best[3], best[0], best[1]))
    return found


def random_tree(seed):
    rnd = random.Random(seed)
    base = [rnd.choice("abcdef") + str(rnd.randint(0, 2 + seed)) for _ in range(50)]
    for n in range(30):
        lines, kind = list(base), rnd.choice(["copy", "near", "noise", "slice", "runs"])
        if kind == "near":
            for _ in range(rnd.randint(1, 6)):
                lines[rnd.randrange(len(lines))] = f"z{rnd.randint(0, 2)}"
        elif kind == "noise":
            lines = [rnd.choice("ab") for _ in range(rnd.randint(0, 30))]
        elif kind == "slice":
            at = rnd.randrange(45)
            lines = lines[at : at + rnd.randint(5, 30)]
        elif kind == "runs":
            lines = ["a"] * rnd.randint(5, 20) + ["b"] * rnd.randint(0, 12) + ["a"] * rnd.randint(0, 9)
        if rnd.random() < 0.4:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(["", "  # c", "// x"]))
        yield (f"r{n % 2}", f"f{n:02d}.py", "\n".join(lines))


PAIR = ("repo_id", "file", "line", "file_2", "line_2", "duplicate_lines", "matching")


def check_classes(files, rows, expected):
    """Classes with members say what the list of all pairs says."""
    comparable = duplicates.staged_files(files)
    matches = duplicates.class_matches(comparable)
    members = {}
    for r in duplicates.class_members(comparable).collect():
        members.setdefault((r.repo_id, r[1]), []).append(r.file)
        assert r.n_files == len([m for m in rows if m[0] == r.repo_id and normalized(m[2]) == normalized(dict((p, c) for q, p, c in rows if q == r.repo_id)[r.file])])
    linked, n = set(), 0
    for r in duplicates.class_blocks(comparable, matches).collect():
        assert tuple(r[c] for c in PAIR) in expected
        x, y = members[r.repo_id, r[1]], members[r.repo_id, r.class_2]
        assert (r.file, r.file_2) == ((min(x), sorted(x)[1]) if r[1] == r.class_2 else (min(x), min(y)))
        pairs = {(r.repo_id, *sorted(p)) for p in itertools.product(x, y) if p[0] != p[1]}
        assert r.n_pairs == len(pairs)
        linked |= pairs
        n += r.n_pairs
    assert linked == {(e[0], e[1], e[3]) for e in expected} and n == len(expected)
    for k in (1, 4):
        firsts = {(r, f) for r in {e[0] for e in expected} for f in sorted({e[1] for e in expected if e[0] == r})[:k]}
        found = [tuple(r[c] for c in PAIR) for r in duplicates.first_blocks(comparable, k, matches).collect()]
        assert sorted(found) == sorted(e for e in expected if (e[0], e[1]) in firsts)


@pytest.mark.parametrize("seed,salt_rows", [(0, 2000), (3, 7)])
def test_matches_all_pairs_comparison(spark, monkeypatch, seed, salt_rows):
    monkeypatch.setattr(duplicates, "SALT_ROWS", salt_rows)
    rows = list(random_tree(seed))
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    got = duplicates.duplicate_blocks(files)
    got = {
        tuple(r)
        for r in got.select(
            "repo_id", "file", "line", "file_2", "line_2", "duplicate_lines", "matching"
        ).collect()
    }
    expected = brute_force(rows)
    assert expected
    assert got == expected
    check_classes(files, rows, expected)
    counts = {r.repo_id: r.n_pairs for r in duplicates.duplicate_pair_counts(files).collect()}
    assert counts == {
        repo: sum(e[0] == repo for e in expected) for repo in {e[0] for e in expected}
    }


def test_hot_block_shared_by_a_third_of_all_files(spark):
    header = [f"header {i}" for i in range(8)]
    rows = [
        ("r", f"f{n:03d}.py", "\n".join((header if n % 3 == 0 else []) + [f"body {n} {i}" for i in range(9)]))
        for n in range(90)
    ]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    found = duplicates.duplicate_blocks(files).collect()
    assert len(found) == 30 * 29 // 2
    assert {(r.duplicate_lines, r.matching, r.line) for r in found} == {(8, 8, 1)}


def test_generated_files_and_short_files_are_left_out(spark):
    text = "\n".join(f"line {i}" for i in range(8))
    rows = [("r", "a.py", text), ("r", "dist/b.py", text), ("r", "c.py", text[:-7]), ("q", "d.py", text)]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    assert duplicates.duplicate_blocks(files).count() == 0


def test_every_copy_is_named(spark):
    text = "\n".join(f"line {i}" for i in range(9))
    near = text.replace("line 8", "line z")
    rows = [("r", f"f{n}.py", text) for n in range(4)] + [("r", "g0.py", near), ("r", "g1.py", near), ("q", "h.py", text)]
    comparable = duplicates.staged_files(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    found = {(r.file, r.file_2): r.n_pairs for r in duplicates.class_blocks(comparable, members=True).collect()}
    assert found == {
        ("f0.py", "f1.py"): 4, ("f0.py", "f2.py"): 1, ("f0.py", "f3.py"): 1,
        ("g0.py", "g1.py"): 1, ("f0.py", "g0.py"): 8,
    }


def copies_and_near_copies():
    """Three copies and two near ones: all ten pairs share a block."""
    text = "\n".join(f"line {i}" for i in range(9))
    rows = [("r", f"f{n}.py", text) for n in range(3)] + [("r", f"g{n}.py", text.replace("line 8", "line z")) for n in range(2)]
    return rows, set(itertools.combinations([p for _, p, _ in rows], 2))


def test_query_lists_every_pair_of_files(spark):
    rows, pairs = copies_and_near_copies()
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    found = queries.duplicate_blocks(SimpleNamespace(files_by_lang=files)).collect()
    assert sorted((r.file, r.file_2) for r in found) == sorted(pairs)
    assert {(r["class"], r.class_2) for r in found} == {("f0.py", "f0.py"), ("f0.py", "g0.py"), ("g0.py", "g0.py")}
    assert {r.n_pairs for r in found} == {1}


def test_diagnosis_lists_every_pair_of_files(spark):
    rows, pairs = copies_and_near_copies()
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    tables = SimpleNamespace(
        files_decorated=files, files_code=files.where("false"),
        deps=spark.createDataFrame([], DEPENDENCY_SCHEMA), advisories=spark.createDataFrame([], ADVISORY_SCHEMA),
    )
    found = [r for r in queries.diagnosis(tables).collect() if r.type == "Duplicate Code"]
    assert sorted(r.file for r in found) == sorted(file for file, _ in pairs)
    assert {r.occurrences for r in found} == {1}


def test_rows_that_come_twice_are_pairs_as_they_are_counted(spark):
    rows, pairs = copies_and_near_copies()
    twice = spark.createDataFrame(rows + rows[:1], "repo_id string, path string, content string")
    found = sorted((r.file, r.file_2) for r in duplicates.duplicate_blocks(twice).collect())
    assert found == sorted([*pairs, *(p for p in pairs if "f0.py" in p), ("f0.py", "f0.py")])
    assert [r.n_pairs for r in duplicates.duplicate_pair_counts(twice).collect()] == [len(found)]
