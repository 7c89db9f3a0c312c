"""Quality rules: the suffix array against a search of all pairs of places."""

from collections import defaultdict
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusvitals.llm import repetition as rep


def longest_common(s, i, j):
    n = 0
    while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
        n += 1
    return n


def brute(s, least):
    """(covered places, longest, number of maximal repeats), from all pairs of places."""
    covered, longest = set(), 0
    for i in range(len(s)):
        best = max((longest_common(s, i, j) for j in range(len(s)) if j != i), default=0)
        if best >= least:
            longest = max(longest, best)
            covered.update(range(i, i + best))
    places = defaultdict(list)
    for i in range(len(s)):
        for n in range(least, len(s) - i + 1):
            places[tuple(s[i : i + n])].append(i)
    maximal = 0
    for part, at in places.items():
        after = {s[i + len(part)] if i + len(part) < len(s) else None for i in at}
        before = {s[i - 1] if i else None for i in at}
        maximal += len(at) > 1 and len(after) > 1 and len(before) > 1
    return covered, longest, maximal


SYMBOLS = st.integers(1, 3) | st.integers(1, 2**20)


@settings(max_examples=300, deadline=None)
@given(st.lists(SYMBOLS, max_size=25), st.integers(0, 25), st.integers(1, 12))
def test_repeats_are_those_of_all_pairs(part, again, least):
    s = [*part, *part[:again], *part[again:]]
    found = rep.repeats(np.array(s, np.int64), least)
    covered, longest, maximal = brute(s, least)
    assert {i for a, b in found.spans for i in range(a, b)} == covered
    assert (found.covered, found.longest, found.n_maximal) == (len(covered), longest, maximal)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3) | st.just(2**40), max_size=30), st.integers(1, 4))
def test_windows(words, size):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(size)}
    assert rep.repeated_windows(np.array(words, np.int64), size) == len(inside)


def test_long_repeats_are_measured_to_their_end():
    rng = np.random.default_rng(1)
    part = rng.integers(1, 100, 40_000)
    s = np.concatenate([part, [101], part, [102], part[:9_000], [103], part[:9_000]])
    found = rep.repeats(s, 50)
    assert found.spans == [(0, 80_001 - 40_001), (40_001, 80_001), (80_002, 89_002), (89_003, 98_003)]
    assert found.longest == 40_000 and found.n_maximal == 2
    assert rep.repeats(np.ones(100_000, np.int64), 50).longest == 99_999


def naive(text, rules):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = defaultdict(int)
    for w in windows:
        counts[w] += 1
    repeat = len({i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)})
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed


def test_rows(nasty, empty, documents):
    for docs in (nasty, documents):
        rows = rep.apply_rules(docs).collect()
        texts = docs.select("doc_id", "text").collect()
        assert [r.doc_id for r in rows] == [t.doc_id for t in texts]
        for row, (_, text) in zip(rows, texts):
            assert tuple(row[1:7]) == naive(text, rep.Rules())
            assert row.covered_chars == sum(s.end - s.start for s in row.spans)
            if len(text or "") < 400:
                covered, longest, maximal = brute(text or "", rep.MIN_CHARS)
                assert (row.covered_chars, row.longest_repeat, row.n_maximal_repeats) == (len(covered), longest, maximal)
            limits = row.covered_chars <= 0.3 * row.n_chars and row.longest_repeat <= 0.2 * row.n_chars
            assert row.kept == (not row.base_failed and limits)
    assert rep.apply_rules(empty).collect() == rep.keep_passing(empty).collect() == []


def test_the_method_judges_what_the_base_rules_pass(spark):
    rng = np.random.default_rng(2)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghiö😀"), 5)) for _ in range(n))

    passage = prose(20)
    glued = passage.replace(" ", "é")  # one long word, twice: no window of words repeats
    rows = [
        (1, prose(200), True),
        (2, f"{prose(60)} {glued} {prose(9)} {glued}", False),  # too much is covered
        (3, f"{prose(600)} {passage} {prose(5)} {passage}", True),  # a short repeat in a long text
        (4, f"{prose(120)} x{'ab' * 300}", False),  # one word that repeats itself
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in rep.apply_rules(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {i: r.kept for i, r in found.items()} == {i: kept for i, _, kept in rows}
    text, spans = rows[2][1], found[3].spans
    assert len(spans) == 2 and all(passage in text[s.start : s.end] for s in spans)
    assert [r.doc_id for r in rep.keep_passing(docs).collect()] == [1, 3]
    strict = rep.Rules(max_covered=0.0)
    assert [r.doc_id for r in rep.keep_passing(docs, strict).collect()] == [1]
