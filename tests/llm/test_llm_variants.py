"""Spelling variants against a comparison of all pairs of words."""

from collections import Counter
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusvitals.llm import variants as var


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


WORDS = st.sets(st.text("abé", min_size=1, max_size=9) | st.text("aÿ", min_size=1, max_size=5), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_searches_find_each_near_word_once(words, others):
    words, asked = sorted(words), sorted(set(list(words)[::2]) | others)
    searcher = var.Searcher(words, asked)
    found = [np.concatenate(x).tolist() for x in zip(searcher.by_head(), searcher.by_tail())]
    pairs = sorted((asked[q], words[t]) for q, t in zip(*found))
    assert pairs == sorted((a, b) for a in asked for b in words if is_near(a, b))


def naive_words(rows, noise):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def naive(words):
    forms, rows = {}, {}
    keys = {}
    for w in words:
        for i in range(len(w)):
            keys.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for w in words:
        close = {t for i in range(len(w)) for t in keys[w[:i] + w[i + 1 :]]} | keys.get(w, set())
        close |= {w[:i] + w[i + 1 :] for i in range(len(w))} & set(words)
        near = sorted((t for t in close if t != w and is_near(t, w)), key=lambda t: (-words[t], t))
        form = near[0] if near and words[near[0]] >= 5 * words[w] else None
        forms[w] = form
        rows[w] = (words[w], len(near), form, words[form] if form else None)
    found = set()
    for w, (n, n_near, form, form_n) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, form, root, n, n_near, form_n))
    return found


def collected(table):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in table.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_rows(spark, nasty, empty, documents):
    for noise in (199, 3):
        words = naive_words(documents.select("doc_id", "text").collect(), noise)
        assert {tuple(r) for r in var.words_of(documents, noise).collect()} == set(words.items())
        wanted = naive(words)
        for block in (var.BLOCK, 100):  # of 100: halves with more words are dealt over several blocks
            assert collected(var.variants(documents, noise, block=block)) == wanted
    many = nasty.crossJoin(spark.range(5)).drop("id")
    assert collected(var.variants(many, 2)) == naive(naive_words(many.select("doc_id", "text").collect(), 2))
    assert var.variants(empty).collect() == []


def test_hot_halves(spark):
    words = {"common" + a + b for a in "abcdefgh" for b in "abcdefgh"} | {a + b + "thething" for a in "abcdefé" for b in "abcdef"}
    words = {w: 5 * 6 ** (i % 4) for i, w in enumerate(sorted(words))}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    wanted = {(w, n, n_near) for w, _, _, n, n_near, _ in naive(words)}
    for block in (1, 7, 1000):
        found = {(r.word, r.n, r.n_near) for r in var.nearest(table, block).collect()}
        assert found == wanted


def test_chains(spark):
    names = [f"w{i:03d}" for i in range(60)]
    forms = spark.createDataFrame(list(zip(names, names[1:])), "word string, form string")
    assert {tuple(r) for r in var.roots(forms).collect()} == {(n, names[-1]) for n in names[:-1]}
    assert var.roots(forms.limit(0)).collect() == []


def test_very_long_words(spark):
    long = "ab" * 2000
    rows = [(i, f"{long} {long[:1000]}x{long[1000:]}") for i in range(5)]
    docs = spark.createDataFrame(rows + [(9, long)] * 25, "doc_id long, text string")
    found = {len(r.word): (len(r.form or ""), r.n, r.n_near) for r in var.variants(docs).collect()}
    assert found == {4000: (0, 30, 1), 4001: (4000, 5, 1)}
