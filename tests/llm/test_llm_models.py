"""Quality and toxicity: exact identities, held-out accuracy, searched paths."""

from itertools import product
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusvitals.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    size = quality.WORD_BUCKETS + len(quality.STATISTICS) * (1 + quality.BINS)
    k = len(quality.STATISTICS)
    machine = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), np.zeros(k), np.ones(k), np.zeros((k, quality.BINS - 1)))
    index, x = machine.row(*quality.describe("A few words, a FEW more!! words"))
    pairs = sum(machine.factors[index[i]] @ machine.factors[index[j]] * x[i] * x[j] for i in range(len(index)) for j in range(i))
    assert machine.margin(index, x)[0] == pytest.approx(0.3 + machine.linear[index] @ x + pairs)


def auc(pairs):
    ones = [s for s, y in pairs if y]
    zeros = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").filter(F.col(label).isNotNull()).select("score", label, "predicted").collect()
    assert len(rows) > 300
    return auc([(r.score, r[label]) for r in rows]), sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_held_out(tables):
    docs, labels = tables
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.count() == docs.count()
    area, accuracy = held_out(scored, labels, "quality")
    assert area > 0.95 and accuracy > 0.95, (area, accuracy)


def test_toxicity_held_out(tables):
    docs, labels = tables
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.count() == docs.count()
    area, accuracy = held_out(scored, labels, "toxic")
    assert area > 0.95 and accuracy > 0.97, (area, accuracy)


def test_labels_held_out_are_never_read(spark, tables):
    docs, labels = tables
    docs, labels = docs.filter("doc_id < 400"), labels.filter("doc_id < 400")
    turned = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned = turned.withColumn("toxic", F.when(quality.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = quality.train(docs, labels), quality.train(docs, turned)
    assert one.bias == two.bias and (one.factors == two.factors).all()
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.bias, a.weights) == (b.bias, b.weights)


def test_nasty_rows(spark, nasty, empty, tables):
    docs, labels = tables
    some = docs.filter("doc_id < 300")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for model in (module.train(some, labels), module.train(empty, labels), module.train(nasty, labels.limit(0))):
            rows = module.score(nasty, model).collect()
            assert len(rows) == nasty.count() and all(0 <= r.score <= 1 for r in rows)
            assert all(r.predicted == int(r.score >= 0.5) for r in rows)
            assert module.score(empty, model).collect() == []
        nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
        module.train(nasty, nulls)
    kept = quality.keep_good(nasty, quality.train(some, labels))
    assert kept.columns == nasty.columns


@pytest.fixture(scope="module")
def model():
    text = "you are an idiot and a moron, this is stupid trash, crap from an evil ass. the total of it is what it is, a mitt to hold, so stop. " * 50
    row = np.concatenate(([0, 0], toxicity.codes(text), [0])).astype(np.int64)
    grams = (row[:-2] * toxicity.SYMBOLS + row[1:-1]) * toxicity.SYMBOLS + row[2:]
    found, counts = np.unique(grams, return_counts=True)
    return toxicity.LanguageModel.of(found, counts.astype(float))


@pytest.mark.parametrize(
    "seen, hidden",
    [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("stuuuupid", "stupid"), ("7r@$h", "trash"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("s t u p 1 d", "stupid"), ("total", "total"), ("2024", "2024"),
     ("i  d  i  o  t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("i\nd\n\ni\no\nt", "idiot"), ("i/d/i/o/t", "idiot"), ("i~d~i~o~t", "idiot"), ("id.io.t", "idiot"),
     ("m,o,r,o,n", "moron"), ("4$$", "ass"), ("(rap", "crap"), ("(stop)", "stop"), ("(stop", "stop"), ("evi!", "evil"), ("stop!", "stop"), ("12/05/2024", "12/05/2024"),
     ("$4 |", "$4 |"), ("!!!", ""), ("", "")],
)
def test_restored(model, seen, hidden):
    assert toxicity.restore(seen, model) == hidden


def test_viterbi_finds_the_best_path(model):
    rng = random.Random(2)
    table = model.table

    def value(path):
        total, x, y = 0.0, 0, 0
        for piece, cost in [*path, (" ", 0.0)]:
            total -= cost
            for s in toxicity.codes(piece).tolist():
                total += float(table[x, y, s])
                x, y = y, s
        return total

    for _ in range(60):
        token = "".join(rng.choice("1d0t@3rrm ") for _ in range(rng.randrange(2, 8))).strip() or "1"
        steps = toxicity.lattice(token)
        found = toxicity.viterbi(steps, model)
        best = max(map(value, product(*steps)))
        assert any(abs(value(p) - best) < 1e-4 and "".join(c for c, _ in p).strip() == found for p in product(*steps))


def test_trigrams_cover_all_texts(spark, nasty):
    wanted = {}
    for r in nasty.collect():
        c = [0, 0, *toxicity.codes(r.text or "").tolist(), 0]
        for g in zip(c, c[1:], c[2:]):
            wanted[g] = wanted.get(g, 0) + 1
    s = toxicity.SYMBOLS
    got = {(r.gram // s // s, r.gram // s % s, r.gram % s): r.n for r in toxicity.trigram_counts(nasty).collect()}
    assert got == wanted


def test_repeated_ids_bound_what_toxicity_learns(spark, monkeypatch):
    rows = [(i, f"a text of number {i} and more") for i in range(12)] + [(i % 4, f"another {i} text {i * 7} here {i * 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    learnt = []
    monkeypatch.setattr(toxicity, "fit_weights", lambda rows, ys, chosen: (learnt.append((rows, ys)), (0.0, {}))[1])
    for table in (docs, docs.repartition(7), docs.orderBy(F.desc("text"))):
        toxicity.train(table, labels, most=8)
    assert 1 < len(learnt[0][1]) <= 8 and learnt[0] == learnt[1] == learnt[2]


def test_one_row_of_a_repeated_id_is_learnt(spark, monkeypatch):
    rows = [(i, f"a text of number {i}") for i in range(12)] + [(i % 12, f"another text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    learnt = []
    monkeypatch.setattr(quality, "fit", lambda words, statistics, ys: learnt.append(ys))
    quality.train(docs, labels)
    quality.train(docs.dropDuplicates(["doc_id"]), labels)
    assert len(learnt[0]) == len(learnt[1]) > 1
