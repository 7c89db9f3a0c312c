"""Quality classifier: a factorisation machine over words, structure and size.

A text becomes a sparse row: its hashed words, statistics of its structure
(letter case, symbols, repetition, line shapes) and its size, each statistic
as a number and as one of eight bins. The machine adds a low-rank weight for
every pair of features; the sum of squares identity makes a score linear in
the number of features. Training reads at most ``most`` labelled rows, chosen
by hash; scoring is row by row over whole texts.

Defined results: a null or empty text is scored by its (zero) statistics; a
text scores the same wherever it stands; rows without a label, with a null
label or held out are never learned from; without two kinds of labels every
score is the share of ones, or 0.5; other columns are ignored by ``score``
and kept by ``keep_good``.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvitals.llm.frames import text_of

WORD_BUCKETS = 1 << 14
BINS = 8
FACTORS = 8
#: Labelled rows that training reads at most.
MOST = 8000
EPOCHS = 12
_CACHE = 200_000
_MARKS = frozenset("%$&#*|!~^=<>{}[]\\@_+")
STATISTICS = [
    "upper_share", "digit_share", "mark_share", "space_share", "mean_word", "longest_word", "distinct_words",
    "distinct_pairs", "same_as_before", "top_word", "marked_words", "shouted_words", "mean_line", "distinct_lines",
    "short_lines", "log_chars", "log_words", "log_lines",
]
_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) >= _CACHE:
            _buckets.clear()
        found = _buckets[word] = zlib.crc32(word.lower().strip(".,;:!?").encode()) % WORD_BUCKETS
    return found


def describe(text: str) -> tuple[list[int], list[float]]:
    """Hashed words of a text and its statistics."""
    words = text.split()
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lower = text.lower()
    small = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    upper = int(np.count_nonzero(codes != small)) if len(small) == chars else sum(map(str.isupper, text))
    digits = int(np.count_nonzero((codes >= 48) & (codes <= 57)))
    marks = sum(text.count(m) for m in _MARKS)
    marked = sum(c for w, c in counts.items() if w[-1] in _MARKS or w[0] in _MARKS)
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    per_word, per_char, n_lines = 1 / max(n, 1), 1 / max(chars, 1), len(lines)
    statistics = [
        upper * per_char,
        digits * per_char,
        marks * per_char,
        1 - sum(map(len, words)) * per_char if chars else 0.0,
        sum(map(len, words)) * per_word,
        float(np.log1p(max(map(len, counts), default=0))),
        len(counts) * per_word,
        len(set(zip(words, words[1:]))) * per_word,
        sum(map(eq, words, words[1:])) * per_word,
        max(counts.values(), default=0) * per_word,
        marked * per_word,
        shouted * per_word,
        float(np.log1p(chars / max(n_lines, 1))),
        len(set(lines)) / max(n_lines, 1),
        sum(len(line) < 30 for line in lines) / max(n_lines, 1),
        float(np.log1p(chars)),
        float(np.log1p(n)),
        float(np.log1p(n_lines)),
    ]
    return sorted(set(map(_bucket, counts))), statistics


@dataclass
class Machine:
    """Bias, linear weights and factors; features are words, then numbers, then bins of the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    edges: np.ndarray

    def row(self, words: list[int], statistics: list[float]) -> tuple[np.ndarray, np.ndarray]:
        values = np.asarray(statistics)
        k = len(values)
        bins = (values[:, None] > self.edges).sum(axis=1)
        index = np.concatenate(
            [np.asarray(words, np.int64), WORD_BUCKETS + np.arange(k), WORD_BUCKETS + k + np.arange(k) * BINS + bins]
        )
        x = np.concatenate(
            [
                np.full(len(words), 1 / np.sqrt(max(len(words), 1))),
                np.clip((values - self.centre) / self.spread, -3, 3) / np.sqrt(k),
                np.full(k, 1 / np.sqrt(k)),
            ]
        )
        return index, x

    def margin(self, index: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """w0 + sum of w x + half of (square of sums - sum of squares) of the factors: linear in the features."""
        weighted = self.factors[index] * x[:, None]
        total = weighted.sum(axis=0)
        pairs = 0.5 * float((total * total).sum() - (weighted * weighted).sum())
        return self.bias + float(self.linear[index] @ x) + pairs, weighted, total

    def score(self, text: str) -> float:
        margin, _, _ = self.margin(*self.row(*describe(text)))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(words: list[list[int]], statistics: list[list[float]], labels: list[int], epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, row by row in a seeded order."""
    rng = np.random.default_rng(seed)
    k = len(STATISTICS)
    size = WORD_BUCKETS + k + k * BINS
    table = np.asarray(statistics, float).reshape(-1, k)
    y = np.asarray(labels, float)
    centre = table.mean(axis=0) if len(table) else np.zeros(k)
    spread = np.maximum(table.std(axis=0), 1e-6) if len(table) else np.ones(k)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(table, quantiles, axis=0).T if len(table) else np.zeros((k, BINS - 1))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)), centre, spread, edges)
    if len(set(labels)) < 2:
        return machine
    machine.factors = rng.normal(0, 0.05, (size, FACTORS))
    rows = [machine.row(w, s) for w, s in zip(words, statistics)]
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, x = rows[i]
            margin, weighted, total = machine.margin(index, x)
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[i]
            linear = slope * x + ridge * machine.linear[index]
            factors = slope * x[:, None] * (total - weighted) + ridge * machine.factors[index]
            seen_linear[index] += linear * linear
            seen_factors[index] += factors * factors
            seen_bias += slope * slope
            machine.linear[index] -= rate * linear / np.sqrt(seen_linear[index])
            machine.factors[index] -= rate * factors / np.sqrt(seen_factors[index])
            machine.bias -= rate * slope / np.sqrt(seen_bias)
    return machine


def remainder(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text) of the rows of at most ``most`` labelled ids, chosen by the hash of the id."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("id").isNotNull() & learn)
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text")  # ``most`` ids


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learn ``labels.quality`` from the rows that are not held out."""
    schema = "y int, words array<int>, statistics array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [describe(text) for text in frame["text"]]
            yield pd.DataFrame({"y": frame["y"], "words": [w for w, _ in found], "statistics": [s for _, s in found]})

    learn = remainder(F.col("id"), 3) != 1
    rows = labelled(docs, labels, "quality", learn, most, id_col, text_col)
    # of the rows of one id, the text of smallest hash; each task keeps one, so a repeated id gathers nowhere
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    rows = rows.select("y", "least.text").mapInPandas(run, schema).collect()
    # the same rows in any order give the same machine
    rows = sorted((list(r.words), list(r.statistics), r.y) for r in rows)
    return fit([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def scorer(machine: Machine):
    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(machine.score).astype("float64")

    return scored


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (higher: likelier good), predicted of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), scorer(machine)(text_of(text_col)).alias("score"))
    return rows.select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns."""
    return docs.filter(scorer(machine)(text_of(text_col)) >= 0.5)
