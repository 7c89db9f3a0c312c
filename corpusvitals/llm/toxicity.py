"""Toxicity over deobfuscated text.

A character language model (trigrams of all documents) is the source of a
noisy channel whose noise is look-alike symbols, repeated letters and letters
set apart. A token that may be disguised becomes a lattice: each observed
piece may stand for one of several hidden ones, at a cost. Viterbi finds the
likeliest hidden text. Other tokens have one path and stay as they are.

The restored words are scored by a logistic model over words and word
beginnings, chosen by a likelihood-ratio test on labelled rows.

Defined results: null texts are empty; a text without a known feature scores
the model's bias; rows without a label, with a null label or held out are
never learned from; without two kinds of labels every score is the share of
ones, or 0; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvitals.llm.frames import slices, text_of
from corpusvitals.llm.quality import labelled, remainder
from corpusvitals.session import stage

#: Labelled ids that training reads at most, one row of each.
MOST = 20_000
#: Chosen features at most, those of largest test value; a bound on what comes to the driver.
MOST_FEATURES = 20_000
EVIDENCE = 20.0
POSITIVE_WEIGHT = 3.0
SURE = 0.9
BEGINNINGS = (4, 5, 6)
_CACHE = 150_000

# hidden letters that a symbol may stand for
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c",
}
LOOKALIKE_COST, REPEAT_COST, SPLIT_COST = 0.5, 0.5, 3.0
#: Signs that may set letters apart.
SEPARATORS = ".-_*·/,~:;\\"

# the alphabet: boundary, a-z, the letters of Latin-1, other letters, signs that may stand for letters
BOUNDARY, OTHER, SIGN = 0, 60, 61
SYMBOLS = 62


def _table() -> np.ndarray:
    table = np.full(0x180, OTHER, np.uint8)
    table[:0xDF] = BOUNDARY
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 60)
    table[[*range(ord("0"), ord("9") + 1), *(ord(c) for c in LOOKALIKES if ord(c) < 0x80)]] = SIGN
    return table


_TABLE = _table()


def codes(text: str) -> np.ndarray:
    """Symbols of the lower-case text; space and punctuation bound words."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return _TABLE[np.minimum(points, 0x17F)]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts; a gram is a number below SYMBOLS ** 3."""
    source = docs.select(text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                row = np.concatenate(([BOUNDARY, BOUNDARY], codes(text), [BOUNDARY])).astype(np.int64)
                grams = (row[:-2] * SYMBOLS + row[1:-1]) * SYMBOLS + row[2:]
                if len(grams) * 4 > len(total):
                    total += np.bincount(grams, minlength=len(total))
                else:
                    np.add.at(total, grams, 1)
        found = np.flatnonzero(total)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    return source.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Log-probabilities of a symbol after two others, smoothed by the shorter contexts."""

    table: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> "LanguageModel":
        n3 = np.zeros(SYMBOLS**3)
        n3[grams] = counts
        n3 = n3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        n2 = n3.sum(axis=0)
        n1 = n2.sum(axis=0)
        p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
        p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2) / (n3.sum(axis=2, keepdims=True) + 5)
        return cls(np.log(p3).astype(np.float32))

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text") -> "LanguageModel":
        rows = trigram_counts(docs, text_col).toPandas()  # SYMBOLS ** 3 rows at most
        return cls.of(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(float))


def viterbi(lattice: list[list[tuple[str, float]]], model: LanguageModel) -> str:
    """The likeliest hidden text. Each step offers (hidden piece, cost); the state is the last two symbols."""
    table = model.table
    best: dict[tuple[int, int], tuple[float, str]] = {(BOUNDARY, BOUNDARY): (0.0, "")}
    for options in [*lattice, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for piece, cost in options:
                x, y, total = a, b, score - cost
                for symbol in codes(piece).tolist():
                    total += float(table[x, y, symbol])
                    x, y = y, symbol
                held = after.get((x, y))
                if held is None or total > held[0]:
                    after[x, y] = (total, text + piece)
        best = after
    return max(best.values())[1].strip()


_RUN = re.compile(r"(.)\1*", re.S)
_EDGE = ".,;:?\"'()[]{}…«»“”"
_LETTER = re.compile(r"[^\W\d_]")
_TWICE = re.compile(r"(.)\1+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SYMBOL = re.compile(f"[{re.escape(''.join(LOOKALIKES))}]")
_PIECE = rf"[^\s{re.escape(SEPARATORS)}]"
#: Single characters set apart by a sign, or three pieces and more of up to three.
_APART = re.compile(rf"^(?:(?:{_PIECE}[{re.escape(SEPARATORS)}]+)+{_PIECE}|(?:{_PIECE}{{1,3}}[{re.escape(SEPARATORS)}]+){{2,}}{_PIECE}{{1,3}})$")
#: Three or more single characters set apart by white space.
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
#: Look-alikes that are no digits: with one of them a token without letters may be a word.
_SIGN = re.compile(f"[{re.escape(''.join(c for c in LOOKALIKES if not c.isdigit()))}]")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Steps of a token: look-alikes by their letters, runs by one or two, separators by nothing or a gap."""
    apart = bool(_APART.match(token)) or any(map(str.isspace, token))
    steps = []
    for match in _RUN.finditer(token):
        char, n = match[1], len(match[0])
        if apart and (char in SEPARATORS or char.isspace()):
            steps.append([("", 0.0), (" ", SPLIT_COST)])
            continue
        hidden = [(c, LOOKALIKE_COST) for c in LOOKALIKES.get(char, "")] + [(char, 0.0)]
        options = []
        for c, cost in hidden:
            options.append((c, cost + (REPEAT_COST if n > 1 else 0.0)))
            if n > 1:
                options.append((c * 2, cost + (REPEAT_COST if n > 2 else 0.0)))
        steps.append(options)
    return steps


def disguised(token: str) -> bool:
    """Whether the lattice of a token has more than its own path."""
    if token.isalpha():
        return bool(_THRICE.search(token))
    if not _LETTER.search(token):
        return len(token) > 2 and bool(_SIGN.search(token))
    return bool(_SYMBOL.search(token) or _THRICE.search(token) or _APART.match(token))


def restore_token(token: str, model: LanguageModel) -> str:
    """The likeliest text of a token without the punctuation around it; a
    bracket that nothing closes, or an exclamation mark, may be a letter."""
    core = token.strip(_EDGE).rstrip("!")
    hidden = disguised(core)
    if core == token or len(core) < 3 or not ("!" in token or "(" in token):
        return viterbi(lattice(core), model) if hidden else core
    start = token.find(core)
    before, behind = token[:start], token[start + len(core) :]
    steps = lattice(core) if hidden else [[(core, 0.0)]]
    if before.endswith("(") and ")" not in behind:
        steps = [[("", 0.0), *((c, LOOKALIKE_COST) for c in LOOKALIKES["("])], *steps]
    if behind.startswith("!"):
        steps = [*steps, [("", 0.0), *((c, LOOKALIKE_COST) for c in LOOKALIKES["!"])]]
    return viterbi(steps, model) if hidden or len(steps) > 1 else core


def _joined(text: str, model: LanguageModel) -> str:
    """The lower-case text with letters that spaces set apart put together where that is likelier."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: viterbi(lattice(m[0]), model) if _LETTER.search(m[0]) else m[0], text)
    return text


def restore(text: str, model: LanguageModel) -> str:
    """The lower-case text with disguised tokens restored."""
    return " ".join(restore_token(token, model) for token in _joined(text, model).split())


def single(word: str) -> str:
    """A word with each run of a letter as one."""
    return _TWICE.sub(r"\1", word) if _TWICE.search(word) else word


def features(word: str) -> list[str]:
    """The word without repeated letters, and its beginnings."""
    return ["~" + single(word), *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str, model: LanguageModel, known: dict[str, tuple]) -> set[str]:
    """Distinct words of the restored text; ``known`` remembers tokens."""
    words: set[str] = set()
    for token in set(_joined(text, model).split()):
        found = known.get(token)
        if found is None:
            if len(known) >= _CACHE:
                known.clear()
            found = known[token] = tuple(restore_token(token, model).split())
        words.update(found)
    return words


@dataclass
class Detector:
    """Bias and weights of features; only words that begin like one of them are looked at closely."""

    model: LanguageModel
    bias: float
    weights: dict[str, float]
    _known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self._starts = {f.lstrip("~")[: BEGINNINGS[0]] for f in self.weights}

    def _features_of(self, token: str) -> tuple:
        words = restore_token(token, self.model).split()
        n, starts = BEGINNINGS[0], self._starts
        near = [w for w in words if w[:n] in starts or single(w)[:n] in starts]
        return tuple(f for w in near for f in features(w) if f in self.weights)

    def active(self, text: str) -> set[str]:
        """Chosen features of the restored text."""
        active: set[str] = set()
        known = self._known
        for token in set(_joined(text, self.model).split()):
            found = known.get(token)
            if found is None:
                if len(known) >= _CACHE:
                    known.clear()
                found = known[token] = self._features_of(token)
            if found:
                active.update(found)
        return active

    def score(self, text: str) -> float:
        margin = self.bias + sum(self.weights[f] for f in sorted(self.active(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def evidence(positives: int, negatives: int) -> Column:
    """Twice the log-likelihood ratio of a feature's share among both kinds; null where it speaks for the other kind."""
    share = positives / (positives + negatives)
    n = F.col("positive") + F.col("negative")

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / expected)).otherwise(0.0)

    value = 2 * (part(F.col("positive"), n * share) + part(F.col("negative"), n * (1 - share)))
    return F.when(F.col("positive") > n * share, value)


def fit_weights(rows: list[list[str]], labels: list[int], chosen: list[str], steps: int = 600) -> tuple[float, dict[str, float]]:
    """Logistic regression with a ridge and no negative weights, by scaled gradient steps over sparse 0/1 rows."""
    place = {f: i for i, f in enumerate(chosen)}
    row_of = np.array([r for r, fs in enumerate(rows) for _ in fs], np.int64)
    column = np.array([place[f] for fs in rows for f in fs], np.int64)
    y = np.asarray(labels, float)
    w = np.zeros(len(chosen))
    bias = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    weight = np.where(y > 0, POSITIVE_WEIGHT, 1.0)  # a miss is worse than a false alarm
    seen_w, seen_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):
        margin = bias + np.bincount(row_of, w[column], minlength=len(y))
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        gradient = np.bincount(column, slope[row_of], minlength=len(chosen)) + 0.02 * w
        level = slope.sum()
        seen_w = 0.95 * seen_w + 0.05 * gradient**2
        seen_b = 0.95 * seen_b + 0.05 * level**2
        w = np.maximum(w - 0.05 * gradient / np.sqrt(seen_w), 0.0)  # the test chose signs of one kind
        bias -= 0.05 * level / math.sqrt(seen_b)
    return float(bias), {f: float(w[i]) for f, i in place.items()}


@F.pandas_udf(T.LongType())
def likeness(texts: pd.Series) -> pd.Series:
    """Smallest hash of three words in a row: most changed copies of a text share it."""

    def smallest(text: str) -> int:
        words = text.lower().split()
        return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)

    return texts.map(smallest).astype("int64")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Learn ``labels.toxic`` from the rows that are not held out; the language model reads all texts."""
    model = LanguageModel.fit(docs, text_col)
    learn = remainder(F.col("id"), 5) != 0
    # copies of a text, changed or not, are one observation
    rows = labelled(docs, labels, "toxic", learn, most, id_col, text_col)
    least = lambda: F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    # of the rows of one id, and of those alike, the text of smallest hash; each task keeps one, so no id gathers anywhere
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), least()).select("y", "least.text")
    rows = rows.withColumn("likeness", likeness("text")).groupBy("y", "likeness").agg(least()).select("y", "least.text")
    rows = stage(rows, "labelled")
    kinds = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = kinds.get(1, 0), sum(n for y, n in kinds.items() if y != 1)
    if not positives or not negatives:
        share = positives / (positives + negatives) if positives + negatives else 0.0
        return Detector(model, math.log((share + 1e-6) / (1 - share + 1e-6)), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in slices(batches):
            seen: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for word in words_of(text, model, known) for f in features(word)}:
                    seen.setdefault(f, [0, 0])[y != 1] += 1
            columns = [list(seen), [n[0] for n in seen.values()], [n[1] for n in seen.values()]]
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["f", "positive", "negative"])

    ranked = (
        rows.mapInArrow(count, "f string, positive long, negative long")
        .groupBy("f")
        .agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
        .withColumn("value", evidence(positives, negatives))
        .filter(F.col("value") > EVIDENCE)
        .orderBy(F.desc("value"), "f")
        .limit(MOST_FEATURES)
        .collect()
    )
    chosen = [r.f for r in ranked]
    probe = Detector(model, 0.0, dict.fromkeys(chosen, 0.0))

    def active(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"y": frame["y"], "fs": [sorted(probe.active(t)) for t in frame["text"]]})

    found = sorted((list(r.fs), r.y) for r in rows.mapInPandas(active, "y int, fs array<string>").collect())
    bias, weights = fit_weights([r[0] for r in found], [r[1] for r in found], chosen)
    # words of toxic texts come together, so each learns a share only: one that is sure must do alone
    for r in ranked:
        precision = r.positive / (r.positive + r.negative + 1)
        if precision >= SURE:
            weights[r.f] = max(weights[r.f], math.log(precision / (1 - precision)) - bias)
    return Detector(model, bias, weights)


def score(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (higher: likelier toxic), predicted of each row."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(detector.score).astype("float64")

    rows = docs.select(F.col(id_col).alias("doc_id"), scored(text_of(text_col)).alias("score"))
    return rows.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
