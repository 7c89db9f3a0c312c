"""Spelling variant grouping by search schemes on a bidirectional FM-index.

Words within one inserted, deleted or replaced code point of each other share
one of their halves: the first half of the shorter or longer one as it stands,
or the second. So a word is searched twice. One half is matched exactly from
its delimiter inwards, then the other half is extended letter by letter with
one error allowed, up to its delimiter. Each step narrows a pair of
suffix-rank intervals, one over the delimited vocabulary and one over its
reverse, that are kept in step. Words are sorted, so the rank of a suffix
that begins with a delimiter is the number of its word.

The vocabulary is counted in Spark and dealt into blocks by hashed halves, so
that words which share one meet, and each block has an index of its own,
searched for all its words side by side. A half with more than ``BLOCK``
words is dealt over a square of blocks: any share of the words to search in
meets any share of the words searched for. No list of pairs leaves a block:
a word's near words are counted there and the best is named.

Defined results: null texts have no words, null ids are empty in the noise
key; a word without near words is its own root; ties go to the smallest word
in code-point order; repeated rows count as often as they stand there; other
columns are ignored, whatever their names; an empty table gives an empty one.
A word of any length is searched whole.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvitals.llm.frames import text_of
from corpusvitals.llm.repetition import dense, sort_suffixes
from corpusvitals.session import stage

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
#: A form is so many times as frequent as its variant, at least.
RATIO = 5
#: Words that a block's index holds, as a goal, and words of one half that are not dealt over several blocks.
BLOCK = 1 << 14

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DELIMITER = "$"
_SPACE, _FIRST_LETTER = 1, 2  # symbols: 0 the end of the text, 1 the delimiter


@dataclass
class FmIndex:
    """Rank table of one direction: ``below[i, c]`` symbols under c among the first i of the transform."""

    below: np.ndarray
    #: Rows of the order whose suffix begins with a smaller symbol.
    first: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, size: int) -> "FmIndex":
        n = len(symbols)
        order = sort_suffixes(symbols, n + 1).suffixes
        transform = np.zeros(n + 1, np.int64)
        transform[0] = symbols[-1]
        transform[1:] = np.where(order > 0, symbols[order - 1], 0)
        table = np.zeros((n + 2, size + 1), np.int32)
        table[np.arange(1, n + 2), transform + 1] = 1
        np.cumsum(table, axis=0, out=table)
        np.cumsum(table, axis=1, out=table)
        return cls(table, table[n + 1].astype(np.int64))


@dataclass
class States:
    """Searches side by side: word searched for, its letters consumed, and the two intervals of what was matched."""

    word: np.ndarray
    at: np.ndarray
    here: np.ndarray
    there: np.ndarray
    size: np.ndarray

    def __len__(self) -> int:
        return len(self.word)

    def take(self, which: np.ndarray) -> "States":
        return States(self.word[which], self.at[which], self.here[which], self.there[which], self.size[which])

    def extended(self, index: FmIndex, symbol: np.ndarray, by: int = 1) -> "States":
        """Narrowed by ``symbol`` in the direction of ``index``; the other interval moves with it."""
        low, high = self.here, self.here + self.size
        less_low, less_high = index.below[low, symbol], index.below[high, symbol]
        same_low, same_high = index.below[low, symbol + 1] - less_low, index.below[high, symbol + 1] - less_high
        return States(
            self.word, self.at + by, index.first[symbol] + same_low, self.there + (less_high - less_low), (same_high - same_low).astype(np.int64)
        )

    @staticmethod
    def union(parts: list["States"]) -> "States":
        return States(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("word", "at", "here", "there", "size")))


def _delimited(words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    return _DELIMITER + "".join(word + _DELIMITER for word in words), starts, lengths


class Searcher:
    """The near words, among the sorted ``words``, of each of ``asked``."""

    def __init__(self, words: list[str], asked: list[str]):
        self.words, self.asked = words, asked
        text, _, _ = _delimited(words)
        queries, self._starts, self._lengths = _delimited(asked)
        codes = dense(np.frombuffer((text + queries).encode("utf-32-le"), np.uint32))
        symbols, self._queries = codes[: len(text)], codes[len(text) :]
        self._symbols, self._size = symbols, int(codes.max()) + 1

    @cached_property
    def left(self) -> FmIndex:
        """Extends to the left."""
        return FmIndex.of(self._symbols, self._size)

    @cached_property
    def right(self) -> FmIndex:
        """Extends to the right."""
        return FmIndex.of(self._symbols[::-1], self._size)

    def _search(self, halves: np.ndarray, symbol_at: Callable[[np.ndarray, np.ndarray], np.ndarray], index: FmIndex) -> States:
        """States of whole words, delimiter to delimiter, with one error behind the first ``halves`` letters."""
        n, rows = len(self.asked), index.below.shape[0] - 1
        zero = np.zeros(n, np.int64)
        exact = States(np.arange(n), zero - 1, zero, zero, np.full(n, rows))
        exact = exact.extended(index, np.full(n, _SPACE))
        waiting, ready = exact, []
        while len(waiting):
            done = (waiting.at == halves[waiting.word]) & (waiting.size > 0)
            ready.append(waiting.take(done))
            waiting = waiting.take(~done & (waiting.size > 0))
            waiting = waiting.extended(index, symbol_at(waiting.word, waiting.at))
        exact = States.union(ready) if ready else exact
        erred, found = exact.take(np.zeros(len(exact), bool)), []
        found.append(erred)
        while len(exact) or len(erred):
            if len(exact):
                wanted = symbol_at(exact.word, exact.at)
                inside = exact.at < self._lengths[exact.word]
                counts = np.diff(index.below[exact.here + exact.size] - index.below[exact.here], axis=1)
                counts[:, :_FIRST_LETTER] = 0
                counts[np.arange(len(exact)), wanted] = 0  # a letter like the wanted one is added behind its run
                state, letter = np.nonzero(counts)
                added = exact.take(state).extended(index, letter, by=0)
                replaced = added.take(inside[state])
                replaced.at += 1
                after = symbol_at(exact.word[inside], exact.at[inside] + 1)
                left_out = exact.take(inside).take(after != wanted[inside])  # the last letter of a run goes
                left_out.at += 1
                erred = States.union([erred, added, replaced, left_out])
                exact = exact.take(inside).extended(index, wanted[inside])
                exact = exact.take(exact.size > 0)
            last = erred.at == self._lengths[erred.word]
            erred = erred.extended(index, symbol_at(erred.word, erred.at))
            alive = erred.size > 0
            found.append(erred.take(alive & last))
            erred = erred.take(alive & ~last)
        return States.union(found)

    def by_head(self) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``asked``, number in ``words``) of near words with the first half of the asked one."""
        starts, queries = self._starts, self._queries
        found = self._search(self._lengths // 2, lambda q, p: queries[starts[q] + p], self.right)
        # rows of the left index that begin with a delimiter: the last one of the text, then the words in order
        return found.word, found.there - 2

    def by_tail(self) -> tuple[np.ndarray, np.ndarray]:
        """Those that have its second half and not the first."""
        starts, lengths, queries = self._starts, self._lengths, self._queries
        half = lengths // 2
        found = self._search(lengths - half, lambda q, p: queries[starts[q] + lengths[q] - 1 - p], self.left)
        asked, near = found.word, found.here - 2
        new = [self.words[t][:h] != self.asked[q][:h] for q, t, h in zip(asked.tolist(), near.tolist(), half[asked].tolist())]
        new = np.array(new, bool)
        return asked[new], near[new]


def words_of(
    docs: DataFrame,
    noise: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of the lower-cased runs of letters; only A-Z are lowered.

    With ``noise``, a run loses a letter where it divides h, the CRC-32 of
    ``id:run``: the one at place h modulo the run's length.
    """
    runs = F.explode(F.regexp_extract_all(text_of(text_col), F.lit(RUN), F.lit(0))).alias("run")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs)
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).filter(F.length("run") >= min_chars)
    word = F.col("run")
    if noise:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
        place = (F.col("h") % F.length("run")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
        word = F.when(F.col("h") % noise == 0, short).otherwise(word)
    counted = rows.select(word.alias("word")).filter(F.length("word") >= min_chars)
    return counted.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _halves() -> Column:
    """The halves under which a word is found by words one letter shorter, as long, or one letter longer; and its own."""
    size = F.length("word")
    rows = []
    for side, shortest, own in (("head", (size - 1) / 2, size / 2), ("tail", size / 2, (size + 1) / 2)):
        for extra in (0, 1):
            length = shortest.cast("int") + extra
            start = F.lit(1) if side == "head" else size - length + 1
            key = F.xxhash64(F.substring("word", start, length))
            rows.append(F.struct(F.lit(side).alias("side"), key.alias("half"), (own.cast("int") == length).alias("asks")))
    return F.explode(F.array(*rows)).alias("x")


_BLOCK = ["side", "block", "held_by", "asked_by"]


def _blocks(words: DataFrame, block: int) -> DataFrame:
    """(*_BLOCK, word, n, held, asks): the words in each block's index and those searched for in it."""
    halves = words.select("word", "n", _halves()).select("word", "n", "x.*")
    hot = halves.groupBy("side", "half").agg(F.count("*").alias("members")).filter(F.col("members") > block)
    hot = stage(hot.select("side", "half", F.ceil(F.col("members") / block).alias("shares")), "hot")
    n_blocks = max(1, -(-2 * words.count() // block))  # of each side: a word stands under two of its halves
    rows = halves.join(hot, ["side", "half"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)).cast("long"))
    others = F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)
    cells = F.array_union(
        F.transform(others, lambda i: F.struct(F.col("own").alias("held_by"), i.alias("asked_by"))),
        F.transform(others, lambda i: F.struct(i.alias("held_by"), F.col("own").alias("asked_by"))),
    )
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("shares"))).withColumn("cell", F.explode(cells))
    # a hot half has blocks of its own, so a word that is asked for in several meets each other word once
    name = F.when(F.col("shares") == 1, F.pmod("half", F.lit(n_blocks))).otherwise(F.col("half"))
    is_hot = F.col("shares") > 1
    return rows.select(
        F.concat("side", F.when(is_hot, F.lit("+")).otherwise(F.lit(""))).alias("side"),
        name.alias("block"),
        "cell.held_by",
        "cell.asked_by",
        "word",
        "n",
        (F.col("cell.held_by") == F.col("own")).alias("held"),
        (F.col("asks") & (F.col("cell.asked_by") == F.col("own"))).alias("asks"),
    ).filter("held or asks")


_NEAR = "word string, n_near long, best struct<less:long,form:string>"


def search_block(table: pa.Table) -> pa.Table:
    """Near words of the words that a block asks for, counted, and the most frequent of them."""
    held, asked = {}, set()
    for word, n, is_held, asks in zip(*(table.column(c).to_pylist() for c in ("word", "n", "held", "asks"))):
        if is_held:
            held[word] = n
        if asks:
            asked.add(word)
    words, queries = sorted(held), sorted(asked)
    query = near = np.zeros(0, np.int64)
    if words and queries:
        searcher = Searcher(words, queries)
        query, near = searcher.by_head() if table.column("side")[0].as_py().startswith("head") else searcher.by_tail()
    less = -np.array([held[w] for w in words], np.int64)
    order = np.lexsort((near, less[near], query)) if len(near) else near
    query, near = query[order], near[order]
    number, first, count = np.unique(query, return_index=True, return_counts=True)
    best = [{"less": int(less[t]), "form": words[t]} for t in near[first].tolist()]
    kind = pa.struct([("less", pa.int64()), ("form", pa.string())])
    return pa.table(
        {"word": pa.array([queries[q] for q in number.tolist()], pa.string()), "n_near": pa.array(count, pa.int64()), "best": pa.array(best, kind)}
    )


def nearest(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, best): near words of each of ``words(word, n)`` and the most frequent one, with its n negated."""
    near = _blocks(words, block).groupBy(*_BLOCK).applyInArrow(search_block, _NEAR)
    none = F.lit(None).cast("struct<less:long,form:string>")
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")).unionByName(
        near.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")
    )
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms(word, form)``; the way covered doubles each round."""
    state = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while state.filter("moved").limit(1).count():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(ahead, "root", "left")
        state = stage(
            moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
    return state.select("word", "root")


def variants(docs: DataFrame, noise: int | None = None, ratio: int = RATIO, block: int = BLOCK, **words_options) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs``."""
    words = stage(words_of(docs, noise, **words_options), "words")
    is_variant = -F.col("best.less") >= ratio * F.col("n")
    rows = stage(
        nearest(words, block).select(
            "word",
            F.when(is_variant, F.col("best.form")).alias("form"),
            "n",
            "n_near",
            F.when(is_variant, -F.col("best.less")).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
