"""Quality rules with repetition found by a suffix array.

The suffixes of a text, code point by code point, are sorted by prefix
doubling: the first round compares as many symbols as a 64-bit key holds,
later rounds touch only suffixes that are still tied. Neighbours in the order
have longest common prefixes; those that no symbol before them prolongs are
computed directly, all others are one shorter than that of the suffix before.
An interval of the order whose common prefix is at least ``min_chars`` and
whose members follow different symbols is a maximal repeat. The spans of all
occurrences are united; a text is dropped when they cover too much of it or
when one repeat is too long.

All work is row by row, without a shuffle, a few texts at a time; a text of n
characters takes about 60 bytes of memory for each.

Defined results: a null text has no words and fails the base rules, as does
an empty one; repeated rows give repeated results; occurrences may overlap;
the thresholds are reached by a share above ``max_covered`` or a repeat above
``max_longest``; other columns of the input are ignored, whatever their names
(``keep_passing`` keeps them); an empty table gives an empty one.
"""

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvitals.llm.frames import slices, text_of

MIN_WORDS = 50
MAX_REPEAT_WORDS = 0.5
#: Shortest repeat that counts, in code points.
MIN_CHARS = 50
#: Largest share of a text's code points within such repeats.
MAX_COVERED = 0.3
#: Longest repeat, as a share of the text's code points.
MAX_LONGEST = 0.2

_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_KEY_BITS = 62
#: Rounds in which all pairs are compared side by side, before long ones go on alone.
_ROUNDS = 32


@dataclass
class Order:
    """Sorted suffixes; ``tied`` are the slots whose suffix shares ``known`` symbols with the one before."""

    suffixes: np.ndarray
    tied: np.ndarray
    known: int
    #: The next ``width`` symbols from each place on, packed.
    keys: np.ndarray
    width: int
    symbols: np.ndarray


def dense(codes: np.ndarray) -> np.ndarray:
    """Codes as numbers from 1 on, in the same order."""
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    return np.cumsum(present)[codes]


def sort_suffixes(symbols: np.ndarray, least: int) -> Order:
    """Suffix array of ``symbols`` (1 and above) by prefix doubling; ties of at least ``least`` symbols are named."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length()
    width = max(1, min(_KEY_BITS // bits, least))
    padded = np.zeros(n + width, np.int64)
    padded[:n] = symbols
    keys = np.zeros(n + 1, np.int64)
    for j in range(width):
        keys[:n] <<= bits
        keys[:n] |= padded[j : j + n]
    order = np.argsort(keys[:n])
    rank = np.zeros(n + 1, np.int64)  # the end of the text comes first
    slots, at, key, h = np.arange(n), order, keys[order], width
    tied, known = None, 0
    while True:
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
        last = np.ones(len(slots), bool)
        last[:-1] = fresh[1:]
        open_ = ~(fresh & last)
        if tied is None and 2 * h > least:
            tied, known = slots[~fresh], h
        slots = slots[open_]
        if not len(slots):
            break
        at = order[slots]
        key = rank[at] * (n + 1) + rank[at + h]
        inner = np.argsort(key)
        at, key = at[inner], key[inner]
        order[slots] = at
        h *= 2
    return Order(order, slots if tied is None else tied, known or h, keys, width, padded)


def _extend(order: Order, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common symbols of the suffixes at a and b, which share ``known``."""
    length = np.full(len(a), order.known, np.int64)
    todo = np.arange(len(a))
    n = len(order.keys) - 1
    for _ in range(_ROUNDS):
        same = order.keys[a[todo] + length[todo]] == order.keys[b[todo] + length[todo]]
        done = todo[~same]
        equal = np.ones(len(done), bool)
        for _ in range(order.width):
            equal &= order.symbols[a[done] + length[done]] == order.symbols[b[done] + length[done]]
            length[done] += equal
        todo = todo[same]
        if not len(todo):
            return length
        length[todo] += order.width
    for i in todo.tolist():
        x, y, step = int(a[i] + length[i]), int(b[i] + length[i]), 256
        while True:
            size = min(step, n + 1 - max(x, y))  # the end differs from every symbol
            differ = order.symbols[x : x + size] != order.symbols[y : y + size]
            first = int(differ.argmax())
            if differ[first]:
                length[i] = x + first - a[i]
                break
            x, y, step = x + size, y + size, step * 2
    return length


def common_prefixes(order: Order) -> np.ndarray:
    """Longest common prefix of the suffix in each tied slot and the one before."""
    i, p = order.suffixes[order.tied], order.suffixes[order.tied - 1]
    head = (i == 0) | (p == 0) | (order.symbols[i - 1] != order.symbols[p - 1])
    n = len(order.keys) - 1
    length, heads = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    length[i[head]] = _extend(order, i[head], p[head])
    heads[i[head]] = i[head]
    heads = np.maximum.accumulate(heads)[i]
    return length[heads] - (i - heads)


@dataclass
class Repeats:
    """Spans of the repeats of one text, united, and the longest of them."""

    spans: list[tuple[int, int]]
    covered: int
    longest: int
    n_maximal: int


NONE = Repeats([], 0, 0, 0)


def intervals(order: Order, slots: np.ndarray, prefixes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first slot, last slot) of each maximal repeat: intervals whose members follow different symbols."""
    before = order.symbols[order.suffixes - 1]
    before[order.suffixes == 0] = -1
    # the last slot so far whose symbol before differs from that of the slot before it
    differs = np.zeros(len(before), bool)
    differs[1:] = before[1:] != before[:-1]
    changed = np.maximum.accumulate(np.where(differs, np.arange(len(before)), 0)).tolist()

    def close(length: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        if changed[last] > first:
            yield length, first, last

    stack: list[tuple[int, int]] = []
    previous = -1
    for slot, length in zip(slots.tolist(), prefixes.tolist()):
        if slot != previous + 1:
            while stack:
                yield from close(*stack.pop(), previous)
        first = slot - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield from close(top, first, previous)
        if not stack or stack[-1][0] < length:
            stack.append((length, first))
        previous = slot
    while stack:
        yield from close(*stack.pop(), previous)


def repeats(symbols: np.ndarray, least: int) -> Repeats:
    """What occurs twice or more in ``symbols`` (1 and above) with at least ``least`` of them."""
    if len(symbols) <= least:
        return NONE
    order = sort_suffixes(symbols, least)
    if not len(order.tied):
        return NONE
    prefixes = common_prefixes(order)
    long = prefixes >= least
    slots, prefixes = order.tied[long], prefixes[long]
    if not len(slots):
        return NONE
    # the deepest interval around a suffix has the larger of its two common prefixes
    reach = np.zeros(len(symbols), np.int64)
    reach[order.suffixes[slots]] = prefixes
    other = order.suffixes[slots - 1]
    reach[other] = np.maximum(reach[other], prefixes)
    starts = np.flatnonzero(reach)
    ends = np.maximum.accumulate(starts + reach[starts])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    last = np.append(first[1:], True)
    starts, ends = starts[first], ends[last]
    return Repeats(
        list(zip(starts.tolist(), ends.tolist())),
        int((ends - starts).sum()),
        int(prefixes.max()),
        sum(1 for _ in intervals(order, slots, prefixes)),
    )


def repeated_windows(words: np.ndarray, size: int) -> int:
    """How many of the words stand in a window of ``size`` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    key = words[:n].astype(np.int64)
    for j in range(1, size):
        top = int(words.max()) + 1
        if (int(key.max()) + 1) * top >> _KEY_BITS:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + words[j : j + n]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    edge = np.zeros(n + size, np.int64)
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    at = np.flatnonzero(found)
    edge[at] += 1
    edge[at + size] -= 1
    return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Rules:
    """Limits of the rules."""

    min_words: int = MIN_WORDS
    max_repeat_words: float = MAX_REPEAT_WORDS
    window: int = 3
    min_chars: int = MIN_CHARS
    max_covered: float = MAX_COVERED
    max_longest: float = MAX_LONGEST


@dataclass
class Verdict:
    """What the rules find in one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_chars: int
    covered_chars: int
    longest_repeat: int
    n_maximal_repeats: int
    spans: list[dict[str, int]]


def judge(text: str, rules: Rules) -> Verdict:
    raw = text.encode()
    words = raw.split()
    solid = raw.translate(None, _SPACES)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words))
    n_repeat = repeated_windows(ids, rules.window)
    failed = len(words) < rules.min_words or n_repeat > rules.max_repeat_words * len(words)
    codes = np.frombuffer(raw, np.uint8) if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = repeats(dense(codes), rules.min_chars) if len(codes) else NONE
    good = found.covered <= rules.max_covered * len(text) and found.longest <= rules.max_longest * len(text)
    return Verdict(
        len(words),
        len(text) - (len(raw) - len(solid)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        n_repeat,
        failed,
        not failed and good,
        len(text),
        found.covered,
        found.longest,
        found.n_maximal,
        [{"start": start, "end": end} for start, end in found.spans],
    )


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_TYPES: dict[str, tuple[T.DataType, pa.DataType]] = {
    "n_words": (T.LongType(), pa.int64()),
    "word_chars": (T.LongType(), pa.int64()),
    "n_symbols": (T.LongType(), pa.int64()),
    "n_dup_lines": (T.LongType(), pa.int64()),
    "n_repeat_words": (T.LongType(), pa.int64()),
    "base_failed": (T.BooleanType(), pa.bool_()),
    "kept": (T.BooleanType(), pa.bool_()),
    "n_chars": (T.LongType(), pa.int64()),
    "covered_chars": (T.LongType(), pa.int64()),
    "longest_repeat": (T.LongType(), pa.int64()),
    "n_maximal_repeats": (T.LongType(), pa.int64()),
    "spans": (T.ArrayType(_SPAN), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
}


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of ``Verdict`` for each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(k, t) for k, (t, _) in _TYPES.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [asdict(judge(text.as_py(), rules)) for text in batch.column(1)]
            columns = [pa.array([v[k] for v in found], kind) for k, (_, kind) in _TYPES.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_TYPES])

    return source.mapInArrow(run, schema)


def keep_passing(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    @F.pandas_udf(T.BooleanType())
    def passes(texts):
        return texts.map(lambda text: judge(text, rules).kept).astype(bool)

    return docs.filter(passes(text_of(text_col)))
