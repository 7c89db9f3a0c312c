"""Cross-tokenizer alignment by lockstep merging.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B).
Both give a partition of the same bytes; where tokens of both end together
the text is cut into groups, and the two last tokens of a group are linked.

The documents of a batch are merged side by side: one state vector holds a
pointer into A and one into B for each stretch of a document, every step
compares all ends at once, emits the links and cuts that are met, advances
the pointer that is behind (both at a link) and compacts finished stretches
away. Stretches are at most ``STRETCH`` bytes, so that one long document
does not hold up its batch: both pointers of a stretch are found by binary
search, and a token that reaches over its edge ends in the next one.

Words at single spaces are encoded once and kept: no piece of either
vocabulary goes on over a space. Texts with other white space beside a space
go to the libraries whole.

How often a pair of ids is linked in the whole corpus is counted in a table.
Pairs with at least one of ``HEAVY`` equal shares of all links, so at most
``HEAVY`` pairs, travel to the tasks; the others are met by a shuffled join,
in which none of them can be hot.

Defined results: texts that are null, empty, or whose tokens of A or B do not
spell a space and the text, have no tokens and an empty digest; strings of
special tokens are plain text; repeated rows count as often as they stand
there; other columns are ignored, whatever their names; an empty table gives
an empty one. A text of any length is one row's work, at some 100 bytes of
memory for a character.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvitals.llm.bpe import byte_characters
from corpusvitals.llm.frames import text_of
from corpusvitals.session import stage

STRETCH = 512
HEAVY = 1 << 20
#: Texts of a batch that are merged side by side.
BATCH_ROWS = 256
BATCH_BYTES = 1 << 21
#: Words that a task keeps the tokens of.
CACHE_WORDS = 800_000
CACHE_CHARS = 10_000_000
#: New words that are encoded in one text.
LEARNT_TOGETHER = 1000


class ByteVocabulary:
    """Encodes by a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.encode_special_tokens = True
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        entries = self._library.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.spelled[i] = b"".join(byte_of[c] if c in byte_of else c.encode() for c in entry)

        parts = json.loads(self._library.to_str())
        splits = parts["pre_tokenizer"] or {}
        #: Whether a word and the space before it are encoded alike wherever they stand.
        self.by_words = parts["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", False) and not splits["add_prefix_space"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        spaced = [" " + text for text in texts]
        return [e.ids for e in self._library.encode_batch_fast(spaced, add_special_tokens=False)]


class PieceVocabulary:
    """Encodes by a model file of the sentencepiece library, which puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._library = SentencePieceProcessor(model_file=path)
        self.spelled = [self._bytes(i) for i in range(self._library.get_piece_size())]
        self.by_words = not any("▁" in self._library.id_to_piece(i).lstrip("▁") for i in range(len(self.spelled)))

    def _bytes(self, i: int) -> bytes:
        piece = self._library.id_to_piece(i)
        if self._library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._library.encode(texts, out_type=int, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=starts[1:])
    return np.fromiter(chain.from_iterable(lists), np.int64, starts[-1]), starts


def _gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which``, one after the other, and where each starts."""
    sizes = starts[which + 1] - starts[which]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], sizes)].astype(np.int64), ends


class _Words:
    """Ids of words met before, numbered in the order they came."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.odd: set[str] = set()
        self.chars = 0
        self._ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self._starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self._new: tuple[list, list] = ([], [])
        self._sizes = [0, 0]

    def add(self, words: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for word in words:
            self.number[word] = len(self.number)
        self.chars += sum(map(len, words))
        for k, (ids, starts) in enumerate(sides):
            self._new[k].append((ids.astype(np.int32), starts[1:] + self._sizes[k]))
            self._sizes[k] += len(ids)

    def ids(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if new := self._new[side]:
            self._ids[side] = np.concatenate([self._ids[side], *(ids for ids, _ in new)])
            self._starts[side] = np.concatenate([self._starts[side], *(starts for _, starts in new)])
            new.clear()
        return _gather(self._ids[side], self._starts[side], numbers)


class Encoder:
    """Both vocabularies; ids of texts, by the words met before."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteVocabulary(byte_path), PieceVocabulary(piece_path)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in v.spelled], np.int64) for v in (self.a, self.b))
        self._sizes = self.lengths_a.tolist(), self.lengths_b.tolist()
        self._by_words = self.a.by_words and self.b.by_words
        self._words = _Words()

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """By the libraries; nothing where the tokens do not spell the text."""
        lists = self.a.encode(texts), self.b.encode(texts)
        raw = [b" " + text.encode() for text in texts]
        vocabularies = (self.a, self.b)
        spelled = [b"".join(map(v.spelled.__getitem__, chain.from_iterable(x))) for v, x in zip(vocabularies, lists)]
        lengths = [len(x) for x in raw]
        if all(texts) and all(
            s == b"".join(raw) and [sum(map(n.__getitem__, ids)) for ids in x] == lengths
            for s, x, n in zip(spelled, lists, self._sizes)
        ):
            return lists  # every text is spelled by its own tokens
        for k, text in enumerate(texts):
            if not text or any(b"".join(map(v.spelled.__getitem__, x[k])) != raw[k] for v, x in zip(vocabularies, lists)):
                lists[0][k] = lists[1][k] = []
        return lists

    def _learn(self, words: list[str]) -> None:
        # white space may run on over the edges of these words
        edgy = [w for w in words if not w or w[0].isspace()]
        self._words.odd.update(edgy)
        self._words.add(edgy, [_flat([[]] * len(edgy))] * 2)
        inner = [w for w in words if w and not w[0].isspace()]
        for start in range(0, len(inner), LEARNT_TOGETHER):
            part = inner[start : start + LEARNT_TOGETHER]
            lists = self._whole([" ".join(part)])
            if not lists[0][0]:  # some word is not spelled by its tokens
                lists = self._whole(part)
                self._words.odd.update(w for w, a in zip(part, lists[0]) if not a)
                self._words.add(part, [_flat(x) for x in lists])
                continue
            edges = np.cumsum([1 + len(w.encode()) for w in part])
            sides = []
            for (found,), lengths in zip(lists, (self.lengths_a, self.lengths_b)):
                ids = np.array(found, np.int64)
                starts = np.concatenate(([0], 1 + np.searchsorted(np.cumsum(lengths[ids]), edges)))
                sides.append((ids, starts))
            self._words.add(part, sides)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each text starts) of A and of B."""
        if not self._by_words:
            return [_flat(x) for x in self._whole(texts)]
        if len(self._words.number) > CACHE_WORDS or self._words.chars > CACHE_CHARS:
            self._words = _Words()
        split = [text.split(" ") if text else [] for text in texts]
        number = self._words.number
        fresh = list({word for words in split for word in words if word not in number})
        if fresh:
            self._learn(fresh)
        odd = [k for k, words in enumerate(split) if not self._words.odd.isdisjoint(words)]
        whole = self._whole([texts[k] for k in odd])
        for k in odd:
            split[k] = []
        in_text = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))
        numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, in_text[-1])
        sides = []
        for side in (0, 1):
            ids, ends = self._words.ids(side, numbers)
            starts = ends[in_text]
            if odd:
                parts = [ids[x:y] for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())]
                for k, found in zip(odd, whole[side]):
                    parts[k] = np.array(found, np.int64)
                starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
                ids = np.concatenate(parts)
            sides.append((ids, starts))
        return sides


@cache
def encoder(byte_path: str, piece_path: str) -> Encoder:
    return Encoder(byte_path, piece_path)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, cut) wherever tokens of both end together, in order.

    ``ends_a`` and ``ends_b`` rise; ``edges`` are the places where stretches
    begin and end.
    """
    a, stop_a = (np.searchsorted(ends_a, x, "right") for x in (edges[:-1], edges[1:]))
    b, stop_b = (np.searchsorted(ends_b, x, "right") for x in (edges[:-1], edges[1:]))
    met_a, met_b, cuts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = (a < stop_a) & (b < stop_b)
    while True:
        if not live.all():
            a, stop_a, b, stop_b = a[live], stop_a[live], b[live], stop_b[live]
        if not len(a):
            break
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        met_a.append(a[both])
        met_b.append(b[both])
        cuts.append(end_a[both])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        live = (a < stop_a) & (b < stop_b)
    return tuple(np.sort(np.concatenate(x)) for x in (met_a, met_b, cuts))


@dataclass
class Aligned:
    """A batch of texts, their tokens one after the other; ``starts_*`` give the tokens of each text."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    #: The linked tokens, which are the last ones of each group, and the byte where they end.
    links_a: np.ndarray
    links_b: np.ndarray
    cuts: np.ndarray
    #: Links before each text.
    starts: np.ndarray


def align_batch(texts: list[str], encoder: Encoder, stretch: int = STRETCH) -> Aligned:
    (ids_a, starts_a), (ids_b, starts_b) = encoder.encode(texts)
    ends_a, ends_b = np.cumsum(encoder.lengths_a[ids_a]), np.cumsum(encoder.lengths_b[ids_b])
    ends = np.concatenate(([0], ends_a))[starts_a]
    edges = np.unique(np.concatenate([np.arange(0, ends[-1], stretch), ends]))
    links_a, links_b, cuts = lockstep(ends_a, ends_b, edges)
    return Aligned(ids_a, ids_b, starts_a, starts_b, links_a, links_b, cuts, np.searchsorted(links_a, starts_a))


@cache
def _printed(size_a: int, size_b: int) -> np.ndarray:
    """Text of each id and the sign behind it: A inside a group and at its end, then B."""
    texts = [f"{i}{sign}".encode() for i in range(size_a) for sign in ",|"]
    texts += [f"{i}{sign}".encode() for i in range(size_b) for sign in ",;"]
    return np.array(texts, object)


def digests(found: Aligned, size_a: int, size_b: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; empty without tokens."""
    printed = _printed(size_a, size_b)
    # a group's A tokens come behind all B tokens of earlier groups, its B tokens behind all A tokens so far
    in_a = np.diff(found.links_a, prepend=-1)
    in_b = np.diff(found.links_b, prepend=-1)
    place_a = np.arange(len(found.ids_a)) + np.repeat(found.links_b + 1 - in_b, in_a)
    place_b = np.arange(len(found.ids_b)) + np.repeat(found.links_a + 1, in_b)
    codes_a, codes_b = 2 * found.ids_a, 2 * (size_a + found.ids_b)
    codes_a[found.links_a] += 1
    codes_b[found.links_b] += 1
    codes = np.empty(len(place_a) + len(place_b), np.int64)
    codes[place_a], codes[place_b] = codes_a, codes_b
    texts, edges = printed[codes], (found.starts_a + found.starts_b).tolist()
    return [
        hashlib.sha256(b"".join(texts[start:end].tolist())[:-1]).hexdigest() if end > start else ""
        for start, end in zip(edges, edges[1:])
    ]


def pair_counts(found: Aligned, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked pairs of each text in order, how often each is linked, and where each text's pairs start."""
    pairs = found.ids_a[found.links_a] << shift | found.ids_b[found.links_b]
    text = np.repeat(np.arange(len(found.starts) - 1), np.diff(found.starts))
    order = np.lexsort((pairs, text))
    pairs, text = pairs[order], text[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return pairs[at], np.diff(np.append(at, len(pairs))), np.searchsorted(text[at], np.arange(len(found.starts)))


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``BATCH_ROWS`` rows and, but for a single row, ``BATCH_BYTES`` of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == BATCH_ROWS or held + size > BATCH_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def _shift(b: PieceVocabulary) -> int:
    return len(b.spelled).bit_length()


def _list(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, cuts (byte offsets in a space and the text) and linked tokens (by their place) of each row; no shuffle."""
    lists = ["ids_a", "ids_b", "cuts", "links_a", "links_b"]
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(x, T.ArrayType(T.LongType())) for x in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(byte_path, piece_path)
        for batch in _batches(batches, 1):
            found = align_batch(batch.column(1).to_pylist(), both)
            per_text = np.diff(found.starts)
            cut_before = np.concatenate(([0], found.cuts))[found.starts[:-1]]
            columns = [
                _list(found.ids_a, found.starts_a),
                _list(found.ids_b, found.starts_b),
                _list(found.cuts - np.repeat(cut_before, per_text), found.starts),
                _list(found.links_a - np.repeat(found.starts_a[:-1], per_text), found.starts),
                _list(found.links_b - np.repeat(found.starts_b[:-1], per_text), found.starts),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *lists])

    return source.mapInArrow(run, schema)


def linked_pairs(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of each row, and its distinct linked pairs (``a << shift | b``) with their numbers."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType(
        [source.schema["doc_id"], T.StructField("row", T.LongType()), *T._parse_datatype_string(_COUNTS).fields]
        + [T.StructField(x, T.ArrayType(T.LongType())) for x in ("pairs", "times")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(byte_path, piece_path)
        for batch in _batches(batches, 1):
            found = align_batch(batch.column(1).to_pylist(), both)
            pairs, times, starts = pair_counts(found, _shift(both.b))
            n_links = pa.array(np.diff(found.starts), pa.int64())
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array(np.diff(found.starts_a), pa.int64()),
                pa.array(np.diff(found.starts_b), pa.int64()),
                n_links,  # each cut ends one group with one link
                n_links,
                pa.array(digests(found, len(both.a.spelled), len(both.b.spelled)), pa.string()),
                _list(pairs, starts),
                _list(times, starts),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def _exploded(rows: DataFrame, pairs: str, times: str) -> DataFrame:
    zipped = F.explode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(times).alias("times"))).alias("x")
    return rows.select("row", zipped).select("row", "x.pair", "x.times")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Per row: counts of tokens, groups and links, how its links stand in the corpus, and the digest of its groups.

    ``n_best`` counts links whose pair is the commonest of its B id (ties
    included), ``count_sum`` sums the pair counts over the links.
    """
    spark = docs.sparkSession
    shift = _shift(encoder(byte_path, piece_path).b)
    rows = stage(linked_pairs(docs, byte_path, piece_path, id_col, text_col), "aligned", compression="zstd")
    counts = stage(_exploded(rows, "pairs", "times").groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND((1 << shift) - 1).alias("b")
    tops = counts.groupBy(b).agg(F.max("n").alias("top"))  # one row for each entry of vocabulary B at most
    ranked = counts.withColumn("b", b).join(F.broadcast(tops), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = ranked.filter(F.col("n") * heavy >= total).toArrow().sort_by("pair")  # ``heavy`` rows at most
    known = spark.sparkContext.broadcast(tuple(common.column(name).to_numpy() for name in ("pair", "n", "best")))
    plain = T._parse_datatype_string(_COUNTS).names
    schema = T.StructType(
        [rows.schema["doc_id"], rows.schema["row"], *(rows.schema[x] for x in plain)]
        + [T.StructField(x, T.LongType()) for x in ("best_here", "sum_here")]
        + [T.StructField(x, T.ArrayType(T.LongType())) for x in ("pairs", "times")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            pairs = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at = at[hit]
            counted = np.zeros((2, len(pairs) + 1), np.int64)
            counted[0, 1:][hit] = times[hit] * best[at]
            counted[1, 1:][hit] = times[hit] * n[at]
            counted = np.diff(np.cumsum(counted, axis=1)[:, starts])
            left = np.concatenate(([0], np.cumsum(~hit)))[starts]
            columns = [batch.column(x) for x in ("doc_id", "row", *plain)]
            columns += [pa.array(x, pa.int64()) for x in counted]
            columns += [_list(pairs[~hit], left), _list(times[~hit], left)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    scored = stage(rows.select("doc_id", "row", *plain, "pairs", "times").mapInArrow(run, schema), "scored", compression="zstd")
    rare = (
        _exploded(scored, "pairs", "times")
        .join(ranked, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_there"), F.sum(F.col("times") * F.col("n")).alias("sum_there"))
    )
    return scored.join(rare, "row", "left").select(
        "doc_id",
        *plain[:4],
        (F.col("best_here") + F.coalesce("best_there", F.lit(0))).alias("n_best"),
        (F.col("sum_here") + F.coalesce("sum_there", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
