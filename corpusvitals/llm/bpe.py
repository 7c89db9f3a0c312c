"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a slice of documents are laid out in one symbol
array. An index maps each mergeable pair to all its positions; the active
ranks are applied in ascending order, each to all positions of its pair at
once, and only the lists of the neighbouring pairs are updated. Words met
before come from a bounded cache.

Defined results: a null text is encoded like an empty one (no ids, empty
decoded text); repeated rows give repeated results; other columns of the
input are ignored, whatever their names; an empty table gives an empty one.
"""

from collections.abc import Callable, Iterable, Iterator
from functools import cache
import array
import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
import regex

from corpusvitals.llm.frames import slices, text_of

CACHE_WORDS = 400_000
CACHE_CHARS = 12_000_000
_SHIFT = 20
#: Characters beyond the Latin letters, common punctuation and signs.
_RARE = re.compile("[^\u0000-\u036f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file of the "BPE with word ends" kind, read from ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.token_of = {i: token for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of.update({i: token for token, i in self.special.items()})
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        self._path = path
        characters = byte_characters()
        self._byte_of = {c: b for b, c in enumerate(characters)}
        self._inner = [vocab.get(c, -1) for c in characters]
        self._last = [vocab.get(c + suffix, -1) for c in characters]
        self._merges: list[tuple[int, int, int]] = []
        self._rank: dict[int, int] = {}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, merged = vocab[left], vocab[right], vocab[left + right]
            self._rank.setdefault(a << _SHIFT | b, len(self._merges))
            self._merges.append((a, b, merged))
        made = {}
        for rank, (_, _, merged) in enumerate(self._merges):
            made.setdefault(merged, rank)
        # one rank can then be applied to all its positions before the next
        self.ordered = all(max(made.get(a, -1), made.get(b, -1)) < r for r, (a, b, _) in enumerate(self._merges))
        if not self.ordered:
            raise ValueError("a merge is ranked before those that make its parts")
        self._known: dict[str, bytes] = {}
        self._known_chars = 0

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens inside it stay whole."""
        words: list[str] = []
        for i, part in enumerate(self._cut.split(text)) if self._cut else [(0, text)]:
            if i % 2:
                words.append(part)
            elif part:
                if not part.isascii():
                    if _RARE.search(part):
                        words += self._split_rare(part)
                        continue
                    part = unicodedata.normalize("NFC", part)
                words += self._words(part.lower())
        return words

    def _split_rare(self, part: str) -> list[str]:
        """The library's own splitting, for scripts whose letters differ between Unicode versions."""
        library = _library(self._path)
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
        return [bytes(map(self._byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by an index from pair to positions over all of them."""
        rank_of, merges = self._rank, self._merges
        symbols: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbols))
            raw = word.encode()
            symbols += [self._inner[b] for b in raw[:-1]]
            symbols.append(self._last[raw[-1]])
        starts.append(len(symbols))
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        for start, end in zip(starts, starts[1:]):
            after[end - 1] = before[start] = -1
        positions: dict[int, list[int]] = {}
        for p, q in enumerate(after):
            if q >= 0 and (rank := rank_of.get(symbols[p] << _SHIFT | symbols[q])) is not None:
                positions.setdefault(rank, []).append(p)
        active = list(positions)
        heapq.heapify(active)

        while active:
            rank = heapq.heappop(active)
            a, b, merged = merges[rank]
            places = positions.pop(rank)
            places.sort()
            for p in places:
                q = after[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:
                    continue  # an earlier merge took one of the two
                symbols[p], symbols[q] = merged, -1
                after[p] = r = after[q]
                if r >= 0:
                    before[r] = p
                    after_it = rank_of.get(merged << _SHIFT | symbols[r])
                    if after_it is not None:
                        if after_it in positions:
                            positions[after_it].append(p)
                        else:
                            positions[after_it] = [p]
                            heapq.heappush(active, after_it)
                left = before[p]
                if left >= 0:
                    before_it = rank_of.get(symbols[left] << _SHIFT | merged)
                    if before_it is not None:
                        if before_it in positions:
                            positions[before_it].append(left)
                        else:
                            positions[before_it] = [left]
                            heapq.heappush(active, before_it)
        return [[s for s in symbols[start:end] if s >= 0] for start, end in zip(starts, starts[1:])]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(text) for text in texts]
        known = self._known
        if len(known) > CACHE_WORDS or self._known_chars > CACHE_CHARS:
            known.clear()
            self._known_chars = 0
        if not known:
            known.update({token: i.to_bytes(4, "little") for token, i in self.special.items()})
        fresh = list({word for words in split for word in words if word not in known})
        for word, ids in zip(fresh, self.merge(fresh)):
            known[word] = b"".join(i.to_bytes(4, "little") for i in ids)
        self._known_chars += sum(map(len, fresh))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: the vocabulary names no decoder."""
        return " ".join(map(self.token_of.__getitem__, ids))


def ids_of(packed: bytes) -> array.array:
    ids = array.array("I", packed)
    if array.array("I", [1]).tobytes()[0] == 0:
        ids.byteswap()
    return ids


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


#: What ``encode`` can return: name -> (type, value from vocabulary and packed ids).
OUTPUTS: dict[str, tuple[T.DataType, Callable[[WordBpe, bytes], object]]] = {
    "ids": (T.ArrayType(T.IntegerType()), lambda bpe, packed: ids_of(packed).tolist()),
    "n_tokens": (T.LongType(), lambda bpe, packed: len(packed) // 4),
    "ids_sha256": (T.StringType(), lambda bpe, packed: hashlib.sha256(packed).hexdigest()),
    "decoded": (T.StringType(), lambda bpe, packed: bpe.decode(ids_of(packed))),
    "decoded_sha256": (
        T.StringType(),
        lambda bpe, packed: hashlib.sha256(bpe.decode(ids_of(packed)).encode()).hexdigest(),
    ),
}


def encode(
    docs: DataFrame,
    path: str,
    outputs: tuple[str, ...] = ("ids", "n_tokens"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The id column and ``outputs`` for each row; no shuffle, a few texts at a time."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fields = [T.StructField(name, OUTPUTS[name][0]) for name in outputs]
    schema = T.StructType([source.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            packed = bpe.encode_many(batch.column(1).to_pylist())
            columns = [batch.column(0)]
            for name in outputs:
                values = [OUTPUTS[name][1](bpe, p) for p in packed]
                kind = pa.list_(pa.int32()) if name == "ids" else pa.int64() if name == "n_tokens" else pa.string()
                columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *outputs])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids in ``decoded``; null ids give a null text."""

    @F.pandas_udf(T.StringType())
    def text(ids):
        bpe = vocabulary(path)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return rows.withColumn("decoded", text(F.col(ids_col)))
