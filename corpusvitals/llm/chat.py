"""Chat formatting with masks aligned by offsets.

A conversation is rendered in one template, encoded once with character
offsets, and each loss turn's span is intersected with the token spans by
binary search. Texts are escaped, so no text can open or close a turn, and
the escape is undone when the output is read back.

A conversation streams through its task in pieces of about ``PIECE`` chars,
cut after a turn, where the encoder's pre-splitting always cuts too: a
conversation of any length needs little memory and gets the ids that it
would get in one piece.

Defined results: null text and null role are empty; turns are ordered by turn
number, then role and text (null numbers first); null conversation ids form
one conversation; repeated rows are repeated turns; other columns are ignored.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice
from operator import le
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusvitals.llm.frames import text_of

OPEN, BODY, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that some chat template gives a meaning to; none survives in an escaped text.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLES = ("assistant",)
PIECE = 500_000

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

PIECES = "conv_id {id}, piece int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<int>"
DIGESTS = (
    "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_tokens long, n_loss_tokens long"
)


def escape(text: str) -> str:
    """A backslash goes before each backslash and into each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the loss turns' texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape_role(role) + BODY, escape(text)
        at += len(head)
        if role in loss_roles and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += head, body, CLOSE
    return "".join(parts), spans


def mask(starts: list[int], ends: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """1 for each token that shares a character with a span; both lists are sorted."""
    found = [0] * len(starts)
    for start, end in spans:
        first, last = bisect_right(ends, start), bisect_left(starts, end)
        found[first:last] = [1] * (last - first)
    return found


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # the template's own strings are ordinary text here
    return found


def _in_order(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Only the four columns; a conversation is in one partition, in the order of its turns."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


#: Characters of the pieces that go on together.
_TOGETHER = 1_000_000
_KINDS = [("conv_id", None), ("piece", pa.int32()), ("formatted", pa.string()), *((c, pa.list_(pa.int32())) for c in ("ids", "starts", "ends", "loss_mask"))]
Piece = tuple[object, int, str, list[int], list[int], list[int], list[int]]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, loss_roles: tuple[str, ...], piece: int) -> Iterator[Piece]:
    """Formatted pieces of sorted (conv_id, turn, role, text) rows: conversation, number, text, ids, offsets, mask."""
    encoder = tokenizer(path)
    held: list[tuple[str, str]] = []
    size, number, conv = 0, 0, None

    def out() -> Piece:
        text, spans = render(held, loss_roles)
        encoded = encoder.encode(text, add_special_tokens=False)
        starts, ends = map(list, zip(*encoded.offsets)) if encoded.ids else ([], [])
        return conv, number, text, encoded.ids, starts, ends, mask(starts, ends, spans)

    for batch in batches:
        for cid, role, text in zip(*(batch.column(i) for i in (0, 2, 3))):
            cid, role, text = cid.as_py(), role.as_py(), text.as_py()
            if held and (cid != conv or size >= piece):
                yield out()
                number = number + 1 if cid == conv else 0
                held, size = [], 0
            elif cid != conv:
                number = 0
            conv = cid
            held.append((role, text))
            size += len(text)
    if held:
        yield out()


def format_conversations(
    turns: DataFrame,
    path: str,
    loss_roles: tuple[str, ...] = LOSS_ROLES,
    piece: int = PIECE,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of the formatted conversations, in order: text, ids, offsets and loss mask.

    ``path`` is a byte-level tokenizer file. All but a few very long
    conversations have one piece.
    """
    rows = _in_order(turns, id_col, turn_col, role_col, text_col)
    key = to_arrow_type(rows.schema["conv_id"].dataType)

    def batch_of(held: list[Piece]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k or key) for c, (_, k) in zip(zip(*held), _KINDS)], [n for n, _ in _KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in _pieces(batches, path, loss_roles, piece):
            held.append(found)
            size += len(found[2])
            if size >= _TOGETHER:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.mapInArrow(run, PIECES.format(id=rows.schema["conv_id"].dataType.simpleString()))


def loss_text(formatted: str, starts: list[int], ends: list[int], masked: list[int]) -> Iterator[str]:
    """The escaped text of each loss turn, as the masked tokens cover it.

    A token may reach over the edge of a turn's text (white space may merge
    with the line break before it): it is clipped to the turn, whose markers
    are in the formatted text.
    """
    for turn in _TURN.finditer(formatted):
        start, end = turn.span(2)
        first, last = bisect_right(ends, start), bisect_left(starts, end)
        if 0 not in masked[first:last] and all(map(le, starts[first + 1 : last], ends[first : last - 1])):
            # no token is left out, and none leaves a gap
            low, high = (max(start, starts[first]), min(end, ends[last - 1])) if first < last else (0, 0)
            if low < high:
                yield formatted[low:high]
            continue
        at, parts = start, []
        for i in range(first, last):
            if masked[i]:
                low, high = max(at, starts[i]), min(end, ends[i])
                if low < high:
                    parts.append(formatted[low:high])
                    at = high
        if parts:
            yield "".join(parts)


def _digests(pieces: Iterator[Piece]) -> Iterator[tuple]:
    """The columns of ``DIGESTS`` for each conversation, from the formatted pieces alone."""
    state, conv = None, None

    def close() -> tuple:
        turns, n, loss, chars, total, tokens, loss_tokens = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, tokens, loss_tokens

    for cid, _, formatted, ids, starts, ends, masked in pieces:
        if state is None or cid != conv:
            if state is not None:
                yield close()
            state, conv = [hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0], cid
        for turn in _TURN.finditer(formatted):
            state[0].update(f"{unescape_role(turn[1])}\n{unescape(turn[2])}\n".encode())
            state[1] += 1
        for text in loss_text(formatted, starts, ends, masked):
            plain = unescape(text)
            state[2].update(plain.encode())
            state[3] += len(plain)
        state[4] += len(formatted)
        state[5] += len(ids)
        state[6] += sum(masked)
    if state is not None:
        yield close()


def _digest_batches(pieces: Iterator[Piece], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [f.partition(" ")[0] for f in DIGESTS.split(", ")]
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    rows = _digests(pieces)
    while held := list(islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from the formatted output alone.

    Takes the pieces as ``format_conversations`` gives them: those of one
    conversation follow each other in one partition.
    """
    key = to_arrow_type(pieces.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(column[i].as_py() for column in batch.columns) for batch in batches for i in range(batch.num_rows))
        return _digest_batches(rows, key)

    return pieces.mapInArrow(run, DIGESTS.format(id=pieces.schema["conv_id"].dataType.simpleString()))


def format_and_read(turns: DataFrame, path: str, loss_roles: tuple[str, ...] = LOSS_ROLES, piece: int = PIECE, **columns) -> DataFrame:
    """``read_back`` of ``format_conversations`` in one pass: the formatted
    pieces are read where they are made, and only digests leave the task."""
    names = {c: columns.get(f"{c}_col", d) for c, d in (("id", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text"))}
    rows = _in_order(turns, *names.values())
    key = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digest_batches(_pieces(batches, path, loss_roles, piece), key)

    return rows.mapInArrow(run, DIGESTS.format(id=rows.schema["conv_id"].dataType.simpleString()))
