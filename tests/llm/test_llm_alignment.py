"""Cross-tokenizer alignment against the libraries and a plain merge."""

from collections import Counter
import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpusvitals.llm import alignment
from corpusvitals.llm.bpe import byte_characters

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_OF = {c: b for b, c in enumerate(byte_characters())}
A = Tokenizer.from_file(BYTES)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=PIECES)


def tokens(text):
    """[(id, bytes)] of A and B; none where they do not spell the text."""
    if not text:
        return [], []
    a = A.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in a]
    b = [(i, B.id_to_piece(i)) for i in B.encode(text)]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def groups(a, b):
    """[(A tokens, B tokens)] between common ends, one text after the other."""
    found, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            found[-1][0].append(a[i][0])
            at_a, i = at_a + len(a[i][1]), i + 1
        else:
            found[-1][1].append(b[j][0])
            at_b, j = at_b + len(b[j][1]), j + 1
        if at_a == at_b:
            found.append(([], []))
    return found[:-1]


def brute(texts):
    parts = [tokens(text) for text in texts]
    cut = [groups(*p) for p in parts]
    links = [[(x[-1], y[-1]) for x, y in g] for g in cut]
    count = Counter(link for g in links for link in g)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for (a, b), g, linked in zip(parts, cut, links):
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append(
            (len(a), len(b), len(g), len(linked), sum(count[x] == top[x[1]] for x in linked), sum(count[x] for x in linked))
            + (hashlib.sha256(printed.encode()).hexdigest() if a else "",)
        )
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_rows(spark, nasty, empty, documents):
    odd = ["▁", "a▁b", "\x00\x07\n\n", "<s> </s> <|endoftext|> <0x41>", "é \U0001f600 ﬁ", " ", "  x", "一" * 40]
    strange = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for docs in (strange, nasty, documents):
        texts = [r.text for r in docs.select("text").collect()]
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        wanted = Counter(zip(ids, brute(texts)))
        for heavy in (alignment.HEAVY, 50, 0):  # all pairs, the commonest and none by the way of the tasks
            rows = alignment.align(docs, BYTES, PIECES, heavy=heavy).collect()
            assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in rows) == wanted
    assert alignment.align(empty, BYTES, PIECES).collect() == []
    assert alignment.alignments(empty, BYTES, PIECES).collect() == []


def test_alignments_name_tokens_and_cuts(nasty):
    for row in alignment.alignments(nasty.filter("doc_id in (2, 5, 8, 10)"), BYTES, PIECES).collect():
        text = {r.doc_id: r.text for r in nasty.select("doc_id", "text").collect()}[row.doc_id]
        a, b = tokens(text)
        assert (row.ids_a, row.ids_b) == ([i for i, _ in a], [i for i, _ in b])
        for ours, links in ((a, row.links_a), (b, row.links_b)):
            ends = np.cumsum([len(x) for _, x in ours]).tolist() if ours else []
            assert [ends[i] for i in links] == row.cuts
        assert not text or row.cuts[-1] == len((" " + text).encode())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_lockstep(a, b, edges):
    a, b = (np.array(sorted(x | {61}), np.int64) for x in (a, b))
    edges = np.array(sorted({0, 61} | edges))
    links_a, links_b, cuts = alignment.lockstep(a, b, edges)
    assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert a[links_a].tolist() == b[links_b].tolist() == cuts.tolist()


def test_stretches_change_nothing():
    both = alignment.encoder(BYTES, PIECES)
    texts = ["", "one two", "x" * 3000, "some longer words, and more of them. " * 90]
    whole = alignment.align_batch(texts, both, stretch=10**9)
    for stretch in (1, 7, 512):
        cut = alignment.align_batch(texts, both, stretch=stretch)
        assert all((x == y).all() for x, y in ((cut.links_a, whole.links_a), (cut.links_b, whole.links_b), (cut.cuts, whole.cuts)))


PARTS = [" ", " ", "\n", "\t", "\x1c", "\u00a0", "\u3000", "a", "it's", "don't", "12", ".", "...", "é", "▁", "🙂", "\u0301", "word", "<0x0A>", "'", "'s", "<s>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.characters(exclude_categories=("Cs",)), max_size=12).map("".join), max_size=4))
def test_words_are_encoded_as_in_their_text(texts):
    both = alignment.encoder(BYTES, PIECES)
    ids = [[ids[a:b].tolist() for a, b in zip(starts, starts[1:])] for ids, starts in both.encode(texts)]
    assert [tuple(x) for x in zip(*ids)] == [tuple([i for i, _ in side] for side in tokens(text)) for text in texts]
