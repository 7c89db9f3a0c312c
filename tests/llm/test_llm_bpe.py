import hashlib
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusvitals.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
OUTPUTS = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def both(reference, text):
    ids = reference.encode(text, add_special_tokens=False).ids
    packed = bpe.vocabulary(PATH).encode_many([text])[0]
    return bpe.ids_of(packed).tolist(), ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aaabcdeéÉ'’ \n\t,.!?0123stSΣςK"), st.characters(max_codepoint=0x2FF)), max_size=60))
def test_any_text_as_the_library_does(text):
    mine, theirs = both(bpe._library(PATH), text)
    assert mine == theirs


def test_every_common_character(reference):
    wrong = [c for c in map(chr, [*range(0x3000), *range(0x1F300, 0x1F700)]) if (pair := both(reference, f"ab{c}cd {c}"))[0] != pair[1]]
    assert wrong == []


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "it's I'LL 'Tis", "aaaaaaaaaaaaaaaaaaaaa", "ΟΔΟΣ", "x" * 5000, "é ﬁ", "日本語 テキスト 한국어", "👩‍👩‍👧 ok"])
def test_cases(reference, text):
    mine, theirs = both(reference, text)
    assert mine == theirs
    assert bpe.vocabulary(PATH).decode(mine) == reference.decode(theirs, skip_special_tokens=False)


def test_documents(spark, documents, reference):
    rows = bpe.encode(documents, PATH, OUTPUTS).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), decoded)
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_nasty_rows(nasty, empty, reference):
    rows = bpe.encode(nasty, PATH).collect()
    assert len(rows) == nasty.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert bpe.encode(empty, PATH).collect() == []
    back = bpe.decode(bpe.encode(nasty, PATH), PATH).filter("doc_id = 4").first()
    assert back.decoded == "one</w>"


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [f"some words{i} that change {i % 7}" for i in range(300)]
    whole = bpe.WordBpe(PATH).encode_many(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small = bpe.WordBpe(PATH)
    assert [small.encode_many([t])[0] for t in texts] == whole
    assert sys.byteorder == "little"
