"""The pipeline, stage by stage, against plain counterparts."""

import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusvitals.llm import quality
from test_llm_decontaminate import brute
from test_llm_dedup import naive_components, naive_fingerprint

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    machine = quality.train(documents, labels)
    docs = {r.doc_id: r.text or "" for r in documents.collect()}
    docs = {i: t for i, t in docs.items() if machine.score(t) >= 0.5}
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    docs = {i: docs[i] for i in first.values()}
    components = naive_components({i: naive_fingerprint(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if components[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute(list(docs.items()), items) if r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = set()
    for i in docs.keys() - dirty:
        ids = library.encode(docs[i], add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        wanted.add((i, len(ids), hashlib.sha256(packed).hexdigest()))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in rows} == wanted
    assert len(rows) == len(wanted) < documents.count()


def test_stages_keep_the_columns(spark, nasty):
    docs = nasty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == nasty.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nasty.limit(0), SF).collect() == []
