"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Bit ``i`` carries a non-zero vector of ``radius + 1`` bits, and each non-zero
vector ``v`` gives a table whose mask has the bits not orthogonal to it. Some
``v`` is orthogonal to any ``radius`` vectors, so two fingerprints within the
radius agree under one mask at least: every pair meets in some table.

Buckets may be crowded, so no pairs are listed. Two members of a bucket are
within the radius exactly when some word lies within half of it of both, and
that word differs from them in free bits only. Each member of a crowded
bucket names those words (29 for radius 2); those that name the same word
are linked to the smallest of them. A word has 65 such neighbours at most.

Defined results: null texts are empty, and empty texts have fingerprint zero;
repeated rows are copies; null ids are never the smallest unless a group has
no others; other columns are ignored. A text of any length is one row's work.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from corpusvitals.llm.components import components
from corpusvitals.llm.frames import join_labels, keep_rows, slices, text_of
from corpusvitals.session import stage

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text over the XXH64 of its word shingles, as a signed 64-bit number."""
    words = text.encode().lower().split()  # of bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    set_in = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (hash of the text) and fp of each row; no shuffle."""
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text")
    )
    schema = T.StructType([source.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(text, shingle) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "mark", "fp"])

    return source.mapInArrow(run, schema)


def _signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def masks(radius: int = RADIUS) -> list[int]:
    """One mask per non-zero vector; bits take the vectors in turn."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for bit in range(BITS) if ((bit % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (high, low) between the distinct ``fp``; their components are those of all pairs within ``radius``."""
    if radius % 2:
        raise ValueError("only even radii have a midpoint")
    tables = masks(radius)
    members = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables)])
        ).alias("x"),
    ).select("fp", "x.t", "x.key")
    crowded = members.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("t", "key")
    flips = []  # per table: the words that differ in up to half the radius of free bits
    for m in tables:
        free = [b for b in range(BITS) if not m >> b & 1]
        words = [sum(1 << b for b in c) for n in range(radius // 2 + 1) for c in combinations(free, n)]
        flips.append(F.array(*[F.lit(_signed(w)) for w in words]))
    flip = F.when(F.col("t") == 0, flips[0])
    for t, words in enumerate(flips[1:], 1):
        flip = flip.when(F.col("t") == t, words)
    near = members.join(crowded, ["t", "key"]).select("fp", F.explode(flip).alias("f"))
    return (
        near.groupBy(F.col("fp").bitwiseXOR(F.col("f")).alias("word"))
        .agg(F.collect_set("fp").alias("fps"))  # a word's neighbours: 65 at most
        .filter(F.size("fps") > 1)
        .select(F.explode("fps").alias("high"), F.array_min("fps").alias("low"))
        .filter("high <> low")
        .distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, fp, component_id (smallest id of those reachable) of each row."""
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = stage(components(links(fps.select("fp"), radius)), "roots").withColumnRenamed("node", "fp")
    firsts = roots.join(fps.select("fp", "first"), "fp").groupBy("root").agg(F.min("first").alias("reached"), F.count("*").alias("n"))
    linked = join_labels(roots, stage(firsts, "firsts"), "root").select("fp", "reached")
    labels = fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("reached", "first").alias("component_id"))
    return join_labels(rows, stage(labels, "labels"), "fp").select("doc_id", "mark", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def dedup(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one of smallest id, ties by text hash."""
    found = near_duplicates(docs, radius, id_col, text_col)
    # without any id a component has no name: its fingerprint stands in
    name = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = (
        found.groupBy("component_id", name.alias("unnamed"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("k"))
        .select("k.doc_id", "k.mark")
    )
    return keep_rows(docs, kept, id_col, text_col)
