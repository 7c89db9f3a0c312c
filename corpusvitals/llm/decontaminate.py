"""Benchmark decontamination with a broadcast set of normalised n-grams.

A window is 13 consecutive words of a benchmark item, or the whole of a
shorter one. The windows go to the tasks as a hash set inside the plan, after
a check of their number and size. A document is first probed at every tenth
position with four words: any window covers such a probe, so a document
without a known probe has no hit. Only the others are scanned window by
window; a window whose hash is known is verified by its full text. A benchmark
beyond the bound is met by an ordinary join instead, with equal results.

Everything is DataFrame expressions; no text is shuffled.

Defined results: null texts have no words and are never contaminated; items
without words have no window, those without an id are hit but not counted; repeated rows are judged alike; an empty
benchmark leaves every document clean; other columns are kept by
``decontaminate`` and ``remove_spans`` and ignored by ``contamination``.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvitals.functions.text import once
from corpusvitals.llm.frames import text_of
from corpusvitals.session import stage

WINDOW = 13
PROBE = 4
SET_WINDOWS = 50_000
SET_BYTES = 16_000_000
#: A document is contaminated when one word in so many is hit.
RATIO = 20

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, _GAP), lambda w: w != "")


def _gram(tokens: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(tokens, start + 1, length), " ")


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, gram, length) of the benchmark."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(text_of(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.size("w")
    grams = F.when(size >= window, F.transform(F.sequence(F.lit(0), size - window), lambda i: _gram(F.col("w"), i, window))).otherwise(
        F.array(F.array_join("w", " "))
    )
    return items.select("item_id", F.explode(grams).alias("gram"), F.least(size, F.lit(window)).alias("length")).distinct()


_NO_HITS = "CAST(array() AS array<struct<start:int,length:int,gram:string>>)"


def contained(values: list, value: str) -> str:
    """SQL test for membership; a list of literals becomes a hash set. Words hold neither quotes nor backslashes."""
    return f"{value} IN ({', '.join(f"'{v}'" if isinstance(v, str) else f"{v}L" for v in values)})"


def _words_sql(start: str, length: int) -> str:
    return f"slice(w, {start} + 1, {length})"


def _starts_sql(length: int, step: int = 1) -> str:
    return f"if(size(w) >= {length}, sequence(0, size(w) - {length}, {step}), CAST(array() AS array<int>))"


def hits_by_set(grams: list) -> Column:
    """Sorted (start, length, gram) of all windows in the words ``w`` that are
    among ``grams`` (rows of ``bounded_grams``): found by hash, verified by text."""
    by_length: dict[int, list] = {}
    for row in grams:
        by_length.setdefault(row.length, []).append(row)
    found = []
    for length, rows in sorted(by_length.items()):
        probe = min(PROBE, length)
        step = length - probe + 1  # each window covers a probed position, with the words after it
        probes = sorted({h for r in rows for h in r.probes})
        known = f"exists({_starts_sql(probe, step)}, p -> {contained(probes, f'xxhash64({_words_sql("p", probe)})')})"
        hashed = contained(sorted(r.hash for r in rows), f"xxhash64({_words_sql('i', length)})")
        shaped = f"named_struct('start', i, 'length', {length}, 'gram', array_join({_words_sql('i', length)}, ' '))"
        every = f"transform(filter({_starts_sql(length)}, i -> {hashed}), i -> {shaped})"
        verified = f"filter({every}, h -> {contained(sorted(r.gram for r in rows), 'h.gram')})"
        found.append(f"if({known}, {verified}, {_NO_HITS})")
    if not found:
        return F.expr(_NO_HITS)
    return F.expr(f"array_sort(concat({', '.join(found)}))" if len(found) > 1 else found[0])


#: Words inside any window of the sorted ``hits``.
COVERED = """aggregate(hits, named_struct('upto', 0, 'n', 0L), (a, h) -> named_struct(
    'upto', greatest(a.upto, h.start + h.length),
    'n', a.n + greatest(0, h.start + h.length - greatest(a.upto, h.start))), a -> a.n)"""


def bounded_grams(grams: DataFrame, most: int = SET_WINDOWS, most_bytes: int = SET_BYTES) -> list | None:
    """The distinct (gram, length, hash, probes) if their number and size are within the bounds, else None."""
    distinct = grams.select("gram", "length").distinct()
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    if n > most or size > most_bytes:
        return None
    tokens = F.split("gram", " ")
    probe = F.least(F.lit(PROBE), F.col("length"))
    probes = F.transform(F.sequence(F.lit(0), F.col("length") - probe), lambda i: F.xxhash64(F.slice(tokens, i + 1, probe)))
    return distinct.select("gram", "length", F.xxhash64(tokens).alias("hash"), probes.alias("probes")).collect()


def _judged(rows: DataFrame) -> DataFrame:
    """Add n_hit and contaminated to rows with n_words and sorted hits."""
    return rows.withColumn("n_hit", F.expr(COVERED)).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words"))
    )


def _hits_by_join(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, hits) of ``rows(row, w)`` that have any, by an equi-join on the window texts."""
    lengths = [r.length for r in grams.select("length").distinct().collect()]  # WINDOW numbers at most
    every = [
        f"transform({_starts_sql(m)}, i -> named_struct('start', i, 'length', {m}, 'gram', array_join({_words_sql('i', m)}, ' ')))"
        for m in sorted(lengths)
    ]
    placed = rows.select("row", F.explode(F.expr(f"concat({', '.join([_NO_HITS, *every])})")).alias("h"))
    known = grams.select(F.col("gram").alias("known")).distinct()
    return (
        placed.join(known, placed["h.gram"] == known["known"], "left_semi")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("h")).alias("hits"))  # a document's own windows
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    set_windows: int = SET_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hits of each row."""
    grams = stage(windows(benchmark, window), "windows")
    listed = bounded_grams(grams, set_windows)
    rows = docs.select(F.col(id_col).alias("doc_id"), once(w=words(text_of(text_col))))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    if listed is None:
        rows = stage(rows, "words")
        rows = rows.join(_hits_by_join(rows, grams), "row", "left").withColumn(
            "hits", F.coalesce("hits", F.expr(_NO_HITS))
        )
    else:
        rows = rows.withColumn("hits", hits_by_set(listed))
    # written once: row numbers stay what they are, and only rows with hits go on
    rows = stage(rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "hits"), "hits")
    judged = _judged(rows)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]
    clean = judged.filter(F.size("hits") == 0).select(
        "*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256")
    )
    hit = judged.filter(F.size("hits") > 0)
    items = grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    named = (
        hit.select("row", F.explode(F.array_distinct("hits.gram")).alias("gram"))
        .join(items, "gram")
        .select("row", F.explode_outer("items").alias("item"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))  # items of the benchmark
    )
    found = hit.join(named, "row").select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    return clean.select(*columns).union(found.select(*columns))


def _with_hits(
    docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, set_windows: int, joined: bool = False
) -> DataFrame | None:
    """``docs`` packed as ``d`` beside words and hits. A benchmark too large for
    a set is met by a join if ``joined``, else there is none."""
    grams = windows(benchmark, window)
    listed = bounded_grams(grams, set_windows)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), text_of(text_col).alias("t"))
    rows = packed.select("d", "t", once(w=words(F.col("t"))))
    if listed is not None:
        return rows.select("d", "t", "w", once(hits=hits_by_set(listed), n_words=F.size("w")))
    if not joined:
        return None
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "words")
    found = stage(_hits_by_join(rows.select("row", "w"), stage(grams, "windows")), "hits")
    hit = rows.join(found, "row")  # only the texts with hits move, and those that are looked for
    clean = rows.join(found.select("row"), "row", "left_anti").withColumn("hits", F.expr(_NO_HITS))
    return hit.unionByName(clean).select("d", "t", "w", "hits", F.size("w").alias("n_words"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", set_windows: int = SET_WINDOWS
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; row by row, without a shuffle."""
    rows = _with_hits(docs, benchmark, window, text_col, set_windows)
    if rows is None:
        helper = "__doc_row"
        whole = stage(docs.withColumn(helper, F.monotonically_increasing_id()), "whole")
        found = contamination(whole, benchmark, window, helper, text_col, set_windows).filter("contaminated")
        return whole.join(found.select(F.col("doc_id").alias(helper)), helper, "left_anti").select(*docs.columns)
    return _judged(rows).filter("NOT contaminated").select("d.*")


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", set_windows: int = SET_WINDOWS
) -> DataFrame:
    """``docs`` without the words inside any window, and without the gap before each; other texts stay as they are."""
    rows = _with_hits(docs, benchmark, window, text_col, set_windows, joined=True)
    pieces = F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))
    inside = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("w") - 1), inside)
    tail = F.regexp_extract("t", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)
    left = F.concat(F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), ""), tail)
    cleaned = F.when(F.size("hits") > 0, left).otherwise(F.col("d")[text_col])
    return rows.select(*[cleaned.alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns])
