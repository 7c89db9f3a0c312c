"""Near-duplicate lines by a segment-partition edit join.

A line of n characters is cut into ``max_edits + 1`` even segments. Lines
within ``max_edits`` edits keep at least one segment of the shorter whole, at
a place that the length difference and the segment's number bound. So each
line is indexed under its segments, probes the few substrings that may equal
a segment of a line as long or slightly shorter, and candidates are verified
by edit distance, computed bit-parallel in a band of ``2 * max_edits + 1``.

Shorter lines, from ``short_chars`` to under ``min_chars``, are near within
one edit: both without the letter in one place are equal, or the longer
without one letter is the shorter. Those are the keys, so only pairs of the
result meet.

Long lines may also differ in words: with ``word_run``, one of R, lines are
near when the shorter has w words and at most ``(w - R) // (R + 1)`` words
have to be replaced, added or removed. So few edits leave a run of R words
whole in both. Of each ``R - GRAM + 1`` words in a row the one of smallest
hash is chosen, and with the ``GRAM - 1`` words behind it is a key: a shared
run gives a shared key, wherever it stands, and no pair is lost.

Texts are shuffled once, for the distinct lines; the index holds hashes. Letter
counts that differ too much end a candidate inside the join.

Defined results: a line is trimmed of white space; blank lines are never
repeats; lines under ``min_chars`` are equal only to themselves; null texts
have no lines; the smallest id names a class, null ids only where there is no
other; other columns are ignored by ``line_classes``, kept by
``remove_repeats``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvitals.llm.components import components
from corpusvitals.llm.frames import text_of
from corpusvitals.session import stage

MAX_EDITS = 2
MIN_CHARS = 20
#: Up to so many line numbers or keys (8 bytes each, keys with a count 16) go to the tasks; more are met by a shuffled join.
BROADCAST_IDS = 1_000_000

#: Of the query: in a line of one or two characters an edit replaces half of it or more.
SHORT_CHARS = 3
#: Of the query: two edits from so many characters on, one below.
TWO_EDITS_CHARS = 12
#: Of the query: one word edit from 33 words on, two from 50, then one more for each 17.
WORD_RUN = 16
#: Words in a key of a long line.
GRAM = 5
#: A run of words in more lines is met by number of words, others at once.
CROWDED = 16
#: So many lines of a crowded key meet all its lines, before those of different classes meet each other.
CENTRES = 2
#: Words of two lines are compared by so many bits first.
_PARITIES = 256

#: Bits of a key: what two keys have in common by chance is verified away.
_KEY = (1 << 48) - 1
_SPACE = " \t\r\f\v"
_COUNTED = "aeinorstdh"


def _line(column: Column) -> Column:
    return F.btrim(column, F.lit(_SPACE))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None, placed: bool = False) -> DataFrame:
    """doc_id and line of each line that is not blank; ``placed``: also h (hash of the text) and at (from 0), with ``row_col`` row."""
    text = text_of(text_col)
    more = [F.xxhash64(text).alias("h")] if placed else []
    more += [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    names = ["doc_id", *(["h"] if placed else []), *(["row"] if row_col else []), *(["at"] if placed else [])]
    return rows.select(*names, _line(F.col("raw")).alias("line")).filter("line <> ''")


def _hinted(ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """Written ids, for the tasks if they are few."""
    return F.broadcast(ids) if ids.count() <= broadcast_ids else ids


def distinct_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    placed: bool = False,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """line, copies, doc_id (the smallest) of each distinct line that is not blank.

    ``placed``: also ``first``, its first occurrence by doc_id (nulls last),
    hash of the text, row (where ``row_col`` gives one) and place. Most lines
    occur once and stay where they are: only those whose hash is met again
    are grouped, by their texts.
    """
    occurrences = _occurrences(docs, id_col, text_col, row_col, placed).withColumn("mark", F.xxhash64("line"))
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h", *(["row"] if row_col else []), "at") if placed else None
    again = stage(occurrences.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "again")
    again = _hinted(again, broadcast_ids)
    alone = occurrences.join(again, "mark", "left_anti").select(
        "line", F.lit(1).cast("long").alias("copies"), "doc_id", *([place.alias("first")] if placed else [])
    )
    grouped = (
        occurrences.join(again, "mark", "left_semi")
        .groupBy("line")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), *([F.min(place).alias("first")] if placed else []))
    )
    return alone.unionByName(grouped)


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i``; the last ones take what is left over."""
    base = F.floor(length / parts).cast("int")
    short = parts - length % parts
    return base * i + F.greatest(F.lit(0), i - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _key(i: int, length: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), length, F.substring(F.col("line"), start + 1, size)).bitwiseAND(F.lit(_KEY))


def index_keys(max_edits: int) -> list[Column]:
    parts = max_edits + 1
    return [_key(i, F.col("n"), *_segment(F.col("n"), i, parts)) for i in range(parts)]


def probe_keys(max_edits: int, min_chars: int) -> tuple[list[Column], int]:
    """Substrings that may equal a segment of a line shorter by 0 to
    ``max_edits``, null where no such line is joined, and how many of them
    (the first ones) are for lines of equal length.

    Before segment ``i`` lie at most ``i`` edits and behind it at most
    ``max_edits - i``, which bounds its shift from either end.
    """
    parts = max_edits + 1
    keys, equal = [], 0
    for shorter in range(parts):
        equal = equal or (len(keys) if shorter else 0)
        length = F.col("n") - shorter
        for i in range(parts):
            start, size = _segment(length, i, parts)
            low = max(-i, shorter - (max_edits - i))
            high = min(i, shorter + (max_edits - i))
            for shift in range(low, high + 1):
                keys.append(F.when(length >= min_chars, _key(i, length, start + shift, size)))
    return keys, equal or len(keys)


def with_letters(lines: DataFrame) -> DataFrame:
    """Add ``letters``: counts of some letters modulo 16, in Gray code of four bits each.

    An edit changes two counts by one at most, and neighbouring codes differ
    in one bit, so each edit changes two bits at most.
    """
    packed = F.lit(0).cast("long")
    for i, letter in enumerate(_COUNTED):
        n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(letter), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(F.lit(15)), 4 * i))
    inner = sum(7 << 4 * i for i in range(len(_COUNTED)))
    gray = F.col("letters").bitwiseXOR(F.shiftright("letters", 1).bitwiseAND(F.lit(inner)))
    return lines.withColumn("letters", packed).withColumn("letters", gray)


def candidates(lines: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """Distinct (high, low) of ``lines(line_id, line, letters)`` that share a segment."""
    long_enough = max(min_chars, max_edits + 1)
    rows = lines.select("line_id", "line", "letters", F.char_length("line").alias("n")).filter(F.col("n") >= long_enough)
    index = rows.select(
        F.col("line_id").alias("a"), F.col("letters").alias("la"), F.explode(F.array(*index_keys(max_edits))).alias("key")
    )
    probes, equal = probe_keys(max_edits, long_enough)
    # a few at a time: a larger method is not compiled by the JVM
    parts = [(some[i : i + 5], even) for some, even in ((probes[:equal], True), (probes[equal:], False)) for i in range(0, len(some), 5)]
    probe = reduce(
        DataFrame.union,
        [
            rows.select(F.col("line_id").alias("b"), F.col("letters").alias("lb"), F.lit(even).alias("even"), F.explode(F.array(*part)).alias("key"))
            for part, even in parts
        ],
    ).filter("key IS NOT NULL")
    # of two lines of one length, the one of larger number probes
    once = (F.col("a") < F.col("b")) | (~F.col("even") & (F.col("a") != F.col("b")))
    apart = F.bit_count(F.col("la").bitwiseXOR(F.col("lb"))) <= 2 * max_edits
    return (
        index.join(probe, (index["key"] == probe["key"]) & once & apart)
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def within(a: str, b: str, max_edits: int) -> Column:
    """Whether two text columns are within ``max_edits`` edits, by Hyyrö's banded bit-vectors.

    Bit ``r`` of a vector is the row ``j + r - max_edits`` of column ``j``.
    The distance follows the lowest diagonal of the band to the last row,
    then that row to its end. Needs texts longer than ``max_edits``.
    """
    k, width = max_edits, 2 * max_edits + 1
    full = (1 << width) - 1

    def code(text: str, place: str) -> str:  # code points are four bytes in UTF-32
        return f"substring({text}, 4 * ({place}) + 1, 4)"

    matches = " + ".join(
        f"if(j + {r - k} >= 0 AND j + {r - k} < n AND {code('s', f'greatest(j + {r - k}, 0)')} = c, {1 << r}L, 0L)" for r in range(width)
    )
    column = _let("c", code("t", "j"), matches)
    vertical = f"named_struct('vp', (hn | ~(shiftright(d, 1) | hp)) & {full}L, 'vn', shiftright(d, 1) & hp, 'score', {{}})"
    diagonal = f"v.score + if(shiftright(d, {2 * k}) & 1L = 0, 1, 0)"
    row = f"n - 1 - j + {k}"
    last_row = f"v.score + CAST(shiftright(hp, {row}) & 1L AS INT) - CAST(shiftright(hn, {row}) & 1L AS INT)"
    step = vertical.format(f"if(j + {k} < n, {diagonal}, {last_row})")
    step = _let("hn", "d & v.vp", step)
    step = _let("hp", f"(v.vn | ~(d | v.vp)) & {full}L", step)
    step = _let("d", f"((((x & v.vp) + v.vp) ^ v.vp) | x | v.vn) & {full}L", step)
    step = _let("x", column, step)
    start = f"named_struct('vp', {((1 << (k + 1)) - 1) << k}L, 'vn', 0L, 'score', {k})"
    walk = f"aggregate(sequence(0, m - 1), {start}, (v, j) -> {step}, v -> v.score <= {k})"
    short = f"if(char_length({a}) <= char_length({b}), {a}, {b})"
    long = f"if(char_length({a}) <= char_length({b}), {b}, {a})"
    sized = _let("n", f"CAST(octet_length(s) DIV 4 AS INT)", _let("m", "CAST(octet_length(t) DIV 4 AS INT)", f"if(m - n > {k}, false, {walk})"))
    return F.expr(_let("s", f"encode({short}, 'UTF-32')", _let("t", f"encode({long}, 'UTF-32')", sized)))


def _words(line: str = "line") -> Column:
    """The pieces between blanks; letters of scripts without blanks are words of their own."""
    wide = F.regexp_replace(line, "([\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{2E80}-\\x{D7FF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}])", " $1 ")
    pieces = lambda text: F.split(text, "[ \\t\\r\\f\\x0B]+")
    # such letters have three bytes or more; the others leave no empty pieces
    some_wide = F.octet_length(line) > F.char_length(line) + 1
    return F.when(some_wide, F.filter(pieces(wide), lambda w: w != "")).otherwise(pieces(_line(F.col(line))))


def word_edits(words: Column, word_run: int) -> Column:
    return F.greatest(F.floor((words - word_run) / (word_run + 1)), F.lit(0)).cast("int")


def _paired(marks: Column, step: int) -> Column:
    """The smaller of each mark and the one ``step`` places on; beyond the end there is null, which ``least`` skips."""

    # one argument: a second one would be the element's place
    def smaller(m: Column) -> Column:
        return F.zip_with(m, F.slice(m, step + 1, F.size(m)), lambda x, y: F.least(x, y))

    return F.transform(F.array(marks), smaller)[0]


def _run_keys(word_run: int) -> Column:
    """(key, at) of the chosen words of ``words``; the last 24 bits of a mark are the word's place."""
    marks = F.transform("words", lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(i.cast("long")))
    # shorter lines have no word edit
    marks = F.when(F.col("w") > 2 * word_run, marks)
    size, have = word_run - GRAM + 1, 1
    least = marks
    while have < size:  # the smallest of ``have`` marks in a row, for each place
        step = min(have, size - have)
        least = _paired(least, step)
        have += step
    whole = F.slice(least, 1, F.greatest(F.col("w") - word_run + 1, F.lit(0)))
    place = lambda m: m.bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    return F.transform(
        F.array_distinct(whole), lambda m: F.struct(F.xxhash64(F.slice("words", place(m) + 1, GRAM)).bitwiseAND(F.lit(_KEY)).alias("key"), place(m).alias("at"))
    )


def _sized_keys(word_run: int) -> Column:
    """``key`` with ranges of ``w``, so that lines within the word edits of the shorter share a range.

    Ranges are over twice the word edits wide, a power of two, and lie in two
    grids, half a range apart. Where the width changes, the longer line takes
    that of the shortest line it may be near to as well.
    """

    def ranges(words: Column) -> Column:
        half = F.pow(F.lit(2), F.ceil(F.log2(word_edits(words, word_run) + 1))).cast("int")
        grids = [F.struct(half.alias("half"), F.lit(g).alias("g"), F.floor((F.col("w") + g * half) / (2 * half)).alias("bin")) for g in (0, 1)]
        return F.array(*grids)

    w = F.col("w")
    every = F.array_union(ranges(w), ranges(w - word_edits(w, word_run)))
    return F.transform(every, lambda r: F.xxhash64("key", r["half"], r["g"], r["bin"]).bitwiseAND(F.lit(_KEY)))


def _sides(rows: DataFrame, *names: str) -> list[DataFrame]:
    return [rows.select("key", *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "key"]) for side in names]


def _close(word_run: int) -> Column:
    """Whether rows x and y of one key have about the same number of words and the key at about the same place."""
    edits = word_edits(F.least("w_x", "w_y"), word_run)
    placed = (F.col("at_x") - F.col("to_y") <= edits) & (F.col("at_y") - F.col("to_x") <= edits)
    return (F.abs(F.col("w_x") - F.col("w_y")) <= edits) & placed & (edits > 0)


def _met(rows: DataFrame, near: Column) -> DataFrame:
    """(high, low) of ``rows(key, line_id, ...)`` that share a key and are ``near``."""
    one, two = _sides(rows, "x", "y")
    met = one.join(two, "key").filter((F.col("line_id_x") > F.col("line_id_y")) & near)
    return met.select(F.col("line_id_x").alias("high"), F.col("line_id_y").alias("low"))


def _centred(rows: DataFrame, near: Column, salt: int) -> DataFrame:
    """(high, low) of each key's rows and one of them, if they are ``near``; by ``salt`` it is another one."""
    names = [c for c in rows.columns if c != "key"]
    one, two = _sides(rows, "x")[0], rows.groupBy("key").agg(F.min_by(F.struct(*names), F.xxhash64("key", "line_id", F.lit(salt))).alias("c"))
    met = one.join(_sides(two.select("key", "c.*"), "y")[0], "key").filter((F.col("line_id_x") != F.col("line_id_y")) & near)
    return met.select(F.greatest("line_id_x", "line_id_y").alias("high"), F.least("line_id_x", "line_id_y").alias("low"))


def long_keys(lines: DataFrame, word_run: int) -> DataFrame:
    """line_id, w, key, at, to of ``lines(line_id, line)``: a row for each key of a line, from its first to its last place."""
    # n words have n - 1 blanks between them, unless their letters are words
    rows = lines.filter(F.char_length("line") > 2 * word_run).select("line_id", _words().alias("words")).withColumn("w", F.size("words"))
    rows = rows.select("line_id", "w", F.sort_array(_run_keys(word_run)).alias("ks"))
    # words that repeat give one key at many places
    ks, other = F.col("ks"), lambda i, k: F.coalesce(F.get(F.col("ks"), i)["key"] != k["key"], F.lit(True))
    first = F.filter(ks, lambda k, i: other(i - 1, k))
    last = F.filter(ks, lambda k, i: other(i + 1, k))
    once = F.zip_with(first, last, lambda a, b: F.struct(a["key"].alias("key"), a["at"].alias("at"), b["at"].alias("to")))
    return rows.select("line_id", "w", F.explode(once).alias("k")).select("line_id", "w", "k.*")


def _marked(texts: DataFrame) -> DataFrame:
    """line_id, w and odd (the parities of its words) of ``texts(line_id, line)``."""
    words = texts.select("line_id", _words().alias("words"))
    marks = words.select("line_id", F.size("words").alias("w"), F.transform("words", lambda w: F.xxhash64(w)).alias("marks"))
    return marks.select("line_id", "w", *[c.alias(f"odd{k}") for k, c in enumerate(_parities())])


def _apart(x: str, y: str) -> Column:
    return sum(F.bit_count(F.col(f"odd{k}_{x}").bitwiseXOR(F.col(f"odd{k}_{y}"))) for k in range(_PARITIES // 64))


def _alike(word_run: int) -> Column:
    return _close(word_run) & (_apart("x", "y") <= 2 * word_edits(F.least("w_x", "w_y"), word_run))


def _shared_runs(lines: DataFrame, word_run: int, broadcast_ids: int) -> tuple[DataFrame, DataFrame]:
    """(high, low) of lines that share a run of words which few lines have, and the rows of the others, with parities."""
    # chosen once; most keys stand in one line only, and those go no further
    rows = stage(long_keys(lines, word_run), "run-keys", compression="zstd")
    shared = stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    rows = stage(rows.join(_hinted(shared, broadcast_ids), "key"), "met-keys", compression="zstd")
    few = _met(rows.filter(F.col("n") <= CROWDED).drop("n"), _close(word_run))
    # a passage may stand in many lines: only those of about the same number of words meet
    rows = rows.filter(F.col("n") > CROWDED)
    rows = stage(rows.select("line_id", "w", "at", "to", F.explode(_sized_keys(word_run)).alias("key")), "sized-keys", compression="zstd")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rows = stage(rows.join(_hinted(stage(shared, "shared"), broadcast_ids), "key", "left_semi"), "shared-keys", compression="zstd")
    ids = stage(rows.select("line_id").distinct(), "crowded")
    marked = _marked(lines.select("line_id", "line").join(_hinted(ids, broadcast_ids), "line_id")).drop("w")
    return few, rows.join(stage(marked, "crowded-parities"), "line_id")


def long_candidates(lines: DataFrame, word_run: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Distinct (high, low) of ``lines(line_id, line)`` that share a run of words near one place.

    Where the run is in many lines, only those whose word parities are near as well.
    """
    few, crowded = _shared_runs(lines, word_run, broadcast_ids)
    return few.union(_met(crowded, _alike(word_run))).distinct()


def _parities() -> list[Column]:
    """``_PARITIES`` bits in longs: which hash values have an odd number of ``marks``. A word less or more changes one bit."""
    longs = _PARITIES // 64
    bit = "shiftleft(1L, CAST(m & 63 AS INT))"
    return [F.expr(f"aggregate(marks, 0L, (a, m) -> a ^ if((shiftright(m, 6) & {longs - 1}) = {k}, {bit}, 0L))") for k in range(longs)]


def _coded() -> Column:
    """``words`` as a text of two letters a word, the first and second ones from separate planes: 38 bits of its hash."""

    def code(w: Column, of: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(w), 19 * of).bitwiseAND(F.lit(0x7FFFF))
        return F.lpad(F.hex(bits + (0x10000 + of * 0x80000)), 8, "0")

    return F.decode(F.unhex(F.array_join(F.transform("words", lambda w: F.concat(code(w, 0), code(w, 1))), "")), "UTF-32")


def word_join(lines: DataFrame, word_run: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Verified pairs (high, low) of lines within the word edits of the shorter one."""
    return _near_words(lines, long_candidates(lines, word_run, broadcast_ids), word_run, broadcast_ids)


def word_links(lines: DataFrame, word_run: int, known: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Some pairs of ``word_join``: with the pairs ``known`` they lead to the same classes.

    In a crowded key each line meets a centre first, another one in each key
    and round. After that only lines of different classes meet, so a
    large group of near copies is not compared in pairs.
    """
    few, crowded = _shared_runs(lines, word_run, broadcast_ids)
    crowded = stage(crowded, "marked-keys", compression="zstd")
    if not crowded.limit(1).count():
        return _near_words(lines, few.distinct(), word_run, broadcast_ids)
    first = few.union(reduce(DataFrame.union, [_centred(crowded, _alike(word_run), salt) for salt in range(CENTRES)]))
    linked = stage(_near_words(lines, first.distinct(), word_run, broadcast_ids), "centred")
    roots = stage(components(known.select("high", "low").union(linked)), "groups")
    rows = crowded.join(roots.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    rows = stage(rows.join(_hinted(stage(mixed, "mixed"), broadcast_ids), "key", "left_semi"), "mixed-keys", compression="zstd")
    rest = _met(rows, _alike(word_run) & (F.col("root_x") != F.col("root_y"))).distinct()
    return linked.union(_near_words(lines, rest, word_run, broadcast_ids)).distinct()


def _near_words(lines: DataFrame, pairs: DataFrame, word_run: int, broadcast_ids: int) -> DataFrame:
    """Those of the candidates (high, low) that are within the word edits."""
    pairs = stage(pairs, "long-candidates")
    # an edit changes two parities at most, which ends most candidates before their texts are met
    marked = stage(_marked(_texts(lines, pairs, broadcast_ids)), "parities")
    one, two = (
        marked.select(F.col("line_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in marked.columns if x != "line_id"]) for c in ("high", "low")
    )
    both = pairs.join(one, "high").join(two, "low").withColumn("edits", word_edits(F.least("w_high", "w_low"), word_run))
    both = both.withColumn("apart", _apart("high", "low")).filter(F.col("apart") <= 2 * F.col("edits"))
    # a word is two letters, so each of its edits counts twice
    both = both.select("high", "low", (2 * F.col("edits")).alias("most"), F.least(2 * F.col("edits"), 2 * F.col("apart") + 4).alias("guess"))
    pairs = stage(both, "alike")
    texts = _texts(lines, pairs, broadcast_ids).select("line_id", _words().alias("words"))
    texts = stage(texts.select("line_id", _coded().alias("line")), "coded")
    one, two = (texts.select(F.col("line_id").alias(c), F.col("line").alias(x)) for c, x in (("high", "x"), ("low", "y")))
    # a narrow band is enough for most
    near = "levenshtein(x, y, guess) >= 0 OR (guess < most AND levenshtein(x, y, most) >= 0)"
    return pairs.join(one, "high").join(two, "low").filter(F.expr(near)).select("high", "low")


def _texts(lines: DataFrame, pairs: DataFrame, broadcast_ids: int) -> DataFrame:
    ids = pairs.select(F.col("high").alias("line_id")).union(pairs.select("low")).distinct()
    return lines.select("line_id", "line").join(_hinted(stage(ids, "ids"), broadcast_ids), "line_id")


def short_join(lines: DataFrame, short_chars: int, min_chars: int) -> DataFrame:
    """Verified pairs (high, low) of lines within one edit, the shorter of ``short_chars`` to under ``min_chars`` characters."""
    rows = lines.select("line_id", "line", F.char_length("line").alias("n")).filter(F.col("n").between(short_chars, min_chars))

    def without(i: Column) -> Column:
        return F.concat(F.left("line", i), F.substring("line", i + 2, F.col("n")))

    places = F.sequence(F.lit(0), F.col("n") - 1)
    gaps = rows.filter(F.col("n") < min_chars).select(
        "line_id", "line", F.explode(F.transform(places, lambda i: F.xxhash64(i, F.col("n"), without(i)))).alias("key")
    )
    cut = rows.select("line_id", "line", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(without(i))))).alias("key"))
    whole = rows.filter(F.col("n") < min_chars).select("line_id", "line", F.xxhash64("line").alias("key"))

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.select("key", F.col("line_id").alias(f"id_{end}"), F.col("line").alias(end))

    replaced = side(gaps, "x").join(side(gaps, "y"), "key").filter("id_x > id_y")
    removed = side(cut, "x").join(side(whole, "y"), "key")
    both = replaced.union(removed).filter(F.expr("id_x <> id_y AND levenshtein(x, y) <= 1"))
    # two lines of equal length meet in one place only, others in one cut only
    return both.select(F.greatest("id_x", "id_y").alias("high"), F.least("id_x", "id_y").alias("low"))


def edit_join(lines: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Verified pairs (high, low) of line numbers; ``lines(line_id, line)`` are distinct."""
    if "letters" not in lines.columns:
        lines = with_letters(lines)
    pairs = stage(candidates(lines, max_edits, min_chars), "candidates")
    texts = stage(_texts(lines, pairs, broadcast_ids), "texts")
    one = texts.select(F.col("line_id").alias("high"), F.col("line").alias("x"))
    two = texts.select(F.col("line_id").alias("low"), F.col("line").alias("y"))
    # the built-in distance ends most candidates at a fraction of the cost
    both = pairs.join(one, "high").join(two, "low").filter(F.expr(f"levenshtein(x, y, {max_edits}) >= 0"))
    return both.filter(within("x", "y", max_edits)).select("high", "low")


def line_classes(
    docs: DataFrame,
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_ids: int = BROADCAST_IDS,
    row_col: str | None = None,
    word_run: int | None = None,
    short_chars: int | None = None,
    placed: bool = False,
    counted: bool = True,
) -> DataFrame:
    """One row per distinct line.

    line_md5, chars, copies, doc_id (smallest with the line), links (other
    distinct lines within ``max_edits``, the word edits of ``word_run``,
    or one edit from ``short_chars`` characters on), class_id (smallest line_md5
    reachable over links) and class_doc_id (smallest doc_id of the class).
    ``placed``: also class_first, the first occurrence in the class as
    ``distinct_lines`` orders them. Without ``counted`` links of long lines
    are only as many as their classes need, at least one where there is any.
    """
    first = ["first"] if placed else []
    lines = distinct_lines(docs, id_col, text_col, row_col, placed, broadcast_ids).withColumn("line_id", F.monotonically_increasing_id())
    spark = docs.sparkSession
    lines = stage(with_letters(lines), "lines", compression="zstd")
    pairs = edit_join(lines, max_edits, min_chars, broadcast_ids)
    if short_chars:  # pairs whose shorter line is under ``min_chars`` are no others
        pairs = pairs.union(short_join(lines, short_chars, min_chars))
    if word_run:
        pairs = pairs if counted else stage(pairs, "near-chars")
        more = word_join(lines, word_run, broadcast_ids) if counted else word_links(lines, word_run, pairs, broadcast_ids)
        pairs = pairs.union(more).distinct()
    pairs = stage(pairs, "pairs")
    roots = stage(components(pairs), "roots")
    links = (
        pairs.select(F.col("high").alias("node")).union(pairs.select("low")).groupBy("node").agg(F.count("*").alias("links"))
    )
    rows = lines.select(
        "line_id", F.md5("line").alias("line_md5"), F.char_length("line").alias("chars"), "copies", "doc_id", *first
    )
    members = roots.join(links, "node").withColumnRenamed("node", "line_id")
    rows = rows.join(members, "line_id", "left")
    # only linked lines meet again: the others are classes of one
    alone = rows.filter("root IS NULL").select(
        "line_md5", "chars", "copies", "doc_id", F.lit(0).cast("long").alias("links"),
        F.col("line_md5").alias("class_id"), F.col("doc_id").alias("class_doc_id"),
        *[F.col(c).alias("class_first") for c in first],
    )
    linked = rows.filter("root IS NOT NULL")
    least = [F.min(c).alias("class_first") for c in first]
    classes = linked.groupBy("root").agg(F.min("line_md5").alias("class_id"), F.min("doc_id").alias("class_doc_id"), *least)
    names = ["line_md5", "chars", "copies", "doc_id", "links", "class_id", "class_doc_id", *(["class_first"] if placed else [])]
    return alone.union(linked.join(classes, "root").select(*names))


def _with_classes(occurrences: DataFrame, classes: DataFrame) -> DataFrame:
    """Occurrences with line_md5, class_id, class_doc_id and candidate: whether
    it is the class's first occurrence or, where rows are equal, one of them.

    A line that occurs once and has no links is a class of its own, and needs no partner.
    """
    met = classes.filter("copies > 1 OR links > 0").select("line_md5", "class_id", "class_doc_id", "class_first", F.lit(True).alias("met"))
    rows = occurrences.withColumn("line_md5", F.md5("line")).drop("line").join(met, "line_md5", "left")
    first = F.col("class_first")
    same = F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("h") == first["h"]) & (F.col("at") == first["at"])
    return rows.select(
        *[c for c in occurrences.columns if c != "line"],
        "line_md5",
        F.coalesce("class_id", "line_md5").alias("class_id"),
        F.when(F.col("met"), F.col("class_doc_id")).otherwise(F.col("doc_id")).alias("class_doc_id"),
        F.when(F.col("met"), same).otherwise(True).alias("candidate"),
        first.alias("class_first"),
    )


def line_members(
    docs: DataFrame,
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_ids: int = BROADCAST_IDS,
    **more,
) -> DataFrame:
    """One row per line of each row of ``docs``, without blank lines.

    doc_id, line (its place in the text, from 0), line_md5, class_id,
    class_doc_id, kept: whether ``remove_repeats`` leaves it. Rows of equal id
    each give their lines; of rows equal in id and text one keeps its lines.
    """
    row = "__line_row"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    classes = stage(line_classes(rows, max_edits, min_chars, "doc_id", "text", broadcast_ids, placed=True, counted=False, **more), "classes")
    columns = ["doc_id", F.col("at").alias("line"), "line_md5", "class_id", "class_doc_id"]

    hashed = rows.withColumn("__line_h", F.xxhash64("text"))
    equal = hashed.groupBy("doc_id", "__line_h").agg(F.count("*").alias("n")).filter("n > 1")
    equal = stage(equal.select(F.col("doc_id").alias("__line_id"), F.col("__line_h").alias("__line_hash")), "equal")
    known = _hinted(equal, broadcast_ids)
    same = hashed["doc_id"].eqNullSafe(known["__line_id"]) & (hashed["__line_h"] == known["__line_hash"])
    once = _occurrences(hashed.join(known, same, "left_anti"), "doc_id", "text", placed=True)
    found = _with_classes(once, classes).select(*columns, F.col("candidate").alias("kept"))
    if not equal.limit(1).count():
        return found
    # rows that are there more than once are told apart by numbers: the smallest one is first
    again = stage(hashed.join(known, same, "left_semi").withColumn(row, F.monotonically_increasing_id()), "repeated", compression="zstd")
    least = again.groupBy("doc_id", F.col("__line_h").alias("h")).agg(F.min(row).alias("least"))
    least = stage(least.select(F.col("doc_id").alias("__line_id"), F.col("h").alias("__line_hash"), "least"), "least")
    lines = _with_classes(_occurrences(again, "doc_id", "text", row, placed=True), classes)
    is_first = lines["doc_id"].eqNullSafe(least["__line_id"]) & (lines["h"] == least["__line_hash"]) & (lines["row"] == least["least"])
    firsts = lines.join(_hinted(least, broadcast_ids), is_first, "left")
    repeated = firsts.select(*columns, (F.col("candidate") & F.col("least").isNotNull()).alias("kept"))
    return found.unionByName(repeated)


def remove_repeats(
    docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", **more
) -> DataFrame:
    """``docs`` with each line class kept once: its first line in the document of smallest id.

    Rows of equal id are one document in the order of their texts' hashes.
    """
    row, helper = "__line_row", "__line_drops"
    whole = stage(docs.withColumn(row, F.monotonically_increasing_id()), "whole")
    classes = line_classes(whole, max_edits, min_chars, id_col, text_col, row_col=row, placed=True, counted=False, **more)
    lines = _with_classes(_occurrences(whole, id_col, text_col, row, placed=True), classes)
    first_row = F.coalesce(F.col("row") == F.col("class_first.row"), F.lit(True))
    drops = lines.filter(~(F.col("candidate") & first_row))
    drops = drops.groupBy(F.col("row").alias(row)).agg(F.collect_list("at").alias(helper))
    parts = F.split(text_of(text_col), "\n")
    left = F.array_join(F.filter(parts, lambda p, i: ~F.array_contains(F.col(helper), i)), "\n")
    cleaned = F.when(F.col(helper).isNull(), F.col(text_col)).otherwise(left)
    return whole.join(drops, row, "left").select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])
