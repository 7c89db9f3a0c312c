"""Column functions over file text, and the piece-to-line helper."""

from pyspark.sql import Column, DataFrame, Window, functions as F

NEWLINE = "\n"
# every boundary str.splitlines() knows
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
# whitespace that does not end a line
_INLINE = r"\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
LINE_BREAK = rf"\r\n|[{_BREAKS}]"
NOT_BREAK = rf"[^{_BREAKS}]"
INLINE_SPACE = rf"[{_INLINE}]"
ANY_SPACE = rf"[{_BREAKS}{_INLINE}]"
# anything but space and newline that separates words or lines
UNCOMMON_SPACE = r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
REPLACEMENT = chr(0xFFFD)
_OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# the signs of UNCOMMON_SPACE
_UNCOMMON = "\t\x1f\xa0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))) + _OTHER_BREAKS
# the same signs for one quick look: a table for the first 256, one range before the others are told apart
_UNCOMMON_FAST = r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
# the signs of ANY_SPACE
_SPACES = [" ", "\n", *_UNCOMMON]


def decode_utf8(content: Column) -> Column:
    """Lossy decode: invalid bytes vanish, line ends become ``\\n``."""
    raw = content.cast("string")
    cleaned = F.replace(F.make_valid_utf8(raw), F.lit(REPLACEMENT), F.lit(""))
    return unify_newlines(F.when(F.is_valid_utf8(raw), raw).otherwise(cleaned))


def unify_newlines(text: Column) -> Column:
    return F.when(
        text.contains("\r"), F.regexp_replace(text, "\r\n?", NEWLINE)
    ).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{ANY_SPACE}+|{ANY_SPACE}+\\z", "")


def trimmed(text: Column) -> Column:
    """``strip`` for short texts that seldom need it: their ends are looked at first."""
    at_end = F.substring(text, 1, 1).isin(_SPACES) | F.substring(text, -1, 1).isin(_SPACES)
    return F.when(at_end, strip(text)).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines between breaks of any kind."""
    return F.when(holds(text, _OTHER_BREAKS), F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, NEWLINE, -1))


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(NEWLINE), F.lit("")))


def read_line_count(text: Column) -> Column:
    """Lines as file iteration yields them (``\\n`` only)."""
    open_tail = (text != "") & ~text.endswith(NEWLINE)
    return newlines(text) + F.when(open_tail, 1).otherwise(0)


def plain_lines(text: Column) -> Column:
    """The text cut at each ``\\n``."""
    return F.split(text, NEWLINE, -1)


def read_line_count_of(plain: Column) -> Column:
    """``read_line_count`` from ``plain_lines``: what follows the last ``\\n`` is a line unless it is empty."""
    return F.size(plain) - F.when(F.element_at(plain, -1) == "", 1).otherwise(0)


def holds(text: Column, signs: str) -> Column:
    """Whether any of these signs stands in the text: a look for bytes, which
    costs a fraction of a pattern's. Signs beyond ASCII are looked for only in texts that have some."""
    found, beyond = F.lit(False), F.lit(False)
    for sign in signs:
        if sign.isascii():
            found = found | text.contains(sign)
        else:
            beyond = beyond | text.contains(sign)
    return found | ((F.octet_length(text) > F.length(text)) & beyond)


def uncommon(text: Column) -> Column:
    """Whether ``UNCOMMON_SPACE`` stands in the text, in one look."""
    return text.rlike(_UNCOMMON_FAST)


def split_line_count(text: Column, read_lines: Column | None = None, odd: Column | None = None) -> Column:
    """Lines as ``splitlines`` yields them. ``read_lines`` and ``odd`` are
    ``read_line_count`` and ``uncommon``, where columns have them."""
    read_lines = read_line_count(text) if read_lines is None else read_lines
    odd = uncommon(text) if odd is None else odd
    return F.when(odd & holds(text, _OTHER_BREAKS), _any_line_count(text)).otherwise(read_lines)


def _any_line_count(text: Column) -> Column:
    closed = (text == "") | text.rlike(f"(?:{LINE_BREAK})\\z")
    return F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(closed, 0).otherwise(1)


def normalized_lines(text: Column, plain: Column | None = None, odd: Column | None = None) -> Column:
    """``array<struct<line_no, text>>`` of non-blank lines without comments.

    Comments go from ``//`` or ``#`` to the end of the line whatever the
    language. Patterns run over the whole text, and only over texts with
    uncommon space; other lines are cut and trimmed one by one, and repeated
    spaces looked for in what is left. ``plain`` and ``odd`` are
    ``plain_lines`` and ``uncommon``, where columns have them.
    """
    simple = plain_lines(text) if plain is None else plain
    bare = lambda line: F.substring_index(F.substring_index(line, "//", 1), "#", 1)
    single = lambda line: F.when(line.contains("  "), F.regexp_replace(line, " {2,}", " ")).otherwise(line)
    general = F.regexp_replace(text, f"(?://|#){NOT_BREAK}*", "")
    lines = F.when(
        uncommon(text) if odd is None else odd,
        F.split(F.regexp_replace(general, f"{INLINE_SPACE}+", " "), LINE_BREAK, -1),
    ).otherwise(simple)
    numbered = F.transform(
        lines,
        # of lines of the first kind, the comments are gone: nothing more is cut
        lambda line, i: F.struct((i + 1).alias("line_no"), F.trim(bare(line)).alias("text")),
    )
    kept = F.filter(numbered, lambda x: x["text"] != "")
    return F.transform(kept, lambda x: F.struct(x["line_no"].alias("line_no"), single(x["text"]).alias("text")))


def once(**columns: Column) -> Column:
    """Generator that yields these columns once.

    A filter on a computed column is copied below the projection computing
    it, so costly expressions would run twice; behind a generator they do not.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def mentions(text: Column, stems: list, lowered: Column | None = None) -> Column:
    """Whether any of these lower-case stems stands in the text: one look that
    spares the texts without them every pattern. ``lowered`` is the text in
    lower case, where a column has it."""
    lowered = F.lower(text) if lowered is None else lowered
    found = F.lit(False)
    for stem in stems:
        found = found | lowered.contains(stem)
    return found


def specs_of(patterns: dict) -> Column:
    """Patterns as ``array<struct<label, pattern>>``."""
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("pattern")) for label, p in patterns.items()])


def pieces(specs, content: Column, where: dict = {}) -> Column:
    """Cut a text at its matches: ``array<struct<label, i, gap, hit>>``, the
    gap before match i and the match itself (NULL after the last one).

    ``specs`` are patterns by label, or a column such as ``specs_of`` gives.
    ``where`` says by label which texts can match at all.
    One extraction and one split per pattern that matches; callers reduce
    gaps to counts and flags in the same row, so no text travels.
    """
    if isinstance(specs, dict):
        extracted = F.array(
            *[
                F.struct(
                    F.lit(label).alias("label"),
                    _where(where.get(label), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))).alias("hits"),
                    F.lit(pattern).alias("pattern"),
                )
                for label, pattern in specs.items()
            ]
        )
    else:
        extracted = F.transform(
            specs,
            lambda s: F.struct(
                s["label"].alias("label"),
                F.regexp_extract_all(content, s["pattern"], F.lit(0)).alias("hits"),
                s["pattern"].alias("pattern"),
            ),
        )
    found = F.filter(extracted, lambda s: F.size(s["hits"]) > 0)

    def cut(s: Column) -> Column:
        pairs = F.zip_with(
            F.split(content, s["pattern"], -1), s["hits"],
            lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
        )
        return F.transform(
            pairs,
            lambda p, i: F.struct(
                s["label"].alias("label"), i.alias("i"), p["gap"].alias("gap"), p["hit"].alias("hit")
            ),
        )

    return F.flatten(F.transform(found, cut))


def _where(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def with_start_line(rows: DataFrame, keys: list) -> DataFrame:
    """Add ``line`` (1-based, of the match start) from ``gap_nl``/``hit_nl``."""
    running = Window.partitionBy(*keys, "label").orderBy("i")
    total = F.sum(F.col("gap_nl") + F.col("hit_nl")).over(running)
    return rows.withColumn("line", (total - F.col("hit_nl") + 1).cast("int"))
