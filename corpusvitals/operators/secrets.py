"""Hard-coded secret scan.

The texts with assignments are cut at them, once per pattern that matches;
from there on only small rows travel. Line numbers and the interactive-input rule come from running
aggregates per (file, type), so a file with very many matches stays linear.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions import paths, text as tx

_VALUE = r"""\s*[:=]\s*["']([^"']+)["']"""


def _pattern(keywords: str, initials: str) -> str:
    # the first sign is asked for first: whether a border of a word is there costs much more
    return rf"(?=[{initials}])(?iU)\b({keywords})\b{_VALUE}"


PATTERNS = {name: _pattern(words, rules.SECRET_INITIALS[name]) for name, words in rules.SECRET_KEYWORDS.items()}
ANY_SECRET = _pattern("|".join(rules.SECRET_KEYWORDS.values()), "".join(rules.SECRET_INITIALS.values()))


def with_own_patterns(files: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Add ``secret_patterns``: NULL for repositories that go by the rules, else their patterns.

    ``overrides`` (repo_id, type, keywords) replaces the keywords of a type,
    or adds a type; NULL keywords switch it off. A repository has a few. The
    table meets the files by repository, as a broadcast wherever its size
    allows.
    """
    kind = "array<struct<label: string, pattern: string>>"
    if overrides is None:
        return files.withColumn("secret_patterns", F.lit(None).cast(kind))
    own = overrides.groupBy("repo_id").agg(F.collect_set(F.struct("type", "keywords")).alias("own"))
    named = F.transform("own", lambda o: o["type"])
    kept = F.filter(tx.specs_of(PATTERNS), lambda s: ~F.array_contains(named, s["label"]))
    replaced = F.transform(
        F.filter("own", lambda o: o["keywords"].isNotNull()),
        lambda o: F.struct(
            o["type"].alias("label"),
            F.concat(F.lit(r"(?iU)\b("), o["keywords"], F.lit(rf")\b{_VALUE}")).alias("pattern"),
        ),
    )
    resolved = own.select("repo_id", F.concat(kept, replaced).cast(kind).alias("secret_patterns"))
    return files.join(resolved, "repo_id", "left")


def is_placeholder(value: Column) -> Column:
    trimmed = tx.strip(F.lower(value))
    prefixes = "|".join(rules.PLACEHOLDER_PREFIXES)
    shaped = trimmed.rlike(rf"^(?:(?:{prefixes})[-_][^\n]*|x{{4,}}|0{{4,}})\z")
    return trimmed.isin(rules.PLACEHOLDER_WORDS) | shaped


def confidence(secret_type: Column, value: Column) -> Column:
    size = F.length(value)

    def bonus(condition, points):
        return F.when(condition, points).otherwise(0)

    score = (
        F.lit(50)
        + bonus(size >= 16, 15)
        + bonus(size >= 32, 10)
        + bonus(value.rlike("[A-Z]"), 5)
        + bonus(value.rlike("[a-z]"), 5)
        + bonus(value.rlike(r"(?U)\d"), 10)
        + bonus(value.rlike("[^A-Za-z0-9]"), 5)
        + bonus(secret_type.isin(rules.STRUCTURED_SECRET_TYPES), 5)
    )
    return (
        F.when(is_placeholder(value), 15)
        .when(size < 8, 20)
        .otherwise(F.least(score, F.lit(100)))
        .cast("int")
    )


def severity(confidence_: Column, category: Column) -> Column:
    in_test = F.when(confidence_ >= 80, "MEDIUM").otherwise("LOW")
    elsewhere = (
        F.when(confidence_ >= 80, "HIGH").when(confidence_ >= 50, "MEDIUM").otherwise("LOW")
    )
    return F.when(category == "test", in_test).otherwise(elsewhere)


def _asks_user(fragment: Column) -> Column:
    found = F.lit(False)
    for call in rules.INPUT_CALLS:
        found = found | fragment.contains(call)
    return found


def secret_pieces(content: Column, own: Column | None = None, lowered: Column | None = None) -> Column:
    """What the rules need of a text's assignments and of the gaps between
    them, as an array of small structs; NULL without any assignment. ``own``
    are patterns that replace the rules' where it is not NULL."""
    looked = tx.mentions(content, rules.SECRET_STEMS, lowered)
    where = {kind: tx.mentions(content, stems, lowered) for kind, stems in rules.SECRET_STEMS_BY_TYPE.items()}
    found = F.when(looked & content.rlike(ANY_SECRET), _piece_facts(PATTERNS, content, where))
    if own is None:
        return found
    return F.when(own.isNull(), found).otherwise(_piece_facts(own, content))


def _piece_facts(specs, content: Column, where: dict = {}) -> Column:
    head = lambda c: F.lower(F.substring_index(c, "\n", 1))
    tail = lambda c: F.lower(F.substring_index(c, "\n", -1))
    hit_of = lambda p: F.coalesce(p["hit"], F.lit(""))
    return F.transform(
        tx.pieces(specs, content, where),
        lambda p: F.struct(
            p["label"].alias("label"),
            p["i"].alias("i"),
            F.regexp_extract(p["hit"], r"""(?s)^[^"']*["'](.*)["']\z""", 1).alias("value"),
            p["hit"].isNotNull().alias("is_hit"),
            tx.newlines(p["gap"]).alias("gap_nl"),
            tx.newlines(hit_of(p)).alias("hit_nl"),
            _asks_user(F.lower(hit_of(p))).alias("hit_asks"),
            _asks_user(tail(p["gap"])).alias("gap_tail"),
            _asks_user(head(p["gap"])).alias("gap_head"),
            _asks_user(tail(hit_of(p))).alias("hit_tail"),
            _asks_user(head(hit_of(p))).alias("hit_head"),
        ),
    )


def secret_matches(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Every raw assignment with ``line``, ``value`` and ``suppressed``."""
    looked = files.where(paths.security_category(F.col("path")) != "generated")
    own = None
    if overrides is not None:
        looked, own = with_own_patterns(looked, overrides), F.col("secret_patterns")
    return located_secrets(looked.select("repo_id", "path", tx.once(secrets=secret_pieces(F.col("content"), own))))


def located_secrets(facts: DataFrame) -> DataFrame:
    """``secret_matches`` from ``secrets`` columns.

    A match is suppressed when the lines it touches also call for user input.
    The calls never straddle the border of a gap and a match, so it is enough
    to know, on either side of a match, whether such a call is nearer than
    the closest newline. Even positions below stand for gaps, odd ones for
    matches.
    """
    keys = ["repo_id", "path"]
    at_gap, at_hit = F.col("i") * 2, F.col("i") * 2 + 1
    facts = (
        facts.select(*keys, F.inline("secrets"))
        .withColumn("file_category", paths.security_category(F.col("path")))
        .withColumns({
            "gap_tail": F.when(F.col("gap_tail"), at_gap),
            "gap_head": F.when(F.col("gap_head"), at_gap),
            "hit_tail": F.when(F.col("hit_tail"), at_hit),
            "hit_head": F.when(F.col("hit_head"), at_hit),
            "gap_break": F.when(F.col("gap_nl") > 0, at_gap),
            "hit_break": F.when(F.col("hit_nl") > 0, at_hit),
        })
    )

    forward = Window.partitionBy(*keys, "label").orderBy("i")
    here = forward.rowsBetween(Window.unboundedPreceding, 0)
    earlier = forward.rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*keys, "label").orderBy(F.desc("i"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def left(gap_col, hit_col):
        return F.greatest(F.max(gap_col).over(here), F.max(hit_col).over(earlier))

    def right(gap_col, hit_col):
        return F.least(F.min(gap_col).over(later), F.min(hit_col).over(later))

    lined = tx.with_start_line(facts, keys).withColumns({
        "ask_left": left("gap_tail", "hit_tail"),
        "break_left": left("gap_break", "hit_break"),
        "ask_right": right("gap_head", "hit_head"),
        "break_right": right("gap_break", "hit_break"),
    })
    asked_left = F.coalesce(
        F.col("ask_left") >= F.coalesce("break_left", F.lit(-1)), F.lit(False)
    )
    asked_right = F.coalesce(
        F.col("ask_right") <= F.coalesce("break_right", F.col("ask_right")), F.lit(False)
    )
    return lined.where("is_hit").select(
        "repo_id",
        F.col("path").alias("file"),
        F.col("label").alias("type"),
        "line",
        "value",
        "file_category",
        (F.col("hit_asks") | asked_left | asked_right).alias("suppressed"),
    )


def secret_findings(files: DataFrame, overrides: DataFrame | None = None, placeholders: DataFrame | None = None) -> DataFrame:
    """Reported secrets, before deduplication."""
    return judged_secrets(secret_matches(files, overrides), placeholders)


def judged_secrets(matches: DataFrame, placeholders: DataFrame | None = None) -> DataFrame:
    """``placeholders`` (repo_id, word): values, in lower case, that are none in these repositories besides the rules'."""
    if placeholders is not None:
        words = placeholders.select("repo_id", F.lower("word").alias("word")).distinct()
        trimmed = matches.withColumn("word", tx.strip(F.lower("value")))
        matches = trimmed.join(words, ["repo_id", "word"], "left_anti").drop("word")
    kept = (
        matches
        .where(~F.col("suppressed") & ~is_placeholder(F.col("value")))
        .withColumn("confidence", confidence(F.col("type"), F.col("value")))
        .where((F.col("file_category") != "test") | (F.col("confidence") >= 50))
        .drop("value", "suppressed")
        .withColumn("severity", severity(F.col("confidence"), F.col("file_category")))
    )
    topic = F.when(F.col("file_category") == "test", "secret/test").otherwise("secret")
    why = {k: v[0] for k, v in rules.EXPLANATIONS.items()}
    advice = {k: v[1] for k, v in rules.EXPLANATIONS.items()}
    return kept.withColumns({
        "domain": F.lit("security"),
        "priority": F.col("severity"),
        "details": F.format_string(
            rules.DETAILS["secret"], F.lower("type"), "confidence"
        ),
        "why": paths.lookup(why, topic),
        "recommendation": paths.lookup(advice, topic),
    })


def dedup_secret_findings(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["repo_id", "type", "file", "line", "confidence"])


def scan_secrets(files: DataFrame, overrides: DataFrame | None = None, placeholders: DataFrame | None = None) -> DataFrame:
    """Deduplicated secret findings; the windows' partitioning is reused."""
    return dedup_secret_findings(secret_findings(files, overrides, placeholders))
