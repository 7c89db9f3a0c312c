"""Duplicate blocks across the files of a repository.

Two files share a block when eight consecutive normalized lines agree in the
first three and in at least seven of eight places. A block is then extended
line by line past its end, and the best block per file pair is reported.

How the work is kept close to the size of the answer:

* Files whose normalized lines and line numbers are all equal form one
  *class*; only one member of a class is compared, and members come back at
  the very end.
* Any two classes that meet in a bucket below share eight lines up to one
  agreed gap, so every pair looked at is a pair of the result.
* Blocks inside a longer common run are redundant: only where a run starts,
  where it ends, and where a single mismatch interrupts it matters. Buckets
  in which no such event can happen are dropped by an aggregate of fixed
  size, before anything is joined.
* Big buckets are split: one side is dealt over salts, the other repeated.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions import paths, text as tx
from ..session import stage

WINDOW = rules.DUPLICATE_WINDOW
ANCHOR = rules.DUPLICATE_ANCHOR

# rows of one bucket (or class) that one task compares at a time
SALT_ROWS = 2000

START, END = -1, -2


def normalized_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, pos, line_no, text) of the lines that are compared."""
    return files.select(
        "repo_id", "path", F.posexplode(tx.normalized_lines(F.col("content"))).alias("pos", "l")
    ).select("repo_id", "path", "pos", F.col("l.line_no"), F.col("l.text"))


def line_facts(lines: Column) -> list:
    """Hashes and numbers of normalized lines, and a signature of the content."""
    return [
        F.transform(lines, lambda x: F.xxhash64(x["text"])).alias("hashes"),
        lines["line_no"].alias("numbers"),
        F.md5(
            F.concat(
                F.array_join(lines["text"], "\n"),
                F.lit("\n\n"),
                F.array_join(lines["line_no"].cast("array<string>"), ","),
            )
        ).alias("cls"),
        F.get(lines["line_no"], F.lit(0)).alias("first_line"),
        F.size(lines).alias("n_lines"),
    ]


def comparable_files(files: DataFrame) -> DataFrame:
    """Per file: hashes and numbers of its lines, and a content signature."""
    lines = tx.normalized_lines(F.col("content"))
    return (
        files.where(paths.quality_category(F.col("path")) != "generated")
        .select("repo_id", "path", tx.once(l=lines))
        .select("repo_id", "path", *line_facts(F.col("l")))
    )


def staged_files(files: DataFrame) -> DataFrame:
    """``comparable_files`` as a written table: a few bytes per line that the
    steps below read several times, so texts are normalized only once."""
    return stage(comparable_files(files), "comparable").where(F.col("n_lines") >= WINDOW)


def comparable_facts(facts: DataFrame) -> DataFrame:
    """The same from a written table of facts."""
    return facts.select("repo_id", "path", "hashes", "numbers", "cls", "first_line", "n_lines").where(
        F.col("n_lines") >= WINDOW
    )


def sliding_blocks(files: DataFrame) -> DataFrame:
    """(repo_id, path, pos, line_no, hashes) for every eight-line window."""
    return (
        comparable_files(files)
        .select("repo_id", "path", "numbers", "hashes", _positions())
        .select(
            "repo_id", "path", "pos",
            F.get("numbers", F.col("pos")).alias("line_no"),
            F.slice("hashes", F.col("pos") + 1, WINDOW).alias("hashes"),
        )
    )


def _positions() -> Column:
    last = F.size("hashes") - WINDOW
    return F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos")


def _line(offset: int) -> Column:
    """Hash of the line ``offset`` places after ``pos``; NULL outside."""
    at = F.col("pos") + offset
    return F.when(at >= 0, F.get("hashes", at))


def _events() -> Column:
    """The keyed rows a window (column ``block``) contributes.

    Start and end events share the whole window as key and differ in the
    neighbouring line (NULL at the edge of the file, which differs from
    anything). A mismatch event in place j has the other seven lines as key
    and differs in line j; for j below seven only windows that cannot be
    moved one line up matter, so the line before is part of the comparison.
    """
    block = F.col("block")
    whole = F.xxhash64(block)
    rows = [
        F.struct(F.lit(START).alias("kind"), whole.alias("key"), F.col("before").alias("other")),
        F.struct(F.lit(END).alias("kind"), whole.alias("key"), F.get("after", F.lit(0)).alias("other")),
    ]
    for j in range(ANCHOR, WINDOW):
        rest = F.xxhash64(F.slice(block, 1, j), F.slice(block, j + 2, WINDOW))
        rows.append(
            F.struct(F.lit(j).alias("kind"), rest.alias("key"), F.get(block, F.lit(j)).alias("other"))
        )
    return F.inline(F.array(*rows))


def _class_windows(comparable: DataFrame) -> DataFrame:
    """Windows of one member per class, with the lines around them."""
    one = comparable.groupBy("repo_id", "cls").agg(F.min("path").alias("path"))
    classes = comparable.join(one, ["repo_id", "cls", "path"], "left_semi")
    return classes.select("repo_id", "cls", "hashes", "numbers", _positions()).select(
        "repo_id", "cls", "pos",
        F.get("numbers", F.col("pos")).alias("line_no"),
        _line(-1).alias("before"),
        F.slice("hashes", F.col("pos") + 1, WINDOW).alias("block"),
        F.slice("hashes", F.col("pos") + WINDOW + 1, WINDOW).alias("after"),
        F.xxhash64(F.slice("hashes", F.col("pos") + 1, ANCHOR)).alias("anchor"),
    )


def _anchored_windows(comparable: DataFrame) -> DataFrame:
    """Windows whose first three lines also start a window of another class;
    no other can match, and in most corpora few are left.

    The shared anchors are written first: if they turn out small they are
    broadcast, and no window is shuffled to be dropped.
    """
    windows = _class_windows(comparable)
    cls = F.xxhash64("cls")  # a number keeps the aggregate hash-based
    shared = (
        windows.groupBy("repo_id", "anchor")
        .agg((F.min(cls) < F.max(cls)).alias("shared"))
        .where("shared").select("repo_id", "anchor")
    )
    return windows.join(stage(shared, "anchors"), ["repo_id", "anchor"], "left_semi")


def _class_events(windows: DataFrame) -> DataFrame:
    """Keyed rows of the windows."""
    rows = windows.select("repo_id", "cls", "pos", "line_no", "before", "after", _events())
    mismatch = F.col("kind") >= 0
    return rows.select(
        "repo_id", "cls", "pos", "line_no", "kind", "key", "other",
        F.when(mismatch & (F.col("kind") < WINDOW - 1), F.col("before")).alias("before"),
        F.when(mismatch, F.col("after")).alias("after"),
    )


def _eventful_buckets(events: DataFrame) -> DataFrame:
    """Buckets where two classes meet with different context.

    ``usual`` is the commonest context of the bucket, ``salts`` the number of
    shares a big bucket is dealt into.
    """
    bucket = ["repo_id", "kind", "key"]
    cls = F.xxhash64("cls")
    by_context = events.groupBy(*bucket, "other").agg(
        F.count("*").alias("n"), F.min(cls).alias("lo"), F.max(cls).alias("hi")
    )
    edge = F.col("other").isNull()
    return (
        by_context.groupBy(*bucket)
        .agg(
            F.sum("n").alias("n"),
            (F.min("lo") < F.max("hi")).alias("shared"),
            ((F.count("*") > 1) | F.bool_or(edge)).alias("varied"),
            F.max_by("other", F.when(~edge, F.col("n"))).alias("usual"),
        )
        .where("shared AND varied")
        .select(*bucket, "usual", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    )


def _sides(live: DataFrame):
    """The two sides of the bucket join, with the columns that pair them.

    Rows in their bucket's usual context cannot form an event with each
    other, so they only meet the rest: the left side asks for ``rest`` or for
    both parts, the right side offers the one part it is in. What is still
    compared in vain is at most as much as the events found, because no other
    context is commoner. A big bucket is dealt over salts: usual rows keep one
    place each, and the others, no more than those found, go to all.
    """
    usual = F.col("other").eqNullSafe(F.col("usual")) & F.col("other").isNotNull()
    own = F.pmod(F.xxhash64("cls", "pos"), F.col("salts")).cast("int")
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    pick = lambda part, salt: F.struct(F.lit(part).alias("part"), salt.alias("salt"))
    # usual rows are dealt on either side, the others are what is repeated
    to_all = lambda part: F.transform(every, lambda s: pick(part, s))
    left = live.select(
        "*",
        F.inline(F.when(usual, F.array(pick("rest", own))).otherwise(F.concat(F.array(pick("rest", own)), to_all("usual")))),
    )
    right = live.select("*", F.inline(F.when(usual, F.array(pick("usual", own))).otherwise(to_all("rest"))))
    return left.alias("x"), right.alias("y")


def _extension(a: Column, b: Column) -> Column:
    """How many leading entries of two arrays agree."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, True)
    return F.when(first == 0, F.size(differs)).otherwise(first - 1).cast("int")


def class_matches(comparable: DataFrame) -> DataFrame:
    """Best block per pair of differing classes, for both reading orders.

    ``best_xy`` breaks ties by position in x, then y; ``best_yx`` the other
    way round, as needed when the y file sorts first.
    """
    events = _class_events(stage(_anchored_windows(comparable), "windows"))
    # both written: the planner then sees how few buckets are left and can
    # broadcast them if they are small, instead of shuffling every event
    buckets = stage(_eventful_buckets(events), "buckets")
    live = stage(events.join(buckets, ["repo_id", "kind", "key"]), "events")
    x, y = _sides(live)
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("repo_id", "kind", "key", "salt", "part")]
    context_differs = (
        (F.col("x.other") != F.col("y.other"))
        | F.col("x.other").isNull()
        | F.col("y.other").isNull()
    )
    topmost = (
        ~F.col("x.kind").between(ANCHOR, WINDOW - 2)
        | F.col("x.before").isNull()
        | F.col("y.before").isNull()
        | (F.col("x.before") != F.col("y.before"))
    )
    met = x.join(
        y, on + [F.col("x.cls") < F.col("y.cls"), context_differs, topmost]
    ).select(
        F.col("x.repo_id").alias("repo_id"),
        F.col("x.cls").alias("x"), F.col("y.cls").alias("y"),
        F.col("x.pos").alias("px"),
        (F.col("y.pos") - F.col("x.pos")).alias("diagonal"),
        F.col("x.line_no").alias("line_x"), F.col("y.line_no").alias("line_y"),
        F.col("x.kind").alias("kind"),
        _extension(F.col("x.after"), F.col("y.after")).alias("extra"),
    )

    # A block that still matches where the carried lines stop runs to the
    # next run end on its diagonal; that end is the nearest one at or after
    # ``reach``.
    is_end, is_start = F.col("kind") == END, F.col("kind") == START
    reach = F.col("px") + F.when(is_end | is_start, 0).otherwise(WINDOW)
    placed = met.repartition("repo_id", "x", "y").withColumn("reach", reach)
    onward = (
        Window.partitionBy("repo_id", "x", "y", "diagonal")
        .orderBy(F.desc("reach"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run_end = F.min(F.when(is_end, F.col("px"))).over(onward)
    short = ~is_start & (F.col("extra") < WINDOW)
    sized = (
        placed.withColumn("run_end", run_end)
        .where(~is_end)
        .select(
            "repo_id", "x", "y",
            F.when(short, WINDOW + F.col("extra"))
            .otherwise(F.col("run_end") - F.col("px") + WINDOW)
            .alias("n"),
            F.when(is_start, WINDOW).otherwise(WINDOW - 1).alias("m"),
            "px", (F.col("px") + F.col("diagonal")).alias("py"),
            "line_x", "line_y",
        )
    )
    block = F.struct("n", "m", "line_x", "line_y")
    order_xy = F.struct("n", "m", -F.col("px"), -F.col("py"))
    order_yx = F.struct("n", "m", -F.col("py"), -F.col("px"))
    return sized.groupBy("repo_id", "x", "y").agg(
        F.max_by(block, order_xy).alias("best_xy"),
        F.max_by(block, order_yx).alias("best_yx"),
    )


def duplicate_pair_counts(files: DataFrame) -> DataFrame:
    """Number of duplicate file pairs per repository."""
    return pair_counts(staged_files(files))


def pair_counts(comparable: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Pairs of files are not listed: copies count by the size of their class,
    and two classes that share a block by the product of their sizes. Pairs of
    classes with differing contents are what the search finds."""
    sizes = comparable.groupBy("repo_id", "cls").agg(F.count("*").alias("n"))
    copies = sizes.select("repo_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"))
    sx = sizes.select("repo_id", F.col("cls").alias("x"), F.col("n").alias("nx"))
    sy = sizes.select("repo_id", F.col("cls").alias("y"), F.col("n").alias("ny"))
    across = (
        (class_matches(comparable) if matches is None else matches).select("repo_id", "x", "y")
        .join(sx, ["repo_id", "x"]).join(sy, ["repo_id", "y"])
        .select("repo_id", (F.col("nx") * F.col("ny")).alias("n"))
    )
    return (
        copies.unionByName(across)
        .groupBy("repo_id").agg(F.sum("n").alias("n_pairs"))
        .where("n_pairs > 0")
    )


def classes(comparable: DataFrame) -> DataFrame:
    """Per class of copies: number of members, the first two paths and the last one."""
    members = comparable.select("repo_id", "cls", "path", "first_line", "n_lines")
    counted = members.groupBy("repo_id", "cls").agg(
        F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"),
        F.first("first_line").alias("first_line"), F.first("n_lines").alias("n_lines"),
    )
    # a bare row_number <= 2 is cut before the shuffle
    by_path = Window.partitionBy("repo_id", "cls").orderBy("path")
    second = (
        members.withColumn("place", F.row_number().over(by_path)).where("place <= 2").where("place = 2")
        .select("repo_id", "cls", F.col("path").alias("second"))
    )
    return counted.join(second, ["repo_id", "cls"], "left")


def class_members(comparable: DataFrame) -> DataFrame:
    """(repo_id, class, file, n_files): every file of a class of copies or of a class
    of its own; a class is named by its first path."""
    named = comparable.groupBy("repo_id", "cls").agg(F.min("path").alias("class"), F.count("*").alias("n_files"))
    return (
        comparable.select("repo_id", "cls", F.col("path").alias("file"))
        .join(named, ["repo_id", "cls"]).select("repo_id", "class", "file", "n_files")
    )


def _across(path_x: str, path_y: str) -> list:
    """Columns of the block that a file of class x and one of class y share, in order of their paths."""
    x_first = F.col(path_x) < F.col(path_y)
    best = lambda field: F.when(x_first, F.col(f"best_xy.{field}")).otherwise(F.col(f"best_yx.{field}"))
    return [
        F.when(x_first, F.col(path_x)).otherwise(F.col(path_y)).alias("file"),
        F.when(x_first, F.col("best_xy.line_x")).otherwise(F.col("best_yx.line_y")).alias("line"),
        F.when(x_first, F.col(path_y)).otherwise(F.col(path_x)).alias("file_2"),
        F.when(x_first, F.col("best_xy.line_y")).otherwise(F.col("best_yx.line_x")).alias("line_2"),
        best("n").alias("duplicate_lines"),
        best("m").alias("matching"),
    ]


def class_blocks(comparable: DataFrame, matches: DataFrame | None = None, members: bool = False) -> DataFrame:
    """(repo_id, class, class_2, file, line, file_2, line_2, duplicate_lines,
    matching, n_pairs): one row per class with copies, its first two files,
    and one per pair of classes that share a block, the first file of each.

    ``n_pairs`` file pairs stand behind a row; ``class_members`` names their
    files. Two equally long blocks of a class pair may stand in another order
    for other members. ``matches`` are written ``class_matches``.

    With ``members`` every further copy has a row too, its class's first file
    and itself, so no file of a pair goes unnamed: such a row is one pair, that
    of the first two files stands for the others.
    """
    found = classes(comparable)
    copied = found.where("n > 1").withColumn("n_pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    if members:
        ends = copied.where("n > 2").select("repo_id", "cls", "first", F.col("second").alias("before"))
        further = (
            comparable.select("repo_id", "cls", F.col("path").alias("second"), "first_line", "n_lines")
            .join(ends, ["repo_id", "cls"]).where(F.col("second") > F.col("before"))
        )
        named = further.groupBy("repo_id", "cls").agg(F.count("*").alias("n_named"))
        copied = (
            copied.join(named, ["repo_id", "cls"], "left")
            .withColumn("n_pairs", F.col("n_pairs") - F.coalesce("n_named", F.lit(0)))
            .select("repo_id", "first", "second", "first_line", "n_lines", "n_pairs")
            .unionByName(further.withColumn("n_pairs", F.lit(1).cast("long")).drop("cls", "before"))
        )
    copies = copied.select(
        "repo_id", F.col("first").alias("class"), F.col("first").alias("class_2"),
        F.col("first").alias("file"), F.col("first_line").alias("line"),
        F.col("second").alias("file_2"), F.col("first_line").alias("line_2"),
        F.col("n_lines").alias("duplicate_lines"), F.lit(WINDOW).alias("matching"), "n_pairs",
    )
    side = lambda c: found.select("repo_id", F.col("cls").alias(c), F.col("first").alias(f"path_{c}"), F.col("n").alias(f"n_{c}"))
    matches = class_matches(comparable) if matches is None else matches
    across = matches.join(side("x"), ["repo_id", "x"]).join(side("y"), ["repo_id", "y"])
    across = across.select("repo_id", *_across("path_x", "path_y"), (F.col("n_x") * F.col("n_y")).alias("n_pairs"))
    return copies.unionByName(across.withColumns({"class": F.col("file"), "class_2": F.col("file_2")}))


def first_blocks(comparable: DataFrame, k: int, matches: DataFrame | None = None) -> DataFrame:
    """The file pairs of the first ``k`` files of each repository that come
    first in a pair: all that a list of the first ``k`` pairs can need. At
    most ``k`` rows for each file."""
    matches = stage(class_matches(comparable), "matches") if matches is None else matches  # read twice
    members = comparable.select("repo_id", "cls", "path", "first_line", "n_lines")
    last = classes(comparable).select("repo_id", "cls", "last")
    either = lambda a, b: matches.select("repo_id", F.col(a).alias("cls"), F.col(b).alias("other"), F.lit(a == "x").alias("is_x"), "best_xy", "best_yx")
    links = either("x", "y").unionByName(either("y", "x"))
    beyond = links.select("repo_id", "cls", "other").join(last.withColumnRenamed("cls", "other"), ["repo_id", "other"])
    reach = last.unionByName(beyond.select("repo_id", "cls", "last")).groupBy("repo_id", "cls").agg(F.max("last").alias("last"))
    ordered = Window.partitionBy("repo_id").orderBy("path")
    firsts = (
        members.join(reach, ["repo_id", "cls"]).where(F.col("path") < F.col("last"))
        .withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= k)
        .select("repo_id", "cls", "path", "first_line", "n_lines")
    )
    # written: the planner sees how few they are and shuffles no links to find theirs
    firsts = stage(firsts, "firsts")
    others = members.select("repo_id", F.col("cls").alias("other"), F.col("path").alias("path_2"))
    copies = firsts.withColumn("other", F.col("cls")).join(others, ["repo_id", "other"]).where("path < path_2").select(
        "repo_id", F.col("path").alias("file"), F.col("first_line").alias("line"),
        F.col("path_2").alias("file_2"), F.col("first_line").alias("line_2"),
        F.col("n_lines").alias("duplicate_lines"), F.lit(WINDOW).alias("matching"),
    )
    met = firsts.join(links, ["repo_id", "cls"]).join(others, ["repo_id", "other"]).where("path < path_2")
    pick = lambda at_x, at_y: F.when(F.col("is_x"), F.col(f"best_xy.{at_x}")).otherwise(F.col(f"best_yx.{at_y}"))
    across = met.select(
        "repo_id", F.col("path").alias("file"), pick("line_x", "line_y").alias("line"),
        F.col("path_2").alias("file_2"), pick("line_y", "line_x").alias("line_2"),
        pick("n", "n").alias("duplicate_lines"), pick("m", "m").alias("matching"),
    )
    return copies.unionByName(across)


def duplicate_blocks(files: DataFrame) -> DataFrame:
    """(repo_id, file, line, file_2, line_2, duplicate_lines, matching, class,
    class_2, n_pairs): the best block of every file pair that has one.

    Listing pairs is the result asked for; ``class_blocks`` sums it up in rows
    that grow with the files. Large classes of copies are dealt over salts;
    members join class pairs by ordinary joins that adaptive execution can
    split. A class is named by its first path; ``n_pairs`` is 1.
    """
    return blocks(staged_files(files))


def blocks(comparable: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    members = comparable.select("repo_id", "cls", "path", "first_line", "n_lines")
    sizes = members.groupBy("repo_id", "cls").agg(
        F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"),
        F.count("*").alias("n"),
        F.min("path").alias("class"),
    )

    # exact copies: the whole file is the block; a file that comes twice is a copy of itself
    again = Window.partitionBy("repo_id", "cls", "path").orderBy("path")
    copied = members.join(sizes.where("n > 1"), ["repo_id", "cls"]).withColumn("again", F.row_number().over(again))
    a = copied.withColumn("salt", F.pmod(F.xxhash64("path"), F.col("salts")).cast("int")).alias("a")
    b = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    copies = a.join(
        b,
        [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("repo_id", "cls", "salt")]
        + [(F.col("a.path") < F.col("b.path")) | ((F.col("a.path") == F.col("b.path")) & (F.col("a.again") < F.col("b.again")))],
    ).select(
        F.col("a.repo_id").alias("repo_id"),
        F.col("a.path").alias("file"), F.col("a.first_line").alias("line"),
        F.col("b.path").alias("file_2"), F.col("b.first_line").alias("line_2"),
        F.col("a.n_lines").alias("duplicate_lines"), F.lit(WINDOW).alias("matching"),
        F.col("a.class").alias("class"), F.col("a.class").alias("class_2"),
    )

    # differing classes: every member of x against every member of y
    names = sizes.select("repo_id", "cls", "class")
    side = lambda c: members.select("repo_id", F.col("cls").alias(c), F.col("path").alias(f"path_{c}"))
    name = lambda c: names.select("repo_id", F.col("cls").alias(c), F.col("class").alias(f"class_{c}"))
    met = class_matches(comparable) if matches is None else matches
    for c in ("x", "y"):  # the names first: there are fewer pairs of classes than of files
        met = met.join(name(c), ["repo_id", c])
    for c in ("x", "y"):
        met = met.join(side(c), ["repo_id", c])
    x_first = F.col("path_x") < F.col("path_y")
    across = met.select(
        "repo_id", *_across("path_x", "path_y"),
        F.when(x_first, F.col("class_x")).otherwise(F.col("class_y")).alias("class"),
        F.when(x_first, F.col("class_y")).otherwise(F.col("class_x")).alias("class_2"),
    )
    return copies.unionByName(across).withColumn("n_pairs", F.lit(1).cast("long"))


def block_findings(found: DataFrame) -> DataFrame:
    """Findings from rows of ``class_blocks`` or of file pairs."""
    share = F.col("matching") / WINDOW
    why, advice = rules.EXPLANATIONS["Duplicate Code"]
    return found.select(
        "repo_id",
        F.lit("quality").alias("domain"),
        F.lit("Duplicate Code").alias("type"),
        "file", "line", "file_2", "line_2",
        F.lit("LOW").alias("severity"),
        F.lit("LOW").alias("priority"),
        F.floor(share * 100).cast("int").alias("confidence"),
        "duplicate_lines",
        share.alias("similarity"),
        F.format_string(
            rules.DETAILS["duplicate"],
            F.col("duplicate_lines"), F.rint(share * 100).cast("int"),
        ).alias("details"),
        F.lit(why).alias("why"),
        F.lit(advice).alias("recommendation"),
        *([F.col("n_pairs").alias("occurrences")] if "n_pairs" in found.columns else []),
    )


def duplicate_findings(comparable: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """A finding for each class of copies and each pair of similar classes, counted by its file pairs."""
    return block_findings(class_blocks(comparable, matches))
