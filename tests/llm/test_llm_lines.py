import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusvitals.llm import line_dedup
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutated(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        i = rng.randrange(len(line))
        kind = rng.randrange(3)
        if kind == 0:
            line[i] = rng.choice("abé😀 ")
        elif kind == 1:
            del line[i]
        else:
            line.insert(i, rng.choice("abé😀"))
    return "".join(line).strip()


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randrange(4, 40)))
        pairs.append((a, mutated(rng, a, rng.randrange(6)) or "none"))
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) > 3]
    df = spark.createDataFrame(pairs, "x string, y string")
    for k in (0, 1, 2, 3):
        rows = df.select("x", "y", line_dedup.within("x", "y", k).alias("near")).collect()
        assert [(r.x, r.y) for r in rows if r.near != (distance(r.x, r.y) <= k)] == []
    assert any(distance(a, b) <= 2 for a, b in pairs)


def brute(lines, edits, min_chars):
    lines = sorted(lines)
    return {
        frozenset((a, b))
        for i, a in enumerate(lines)
        for b in lines[:i]
        if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    }


def test_join_finds_every_pair(spark):
    rng = random.Random(5)
    lines = set()
    for _ in range(40):
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(6, 60))).strip()
        lines |= {base, *(mutated(rng, base, rng.randrange(1, 4)) for _ in range(4))} if len(base) > 4 else set()
    lines = sorted(x for x in lines if x)
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    for edits, least in ((1, 5), (2, 5), (2, 20), (3, 8)):
        wanted = brute(lines, edits, max(least, edits + 1))
        for bound in (0, 10**6):  # by a shuffled join, and by a broadcast
            rows = line_dedup.edit_join(df, edits, least, bound).collect()
            assert {frozenset((lines[r.high], lines[r.low])) for r in rows} == wanted
            assert len(rows) == len(wanted)


def expected_classes(docs, edits=2, min_chars=20):
    copies, first = Counter(), {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r\f\v")
            if line:
                copies[line] += 1
                known = first.setdefault(line, doc)
                first[line] = doc if known is None else known if doc is None else min(known, doc)
    pairs = brute(copies, edits, min_chars)
    parent = {x: x for x in copies}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for pair in pairs:
        a, b = pair
        parent[root(a)] = root(b)
    homes = {}
    for line, doc in first.items():
        ids = homes.setdefault(root(line), [])
        if doc is not None:
            ids.append(doc)
    links = Counter(x for pair in pairs for x in pair)
    return sorted((len(x), copies[x], str(first[x]), links[x], str(min(homes[root(x)], default=None))) for x in copies)


def found_classes(df):
    rows = df.collect()
    by_class = {}
    for r in rows:
        by_class.setdefault(r.class_id, []).append(r.line_md5)
    assert all(min(md5) == name for name, md5 in by_class.items())
    return sorted((r.chars, r.copies, str(r.doc_id), r.links, str(r.class_doc_id)) for r in rows)


DOCS = [
    (1, "The first line of all the texts.\nshort\n\n  \nanother line that is never met again"),
    (2, "The first line of all the text.\nshort\nshorr"),
    (3, "THE first line of all the texts.\r\nshort"), (None, "Only where no one has a number, once"), (None, "Only where no one has a number, onc"),
    (4, None), (5, ""), (3, "another line that is never met agaim\n\ta third line that stays as it is"),
    (6, "y" * 3000 + "\n" + "y" * 3001 + "\n" + "y" * 3003), (1, "The first line of all the texts.\nshort"),
]


def test_line_classes(spark, nasty, empty):
    docs = spark.createDataFrame([(*r, "c") for r in DOCS], "doc_id long, text string, class_id string")
    plain = [(d, t if t is None or len(t) < 1000 else t) for d, t in DOCS]
    assert found_classes(line_dedup.line_classes(docs)) == expected_classes(plain)
    small = nasty.filter("doc_id IS NULL OR doc_id < 8")
    assert found_classes(line_dedup.line_classes(small)) == expected_classes([(r.doc_id, r.text) for r in small.collect()])
    assert len(line_dedup.line_classes(nasty.filter("doc_id > 7")).collect()) == 3
    assert line_dedup.line_classes(empty).collect() == []


def test_remove_repeats(spark):
    docs = spark.createDataFrame([(*r, "c") for r in DOCS[:-2]], "doc_id long, text string, class_id string")
    rows = line_dedup.remove_repeats(docs)
    assert rows.columns == docs.columns
    texts = {r.doc_id: r.text for r in rows.filter("doc_id IN (1, 2, 4, 5)").collect()}
    assert texts == {1: DOCS[0][1], 2: "shorr", 4: None, 5: ""}
    third = {r.text for r in rows.filter("doc_id = 3").collect()}
    assert third == {"", "\ta third line that stays as it is"}


def test_classes_of_documents(spark, documents):
    some = documents.orderBy(F.length("text"), "doc_id").limit(60)
    docs = [(r.doc_id, r.text) for r in some.collect()]
    assert found_classes(line_dedup.line_classes(some)) == expected_classes(docs)


def test_members_of_classes(spark, empty):
    texts = {1: "a line that is met in three texts\n\nonly here, and never again", 2: "none\na line that is met in three texts", 3: "a line that is met in three text"}
    rows = [*texts.items(), (3, texts[3]), (None, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.line_members(docs).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, []).append((r.doc_id, r.line, r.kept))
    wanted = [
        [(1, 0, True), (2, 1, False), (3, 0, False), (3, 0, False), (None, 1, False)],
        [(1, 2, True)], [(2, 0, True), (None, 0, False)],
    ]
    assert sorted(sorted(x, key=str) for x in classes.values()) == sorted(sorted(x, key=str) for x in wanted)
    assert line_dedup.line_members(empty).collect() == []


def test_members_agree_with_removal(spark, documents):
    some = documents.orderBy(F.length("text"), "doc_id").limit(60)
    kept = line_dedup.line_members(some).filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    left = {r.doc_id: sum(bool(x.strip(" \t\r\f\v")) for x in r.text.split("\n")) for r in line_dedup.remove_repeats(some).collect()}
    assert {r.doc_id: r.n for r in kept} == {d: n for d, n in left.items() if n}


def test_words_replaced_in_long_lines(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["字", "😀"]
    lines = set()
    for size in (30, 32, 33, 34, 49, 50, 51, 52, 70, 120):
        base = [rng.choice(vocabulary) for _ in range(size)]
        lines.add(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 6, 7):
            words = list(base)
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            lines.add(" ".join(words))
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    words = [x.split(" ") for x in lines]
    wanted = {
        (i, j) for i in range(len(lines)) for j in range(i)
        if (most := (min(len(words[i]), len(words[j])) - 16) // 17) > 0 and distance(words[i], words[j]) <= most
    }
    rows = line_dedup.word_join(df, 16).collect()
    assert len(wanted) > 20 and sorted((r.high, r.low) for r in rows) == sorted(wanted)
    far = {(i, j) for i, j in wanted if distance(lines[i], lines[j]) > 2}
    docs = spark.createDataFrame([(i, lines[i]) for i in sorted(far)[0]], "doc_id long, text string")
    assert len({r.class_id for r in line_dedup.line_classes(docs, word_run=16).collect()}) == 1


def test_short_lines_are_joined(spark):
    rng = random.Random(17)
    lines = {"Der, eingeä erer.", "Der eingeä erer.", "a", "b", "ab", "abc", "aab", "aaab", "aaa", "x" * 19, "x" * 20, "x" * 21, "😀😀é"}
    for size in (2, 3, 4, 5, 9, 18, 19, 20):
        base = "".join(rng.choice("abé") for _ in range(size))
        lines |= {base, *(mutated(rng, base, rng.randrange(1, 3)) for _ in range(5))}
    lines = sorted(x for x in lines if x)
    wanted = {p for p in brute(lines, 1, 3) if min(map(len, p)) < 20}
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    rows = line_dedup.short_join(df, 3, 20).collect()
    assert {frozenset((lines[r.high], lines[r.low])) for r in rows} == wanted and len(rows) == len(wanted)
    docs = spark.createDataFrame([(1, "Der, eingeä erer."), (2, "Der eingeä erer.")], "doc_id long, text string")
    found = line_dedup.line_classes(docs, short_chars=3).collect()
    assert [(r.links, r.class_doc_id) for r in found] == [(1, 1), (1, 1)]
    docs = spark.createDataFrame([(1, "Enüstach | ereraube."), (2, "Enüstach ereraube.")], "doc_id long, text string")
    found = line_dedup.line_classes(docs, min_chars=12, short_chars=3).collect()
    assert [(r.links, r.class_doc_id) for r in found] == [(1, 1), (1, 1)]


def registered_near(a, b):
    """The thresholds of the queries, judged by the shorter line."""
    short = min(len(a), len(b))
    if short < 3:
        return False
    if abs(len(a) - len(b)) <= 2 and distance(a, b) <= (2 if short >= 12 else 1):
        return True
    x, y = a.split(), b.split()
    most = (min(len(x), len(y)) - 16) // 17
    return most > 0 and abs(len(x) - len(y)) <= most and distance(x, y) <= most


def test_members_with_the_registered_thresholds(spark, nasty):
    from corpusvitals.llm.queries import _LINES

    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(50)]
    pool = []
    for size in (2, 3, 5, 11, 12, 13, 30):
        base = "".join(rng.choice("abcé") for _ in range(size))
        pool += [base, *(mutated(rng, base, rng.randrange(1, 4)) for _ in range(3))]
    for size in (33, 40, 52, 90):
        words = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 1, 2, 5):
            changed = list(words)
            for _ in range(edits):
                changed[rng.randrange(size)] = rng.choice(vocabulary)
            pool.append(" ".join(changed))
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 5)))) for i in range(40)]
    docs += [(7, docs[7][1]), (None, docs[3][1]), (None, None)]
    small = [(r.doc_id, r.text) for r in nasty.collect() if len(r.text or "") < 1000]
    for rows in (docs, small):
        places = [(i, d, at, line.strip(" \t\r\f\v")) for i, (d, text) in enumerate(rows) for at, line in enumerate((text or "").split("\n"))]
        places = [p for p in places if p[3]]
        lines = sorted({p[3] for p in places})
        parent = {x: x for x in lines}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(lines):
            for b in lines[:i]:
                if registered_near(a, b):
                    parent[root(a)] = root(b)
        wanted = Counter((d, at, hashlib.md5(line.encode()).hexdigest(), min(hashlib.md5(x.encode()).hexdigest() for x in lines if root(x) == root(line))) for _, d, at, line in places)
        table = spark.createDataFrame(rows, "doc_id long, text string")
        found = line_dedup.line_members(table, **_LINES).collect()
        assert Counter((r.doc_id, r.line, r.line_md5, r.class_id) for r in found) == wanted
        kept = Counter(r.class_id for r in found if r.kept)
        assert set(kept.values()) <= {1} and set(kept) == {k[3] for k in wanted}
        for r in found:
            if r.kept:  # in the document of smallest id
                ids = [k[0] for k in wanted if k[3] == r.class_id and k[0] is not None]
                assert r.doc_id == min(ids, default=None)


def test_few_words_of_a_long_line_are_chosen(spark):
    """One of each twelve words in a row, the same in any line that has them."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    lines = [" ".join(words), " ".join(["other"] * 7 + words[100:140] + ["x"] * 9)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    keyed = df.select("line_id", line_dedup._words().alias("words")).withColumn("w", F.size("words"))
    rows = keyed.select("line_id", F.explode(line_dedup._run_keys(16)).alias("k")).select("line_id", "k.*").collect()
    places = sorted(r.at for r in rows if r.line_id == 0)
    assert 60 < len(places) < 150 and max(b - a for a, b in zip(places, places[1:])) <= 12
    shared = {r.key for r in rows if r.line_id == 0} & {r.key for r in rows if r.line_id == 1}
    assert len(shared) >= 2


def test_a_passage_in_many_lines_makes_few_candidates(spark):
    rng = random.Random(1)
    passage = " ".join(f"b{i}" for i in range(20))
    some = lambda: " ".join(f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 150)))
    lines = [f"{some()} {passage} {some()}" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    found = line_dedup.long_candidates(df, 16).collect()
    assert len(found) < 20 * len(lines)
    near = lines[7].split()
    near[3] = near[-4] = "other"  # a line with enough words still meets its near copy
    both = spark.createDataFrame([*enumerate(lines), (len(lines), " ".join(near))], "line_id long, line string")
    most = (len(near) - 16) // 17
    pairs = {(r.high, r.low) for r in line_dedup.word_join(both, 16).collect()}
    assert pairs == ({(len(lines), 7)} if most >= 2 else set())


def test_probes_are_compiled(spark):
    lines = line_dedup.with_letters(spark.createDataFrame([(0, "x" * 30)], "line_id long, line string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code before it runs
    try:
        plan = line_dedup.candidates(lines, 2, 12)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    code = spark._jvm.org.apache.spark.sql.execution.debug
    found = getattr(getattr(code, "package$"), "MODULE$").codegenStringSeq(plan)
    sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    # the JVM compiles no method of more bytes
    assert sizes and max(sizes) <= 8000


def test_lines_that_share_a_passage_only_end_before_their_texts_meet(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"x{rng.randrange(10**9)}"
    lines, wanted = [], set()
    for many in (2, 3, line_dedup.CROWDED + 5):  # passages in few lines and in many
        passage = [word() for _ in range(20)]
        base = len(lines)
        lines += [[word() for _ in range(20)] + passage + [word() for _ in range(20)] for _ in range(many)]
        near = list(lines[base])
        near[1], near[-2] = word(), word()  # of 60 words two may differ
        wanted.add((len(lines), base))
        lines.append(near)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "line_id long, line string")
    staged, stage = {}, line_dedup.stage

    def counted(table, label, **options):
        written = stage(table, label, **options)
        staged[label] = written.count()
        return written

    monkeypatch.setattr(line_dedup, "stage", counted)
    for bound in (0, 10**6):  # by a shuffled join, and by a broadcast
        assert {(r.high, r.low) for r in line_dedup.word_join(df, 16, bound).collect()} == wanted
        assert staged["long-candidates"] > 100 and staged["alike"] == len(wanted)


def staged_rows(monkeypatch):
    """Counts of the written tables by label, added up."""
    staged, stage = Counter(), line_dedup.stage

    def counted(table, label, **options):
        written = stage(table, label, **options)
        staged[label] += written.count()
        return written

    monkeypatch.setattr(line_dedup, "stage", counted)
    return staged


def test_words_that_repeat_give_one_key(spark, monkeypatch):
    """Lines of the same words over and over share one key, not one for each pair of places."""
    rng = random.Random(4)
    word = lambda: f"x{rng.randrange(10**9)}"
    lines = [[word() for _ in range(5)] + ["Is", "onhe."] * 60 + [word() for _ in range(7)] for _ in range(6)]
    near = list(lines[2])
    near[1:1] = [word(), word()]  # all places move on
    lines.append(near)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "line_id long, line string")
    staged = staged_rows(monkeypatch)
    assert {(r.high, r.low) for r in line_dedup.word_join(df, 16).collect()} == {(6, 2)}
    assert staged["run-keys"] <= 10 * len(lines)
    keys = line_dedup.long_keys(df, 16).collect()
    assert len({(r.line_id, r.key) for r in keys}) == len(keys) and max(r.to - r.at for r in keys) > 90


def test_near_copies_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"x{rng.randrange(10**9)}"
    lines, wanted = [], []
    for size, copies in ((70, 200), (90, 20)):
        base, first = [word() for _ in range(size)], len(lines)
        for _ in range(copies):
            line = list(base)
            line[rng.randrange(size)] = word()
            lines.append(line)
            wanted.append(first)
    chain = [lines[0]]  # each is near to the one before only
    for i in range(10):
        line = list(chain[-1])
        line[3 * i : 3 * i + 3] = [word(), word(), word()]
        chain.append(line)
    lines += chain[1:]
    wanted += [0] * 10
    lines.append(lines[5][:40] + [word() for _ in range(30)])  # shares a run only
    wanted.append(len(wanted))
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "line_id long, line string")
    staged = staged_rows(monkeypatch)
    none = spark.createDataFrame([], "high long, low long")
    root = list(range(len(lines)))
    for r in line_dedup.word_links(df, 16, none).collect():
        one, two = sorted((root[r.high], root[r.low]))
        root = [one if x == two else x for x in root]
    assert root == wanted
    assert staged["long-candidates"] < 10_000  # there are 20,000 pairs
