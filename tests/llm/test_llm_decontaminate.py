import hashlib
import re

from corpusvitals.llm import decontaminate


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    grams = set()
    for item, text in items:
        w = words(text)
        grams |= {(item, tuple(w[i : i + 13])) for i in range(len(w) - 12)} if len(w) >= 13 else {(item, tuple(w))} if w else set()
    found = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item, gram in grams:
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    names.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((doc, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(found, key=str)


def got(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


LONG = " ".join(f"word{i}" for i in range(30))
ITEMS = [(1, LONG), (2, LONG + " tail"), (3, "Short item, here"), (4, None), (5, "..."), (6, "été"), (10, "a b c d e f"), (None, "no number no name")]
DOCS = [
    (1, "x " * 20 + "WORD3-word4 " + " ".join(f"word{i}" for i in range(5, 20)) + " z"), (2, LONG), (3, None), (4, ""), (5, "short item HERE"),
    (6, "l'Été été"), (6, "l'Été été"), (7, "pad " * 700 + LONG + " end."), (8, " ".join(f"word{i}" for i in range(12))),
    (9, "a b c d e f a b c d e f g"), (None, "short item here"), (11, "no number no name"), (12, "quiet " * 4000),
]


def test_contamination(spark, nasty):
    items = spark.createDataFrame([(*r, "g") for r in ITEMS], "item_id long, text string, gram string")
    docs = spark.createDataFrame([(*r, "h", "w") for r in DOCS], "doc_id long, text string, hits string, w string")
    listed = [r for r in ITEMS if r[0] is not None]
    wanted = brute(DOCS, listed)
    clean = items.filter("item_id IS NOT NULL")
    assert got(decontaminate.contamination(docs, clean)) == wanted
    assert got(decontaminate.contamination(docs, clean, set_windows=3)) == wanted
    assert len(got(decontaminate.contamination(docs, items))) == len(DOCS)
    assert got(decontaminate.contamination(nasty, clean)) == brute([(r.doc_id, r.text) for r in nasty.collect()], listed)


def test_empty_tables(spark, nasty, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty, items).collect() == []
    for bound in (0, 100):
        rows = decontaminate.contamination(nasty, items.limit(0), set_windows=bound).collect()
        assert len(rows) == nasty.count() and not any(r.contaminated or r.n_hit for r in rows)
    assert decontaminate.decontaminate(nasty, items.limit(0)).count() == nasty.count()


def test_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = brute(docs, [(r.item_id, r.text) for r in items.collect()])
    found = got(decontaminate.contamination(documents, items))
    assert found == wanted
    kept = decontaminate.decontaminate(documents, items)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in wanted if not r[5])


def test_decontaminate_beyond_the_bound(spark):
    items = spark.createDataFrame(ITEMS[:-1], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "h") for r in DOCS], "doc_id long, text string, hits string")
    one = sorted(map(str, decontaminate.decontaminate(docs, items).collect()))
    assert sorted(map(str, decontaminate.decontaminate(docs, items, set_windows=1).collect())) == one
    assert len(one) == sum(not r[5] for r in brute(DOCS, ITEMS[:-1]))


def test_remove_spans(spark):
    items = spark.createDataFrame(ITEMS[:-1], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "h") for r in DOCS], "doc_id long, text string, hits string")
    rows = decontaminate.remove_spans(docs, items)
    assert rows.columns == docs.columns
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert texts[1] == "x " * 19 + "x z" and texts[7] == "pad " * 699 + "pad end."
    assert (texts[2], texts[3], texts[4], texts[6]) == ("", None, "", "l'Été")
    assert texts[9] == " g" and texts[8] == DOCS[8][1]


def test_remove_spans_beyond_the_bound(spark, nasty, documents):
    items = spark.createDataFrame(ITEMS[:-1], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "h", "r") for r in DOCS], "doc_id long, text string, hits string, row string")
    many = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for table, listed in ((docs, items), (nasty, items), (documents, many), (docs, items.limit(0))):
        by_set = decontaminate.remove_spans(table, listed)
        by_join = decontaminate.remove_spans(table, listed, set_windows=0)
        assert by_join.columns == table.columns
        assert sorted(map(str, by_join.collect())) == sorted(map(str, by_set.collect()))
