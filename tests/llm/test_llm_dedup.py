import re
from collections import defaultdict

from pyspark.sql import functions as F

from corpusvitals.llm import components, exact_dedup, frames, simhash
from xxhash import xxh64_intdigest


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = min(known) if known else None, True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            found.append((i, keep, len(ids), i == keep and first))
            first = first and i != keep
    return sorted(found, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def test_exact_dedup(nasty, empty, documents):
    for docs in (nasty, documents):
        assert got(exact_dedup.exact_dedup(docs)) == expected(docs.collect())
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_texts_of_equal_digest_stay_apart(nasty, documents):
    weak = lambda text: F.length(text) % 3
    for docs in (nasty, documents):
        assert got(exact_dedup.exact_dedup(docs, digest=weak, salts=3)) == expected(docs.collect())


def test_exact_dedup_keeps_rows_whole(nasty):
    kept = exact_dedup.dedup(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    assert len(rows) == len({norm(r.text) for r in nasty.collect()})
    assert len({norm(r.text) for r in rows}) == len(rows)
    assert {r.doc_id for r in rows if norm(r.text) == "a b c d e f"} == {6}


def naive_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps, radius=2):
    """Component ids by comparing all pairs of distinct fingerprints."""
    distinct = sorted(set(fps.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for doc, f in fps.items():
        least[root(f)] = min(doc, least.get(root(f), doc))
    return {doc: least[root(f)] for doc, f in fps.items()}


def test_fingerprints(nasty, documents):
    for docs in (nasty, documents):
        for r in docs.select("text").collect():
            assert simhash.fingerprint(r.text or "") % 2**64 == naive_fingerprint(r.text)


def test_every_pair_within_the_radius_meets():
    for radius in (2, 4):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
    tables = simhash.masks(2)
    assert all(any(not (m >> i & 1 or m >> j & 1) for m in tables) for i in range(64) for j in range(i + 1))


def test_near_duplicates(documents):
    found = simhash.near_duplicates(documents).collect()
    fps = {r.doc_id: naive_fingerprint(r.text) for r in documents.collect()}
    assert {r.doc_id: r.fp % 2**64 for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == naive_components(fps)


def test_chains_of_fingerprints(spark):
    words, word = [], 0x123456789ABCDEF
    for i in range(200):  # a chain with steps of two bits, another of three, some strangers
        word ^= 1 << (i * 7 % 64) | 1 << (i * 7 % 64 + 1) % 64
        words.append(word)
        words += [word ^ 0x700000, word ^ (i << 30) ^ 0x5555] if i % 9 == 0 else []
    fps = {i: w for i, w in enumerate(dict.fromkeys(words))}
    df = spark.createDataFrame([(simhash._signed(w),) for w in fps.values()], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    mine = {i: roots.get(simhash._signed(w), simhash._signed(w)) for i, w in fps.items()}
    theirs = naive_components(fps)
    pairs = {(mine[i], theirs[i]) for i in fps}
    assert len(pairs) == len(set(mine.values())) == len(set(theirs.values()))


def test_near_dedup_rows(nasty, empty):
    kept = simhash.dedup(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 5, 6, 8, 9, 10]
    assert [r.text for r in rows if r.doc_id is None] == ["lonely words here"]
    assert simhash.dedup(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []


def test_components(spark):
    pairs = [(i + 1, i) for i in range(100, 140)] + [(5, i) for i in range(6, 50)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "high long, low long")
    found = {r.node: r.root for r in components.components(df).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 50)}}
    assert components.components(df.limit(0)).collect() == []


def test_labels_of_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}") for i in range(300)], "i int, key string")
    labels = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    wanted = sorted((r.i, r.key, r.least) for r in rows.join(labels, "key").collect())
    for shares in (1, 2, 30, 10**6):
        found = frames.join_labels(rows, labels, "key", shares)
        assert sorted((r.i, r.key, r.least) for r in found.collect()) == wanted
    assert frames.join_labels(rows.limit(0), labels.limit(0), "key").collect() == []
