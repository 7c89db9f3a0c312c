"""Queries of the operators over the driver's tables, with DuckDB counterparts where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusvitals.llm import alignment, bpe, chat, decontaminate, exact_dedup, line_dedup, quality, repetition, shards, simhash, toxicity, variants, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


# every length of line has a threshold of its own
_LINES = {"min_chars": line_dedup.TWO_EDITS_CHARS, "word_run": line_dedup.WORD_RUN, "short_chars": line_dedup.SHORT_CHARS}


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"), **_LINES)


def op7_line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_members(_table(spark, sf_dir, "documents"), **_LINES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark).drop("hits")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    found = chat.format_and_read(turns.union(extra), tokenizer_path("byte_bpe_50k.json"))
    return found.drop("n_tokens", "n_loss_tokens")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"), noise=199)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.apply_rules(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_shards": op2_shards,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_line_members": op7_line_members,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat": op9_chat,
    "op10_warc": op10_warc,
    "op11_variants": op11_variants,
    "op12_align": op12_align,
    "op13_rules": op13_rules,
}

# the tree of shards.topology: name of each node and the number of shards below
_DRAW = "(-ln((('0x' || substr(md5(k || '|{name}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight})"


def _pick(options: list[tuple[str, float, str]]) -> str:
    """CASE over children (name, weight, what is below) for the smallest draw; the first of equal ones."""
    if len(options) == 1:
        return options[0][2]
    draws = [_DRAW.format(name=name, weight=weight) for name, weight, _ in options]
    arms = [f"WHEN {d} <= least({', '.join(draws)}) THEN {below}" for d, (_, _, below) in zip(draws, options)]
    return f"(CASE {' '.join(arms)} END)"


def _shard_sql(count: int) -> str:
    regions = []
    for region, racks in shards.topology(count).items():
        inner = []
        for rack, leaves in racks.items():
            leaf = _pick([(f"{region}/{rack}/{s}", w, str(s)) for s, w in leaves.items()])
            inner.append((f"{region}/{rack}", sum(leaves.values()), leaf))
        regions.append((region, sum(w for _, w, _ in inner), _pick(inner)))
    return _pick(regions)


_OP5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""

_WORDS_SQL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
)

_OP8 = f"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 13
        THEN list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))
        ELSE [array_to_string(w, ' ')] END) AS gram, least(len(w), 13) AS m
      FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
m AS (SELECT DISTINCT m FROM g),
p AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m),
h AS (SELECT p.doc_id, p.i, p.m, g.item_id FROM p JOIN g ON g.m = p.m AND g.gram = array_to_string(p.w[p.i:p.i + p.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

_CHECKSUM = """list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2),
    lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)]))"""

# the table of CRC-32 by its rule: eight steps of the reversed polynomial for each byte
_OP2 = f"""
WITH c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS crc),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
p AS (SELECT doc_id, k, length(h) // 2 + 1 AS size, xor(4294967295, {_CHECKSUM}) AS text_crc32,
    {_shard_sql(8)} AS shard, {_shard_sql(9)} AS grown_shard FROM d, c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '|' || text_crc32), 1, 3), doc_id, text_crc32, size) - 1 AS slot,
    CAST(grown_shard AS INTEGER) AS grown_shard FROM p"""

_TURN = "replace(coalesce({0}, ''), chr(92), chr(92) || chr(92))"
for _control in chat.CONTROL:
    _TURN = f"replace({_TURN}, '{_control}', '{_control[0]}' || chr(92) || '{_control[1:]}')"

_OP9 = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + length({_TURN.format("text")}) + 24) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31 AS BIGINT) + 1, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

_OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY html)"""

_OP11 = f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS crc),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, hex(encode(id || ':' || run)) AS h, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
m AS (SELECT run, k, xor(4294967295, {_CHECKSUM}) AS h FROM d, c),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(k) AS BIGINT) AS n FROM m GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word
    UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
    CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
    UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f
LEFT JOIN (SELECT s.word, s.root FROM s JOIN f ON s.root = f.word WHERE f.form IS NULL) e ON e.word = f.word"""

SQL: dict[str, str] = {
    "op11_variants": _OP11,
    "op2_shards": _OP2,
    "op9_chat": _OP9,
    "op5_exact_dedup": _OP5,
    "op8_decontaminate": _OP8,
    "op10_warc": _OP10,
}
