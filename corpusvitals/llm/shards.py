"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over region and rack to its shard. At each node
every child draws ``-ln(u) / weight`` with a hash ``u`` of row key and child
name, and the smallest draw wins. A child's draw depends on nothing but its
own weight, so rows move only into a subtree whose weight has grown (or out
of one that shrank). A new shard opens a region of its own, which is why it
takes rows only into itself.

Defined results: a null key is the empty key; equal keys share a shard; slots
number the rows of a shard from 0 without gaps, in hash order. Of a text only
size and checksum move on, so any length will do.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusvitals.llm.frames import text_of
from corpusvitals.session import stage

#: Hexadecimal digits of the hash that names a row's bucket within its shard: 4096 buckets.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def branch(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(weights: dict[str, dict[str, dict[int, float]]]) -> Node:
    """Root of ``{region: {rack: {shard: weight}}}``."""
    return branch(
        "",
        [
            branch(
                f"{region}",
                [
                    branch(f"{region}/{rack}", [Node(f"{region}/{rack}/{s}", w, shard=s) for s, w in shards.items()])
                    for rack, shards in racks.items()
                ],
            )
            for region, racks in weights.items()
        ],
    )


def topology(shards: int = 8) -> dict[str, dict[str, dict[int, float]]]:
    """Eight shards in two regions of two racks each; each further shard is a region."""
    found: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        region, rack = (f"r{s // 4}", f"k{s // 2 % 2}") if s < 8 else (f"r{s - 6}", "k0")
        found.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return found


def draw(key: Column, node: Node) -> Column:
    """Exponential draw of a child; 52 bits of the hash, never 0 or 1."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node.name))), 1, 13), 16, 10)
    u = (digits.cast("double") + F.lit(0.5)) / F.lit(2.0**52)
    return -F.ln(u) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    if node.shard is not None:
        return F.lit(node.shard)
    below = [descend(key, child) for child in node.children]
    if len(below) == 1:
        return below[0]
    draws = [F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    best = F.array_min(F.array(*draws))["i"]
    chosen = F.when(best == 0, below[0])
    for i, shard in enumerate(below[1:], 1):
        chosen = chosen.when(best == i, shard)
    return chosen


def place(
    docs: DataFrame,
    weights: dict[str, dict[str, dict[int, float]]] | None = None,
    grown: dict[str, dict[str, dict[int, float]]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    Only ids, sizes and checksums are shuffled. A shard is numbered bucket by
    bucket: the counts of its buckets (a table of shards x buckets rows) give
    each bucket its first slot, so no task sees a whole shard.
    """
    now = tree(weights or topology())
    then = tree(grown or topology(9))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(key, now).cast("int").alias("shard"),
        descend(key, then).cast("int").alias("grown_shard"),
    )
    mixed = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_crc32"))
    rows = stage(rows, "placed").withColumn("bucket", F.substring(F.md5(mixed), 1, bucket_digits))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = (
        rows.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])  # shards x buckets rows at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("rank") + F.col("first")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
