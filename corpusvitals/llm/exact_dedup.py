"""Exact dedup that no group of copies can overload.

Texts are normalised (each run of white space becomes one space) and grouped
by digest and full content at every step: within each task (the partial step
of the aggregation), then per salt, then over the salt winners, so a group
of any size sends one row per task and one per salt. Only the winners carry
texts; members meet them by digest, content hash and length.

Defined results: null texts are empty texts; null ids are never the smallest
unless a group has no others; rows equal in id and text are one document
repeated, of which the first stays; other columns of the input are ignored.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvitals.llm.frames import keep_rows, text_of
from corpusvitals.session import stage

SALTS = 16

# single spaces already are what they would become
_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` may be any function of the text: texts that it does not tell
    apart are told apart by their content.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("content")
    ).withColumn("digest", digest(F.col("content")))
    marks = [F.xxhash64("content").alias("mark"), F.length("content").alias("chars")]

    winners = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        .repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("digest", *marks, "keep_id", "group_size")
        .groupBy("digest", "mark", "chars")
        .agg(
            F.min("keep_id").alias("keep_id"),
            F.min("group_size").alias("group_size"),
            F.count("*").alias("contents"),
        )
        # two contents of equal digest, hash and length must stop the job, not merge
        .filter(
            F.when(F.col("contents") == 1, True).otherwise(
                F.raise_error(F.lit("different texts of equal digest, hash and length"))
            )
        )
        .drop("contents")
    )
    members = (
        rows.select("doc_id", "digest", *marks, F.sha2("content", 256).alias("text_sha256"))
        .groupBy("doc_id", "digest", "mark", "chars", "text_sha256")
        .agg(F.count("*").alias("copies"))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    )
    # written, so that the join exchanges both sides and a group of very many rows can be split
    return members.join(stage(winners, "winners"), ["digest", "mark", "chars"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    # the hash of the raw text tells rows of one id apart
    marked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("mark"), F.sha2(normalised(text_of(text_col)), 256).alias("text_sha256"))
    first = exact_dedup(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256")
    same = marked["doc_id"].eqNullSafe(first["doc_id"]) & (marked["text_sha256"] == first["text_sha256"])
    kept = (
        marked.join(first, same, "left_semi")
        .groupBy("doc_id", "text_sha256")
        .agg(F.min("mark").alias("mark"))
        .select("doc_id", "mark")
    )
    return keep_rows(docs, kept, id_col, text_col)
