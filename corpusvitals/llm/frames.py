"""Helpers shared by the operators of this subpackage."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def text_of(name: str) -> Column:
    """The text column; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of the batches, so that only a few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named in ``kept(doc_id, mark)``, one for each; mark is the hash of the text.

    The columns of ``docs`` come back as they were, whatever their names.
    """
    helpers = {name: f"__keep_{name}" for name in ("doc_id", "mark", "copy")}
    rows = docs.withColumn(helpers["doc_id"], F.col(id_col)).withColumn(helpers["mark"], F.xxhash64(text_of(text_col)))
    wanted = kept.select(F.col("doc_id").alias("__want_id"), F.col("mark").alias("__want_mark"))
    same = rows[helpers["doc_id"]].eqNullSafe(wanted["__want_id"]) & (rows[helpers["mark"]] == wanted["__want_mark"])
    within = W.partitionBy(helpers["doc_id"], helpers["mark"]).orderBy(helpers["mark"])
    return (
        rows.join(wanted, same, "left_semi")
        .withColumn(helpers["copy"], F.row_number().over(within))
        .filter(F.col(helpers["copy"]) == 1)
        .select(*docs.columns)
    )


#: Keys with at least one of so many equal shares of all rows are hot.
SHARES = 1000


def join_labels(rows: DataFrame, labels: DataFrame, key: str, shares: int = SHARES) -> DataFrame:
    """``rows`` with the columns of ``labels(key, n, ...)``, which has a row per key and in ``n`` how many rows have it.

    Hot keys, ``shares`` of them at most, go to the tasks; the others meet
    their rows by a shuffle, in which none of them is hot. Both tables are
    written ones, as they are read more than once.
    """
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * shares >= total
    added = [c for c in labels.columns if c not in (key, "n")]
    hot = labels.filter(is_hot).select(key, *added, F.lit(True).alias("__hot"))
    met = rows.join(F.broadcast(hot), key, "left")
    found = met.filter("__hot").select(*rows.columns, *added)
    rest = met.filter("__hot IS NULL").select(*rows.columns).join(labels.filter(~is_hot).select(key, *added), key)
    return found.unionByName(rest.select(*rows.columns, *added))
