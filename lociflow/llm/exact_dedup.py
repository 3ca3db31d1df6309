"""Exact dedup by progressive refinement: length, then a hash of a short prefix, then a hash of the whole text.

Each key is counted with partial aggregation, and only what shares it goes on to the next: prefixes are hashed of texts
whose length another text has, and whole texts of those whose length and prefix hash another has. The surviving keys,
and the groups found, are stored tables that are broadcast only if their checked row count allows it; else they are
joined by a shuffle in which keys of many rows are dealt over several partitions. Rows that dropped out on the way take
part in no join by a common key.

Texts are equal when they are identical after each run of white space is replaced by one space. Edge cases: a null
text counts as empty, and empty texts equal each other. The row with the smallest doc_id stays (nulls last); rows of a
kept text that share that doc_id are repeated rows, of which one stays. Extra columns are kept; flagged() replaces
those with the name of a result column, exact_dedup() hands them on. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, spread_join, stored

RESULT = ("keep_id", "group_size", "kept")
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def refined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with __lf_full, the whole text's SHA-256 where (length, prefix hash) is shared, else a value of the row's
    own; and the groups (__lf_full, keep_id, n: rows, same: rows that have keep_id) of more than one row."""
    keyed = docs.withColumn("__lf_norm", normalised(F.col("text"))).withColumn("__lf_len", F.length("__lf_norm"))
    shared = F.lit(True).alias("__lf_shared")
    lengths = keyed.groupBy("__lf_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lengths = stored(lengths.select("__lf_len", "n", F.lit(True).alias("__lf_twin")), "lengths")
    keyed = spread_join(keyed, lengths.drop("n"), "__lf_len", lengths.select("__lf_len", "n"), "left")
    head = F.when(F.col("__lf_twin"), F.xxhash64("__lf_len", F.substring("__lf_norm", 1, PREFIX)))
    keyed = keyed.withColumn("__lf_head", head).drop("__lf_twin")
    heads = stored(keyed.where("__lf_head IS NOT NULL").groupBy("__lf_head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__lf_head", "n", shared), "heads")
    # no two rows share the key of a row that is alone in its length
    keyed = keyed.withColumn("__lf_head", F.coalesce("__lf_head", F.xxhash64("__lf_len", "doc_id")))
    full = spread_join(keyed, heads.drop("n"), "__lf_head", heads.select("__lf_head", "n"), "left")
    own = F.concat(F.lit("-"), F.col("__lf_head").cast("string"))
    full = full.withColumn("__lf_full", F.when(F.col("__lf_shared"), F.sha2(F.col("__lf_norm"), 256)).otherwise(own))
    full = full.drop("__lf_norm", "__lf_len", "__lf_head", "__lf_shared")
    ids = full.where("NOT startswith(__lf_full, '-')").groupBy("__lf_full", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("__lf_full").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    groups = groups.where("n > 1").select("__lf_full", F.col("first.doc_id").alias("keep_id"), "n", F.col("first.n").alias("same"))
    return full, stored(groups, "groups")


def _marked(docs: DataFrame) -> DataFrame:
    """docs with __lf_keep, __lf_size and __lf_kept; one row of each group of equal texts is kept."""
    full, groups = refined(docs)
    table = groups.select("__lf_full", F.col("keep_id").alias("__lf_keep"), F.col("n").alias("__lf_size"), F.col("same").alias("__lf_same"))
    out = spread_join(full, table, "__lf_full", groups.select("__lf_full", "n"), "left")
    alone = F.col("__lf_size").isNull()
    out = out.withColumns({"__lf_keep": F.when(alone, F.col("doc_id")).otherwise(F.col("__lf_keep")), "__lf_size": F.coalesce("__lf_size", F.lit(1).cast("long"))})
    first = F.col("__lf_keep").eqNullSafe(F.col("doc_id"))
    once = out.where(~first | F.coalesce(F.col("__lf_same") == 1, F.lit(True))).withColumn("__lf_kept", first)
    # repeated rows of one doc_id and text: numbered, spread by text and id
    order = Window.partitionBy("__lf_full", "doc_id").orderBy(row_hash(docs))
    again = out.where(first & (F.col("__lf_same") > 1)).withColumn("__lf_kept", F.row_number().over(order) == 1)
    return once.unionByName(again).drop("__lf_full", "__lf_same")


def flagged(docs: DataFrame) -> DataFrame:
    """docs with keep_id, group_size and kept."""
    return _marked(docs.drop(*RESULT)).withColumnsRenamed({"__lf_keep": "keep_id", "__lf_size": "group_size", "__lf_kept": "kept"})


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps."""
    return _marked(docs).where("__lf_kept").select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
n AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM n"""
