"""One query for each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, mixing, near_dedup, packing, pieces, prefixes, pst, secrets, structure, toxicity, url_filter
from .common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # the result holds no text: what is sorted and summed is a narrow table, made in one pass over the texts
    narrow = stored(mixing.sized(docs).drop("text"), "sizes")
    return mixing.named(mixing.shares(narrow)).select("doc_id", "size", "source_size", "target", "taken")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.link(*chat.derived(turns), repeats=True).unionByName(chat.others(turns))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs).drop("text")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.spans_text(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    flags = exact_dedup.flagged(docs)
    return flags.select("doc_id", "keep_id", "group_size", "kept", F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("text_sha256"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure.of_all(turns, *structure.repair(structure.damaged(turns)))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixes.trie(*prefixes.rebuilt(turns))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_lm_scoring, op4_chat_format, op5_pieces, op6_secrets, op7_near_dedup, op8_toxicity, op9_exact_dedup, op10_neighbours, op11_structure_repair, op12_packing, op13_prefix_trie)}
ORACLES = {"op1_url_filter": url_filter.sql(), "op2_mixing": mixing.sql(), "op6_secrets": secrets.sql(), "op9_exact_dedup": exact_dedup.SQL, "op11_structure_repair": structure.sql(), "op13_prefix_trie": prefixes.sql()}
