"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from edgelog.llm import (centroids, decontaminate, language, minhash, negatives, packing, quality, repeats, sharding, topk, toxicity,
                         urlfilter, wordcodes)
from edgelog.llm.common import crc_mod, table

SHARDS = [1.0] * 8
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and word pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.learn_prototypes(docs.where(crc_mod("doc_id", 5) != 0))
    return language.predict(docs, prototypes).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as t(verdict, host, path)")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)


def op4_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _learnable(spark, sf_dir))
    return toxicity.score(docs, *model).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, _learnable(spark, sf_dir))
    return quality.score(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op7_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.judge(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), SHARDS)


def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = wordcodes.encode_and_decode(table(spark, sf_dir, "documents"), path)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_ptolemaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bagminhash": op1_bagminhash,
    "op2_hyperdimensional": op2_hyperdimensional,
    "op3_link_graph": op3_link_graph,
    "op4_counterfactual": op4_counterfactual,
    "op5_best_fit": op5_best_fit,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_dual_tree": op7_dual_tree,
    "op8_suffix_groups": op8_suffix_groups,
    "op9_winnowing": op9_winnowing,
    "op10_rendezvous": op10_rendezvous,
    "op11_word_table": op11_word_table,
    "op12_four_russians": op12_four_russians,
    "op13_ptolemaic": op13_ptolemaic,
}
