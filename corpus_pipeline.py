"""Corpus pipeline: language ID, near-dedup, repeated-passage removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgelog.llm import decontaminate, language, minhash, packing, repeats
from edgelog.llm.common import crc_mod, stored, table
from edgelog.llm.queries import tokenizer

# Below, a text resembles no language.  A random vector's cosine has a standard deviation of 0.011.  On the given tables the
# lowest labelled documents have 0.031, 0.127 and 0.206 in the three classes of size (different trigrams); noise of 64 and more
# stays under 0.15.  A few words alone can't be told from noise, so there only the chance level goes.
LEAST_COSINE = 0.03
LEAST_BY_TRIGRAMS = ((32, 0.1), (64, 0.17))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and resembles a language that the labelled rows show; other rows go."""
    prototypes = language.learn_prototypes(docs.where(crc_mod("doc_id", 5) != 0))
    return language.keep_known(docs, prototypes, LEAST_COSINE, LEAST_BY_TRIGRAMS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class of equal or similar texts."""
    return minhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes that repeat a passage seen earlier."""
    return repeats.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in the training sequences."""
    return packing.pack_documents(docs, *tokenizer())


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats),
          ("decontamination", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None  # prototypes, signatures and BPE ids are beyond SQL; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
