"""Row keys under a changed cutting of files, hashes of long words, bounded samples."""

import pytest
from pyspark.sql import functions as F

from edgelog.llm import common, decontaminate, minhash, repeats

PARALLELISM = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def moving(spark, monkeypatch):
    """From the first stored table on, every further one is followed by another cutting of files into tasks."""
    write, turn = common.stored, [0]

    def stored(df, label):
        out = write(df, label)
        turn[0] += 1
        spark.conf.set(PARALLELISM, str(1 + turn[0] * 3 % 7))
        return out

    for module in (common, minhash, repeats):
        monkeypatch.setattr(module, "stored", stored)
    yield turn
    spark.conf.unset(PARALLELISM)


def _rows():
    same = "one two three four five six seven eight nine ten eleven twelve"
    passage = " ".join(f"passage{i}" for i in range(20))
    rows = [(i, f"{same} {i % 9}" if i % 3 == 0 else f"text {i} alone {' '.join(f'w{i}x{j}' for j in range(9))}", "en") for i in range(120)]
    return rows + [(200 + i, f"head{i} {passage} tail{i}", "en") for i in range(12)]


def _many_files(spark, documents):
    return documents(_rows(), 40)


def test_files_are_cut_anew(spark, documents):
    docs = _many_files(spark, documents)
    seen = set()
    for n in (1, 8):
        spark.conf.set(PARALLELISM, str(n))
        try:
            seen.add(docs.select("doc_id").rdd.getNumPartitions())
        finally:
            spark.conf.unset(PARALLELISM)
    assert len(seen) == 2


def test_keep_first_with_moving_tasks(spark, documents, moving):
    kept = [r["doc_id"] for r in minhash.keep_first(_many_files(spark, documents)).collect()]
    # texts of one family share eight or more of ten shingles
    families = [set(range(0, 120, 3)), set(range(200, 212)), *({i} for i in range(120) if i % 3)]
    assert moving[0] > 2
    assert len(kept) == len(families) and all(len(set(kept) & f) == 1 for f in families)


def test_repeats_with_moving_tasks(spark, documents, moving):
    got = {r["doc_id"]: r["n_removed"] for r in repeats.judge(_many_files(spark, documents)).collect()}
    assert moving[0] > 2 and got[200] == 0
    assert all(got[i] >= 180 for i in range(201, 212))
    assert sum(got[i] for i in range(120) if i % 3) == 0


def test_decontamination_with_moving_tasks(spark, documents, moving):
    bench = spark.createDataFrame([("b", " ".join(f"passage{i}" for i in range(12)))], "item_id string, text string")
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(_many_files(spark, documents), bench).collect()}
    assert left == set(range(120))


def test_long_words_of_one_polynomial_hash_stay_apart(documents):
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    rows = [(1, word, "en"), (2, word.translate({97: 98, 98: 97}), "en"), (3, word, "en")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_sample_of_repeated_ids_is_bounded(spark):
    docs = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, None), (9, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, None)], "doc_id long, toxic int")
    assert sorted(map(tuple, common.labelled_sample(docs, labels, "toxic", 5, "sample").collect())) == [("", 0), ("text 0", 1)]
    assert common.labelled_sample(docs, labels, "toxic", 1, "sample").count() == 1
