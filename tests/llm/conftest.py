import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, node long, label int, fp string"


@pytest.fixture
def documents(spark, tmp_path):
    """Documents in files, with columns whose names the operators use inside."""

    def make(rows, parts=2):
        full = [(i, t, lang, "s", None if t is None else len(t), 7, 8, 9, "x") for i, t, lang in rows]
        path = str(tmp_path / f"documents{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


AWKWARD = [(1, None, None), (2, "", "en"), (3, "!!! ... ???", None), (4, "a", "en"), (5, "word " * 30000, "en"),
           (5, "word " * 30000, "en"), (None, "no id here at all, just some words", "fr"), (7, "éà ü 日本語 \x00 ok", None)]
"""Null text, no text, no letters, one letter, a very long repetitive text twice with one id, a null id, odd characters."""
