"""The pipeline's language stage: unlearned scripts and letter noise go, labelled documents stay."""

import random

import pytest

import corpus_pipeline
from edgelog.llm.common import table
from tests.conftest import SF_SMALL

LETTERS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "consonants": "bcdfghjklmnpqrstvwxz", "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
           "Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "Han": "".join(chr(0x4E00 + i) for i in range(3000))}


def noise(letters, words, rng):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(words))


@pytest.mark.parametrize("sf_dir", [SF_SMALL, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_noise_goes_and_labelled_documents_stay(spark, sf_dir):
    rng = random.Random(7)
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where("lang is not null and text rlike '\\\\p{L}'").count()
    rows = [(-1 - i, noise(x, 30 + 30 * (i % 20), rng), None, name, 0) for name, x in LETTERS.items() for i in range(100)]
    mixed = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
                             .select(*[c for c in docs.columns]).to(docs.schema))
    kept = corpus_pipeline.identify_language(spark, mixed, sf_dir).cache()
    assert kept.where("lang is not null").count() == labelled
    assert kept.where("doc_id < 0").count() == 0
