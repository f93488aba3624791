"""Sharding, language, packing, toxicity, quality: brute force, held-out accuracy and defined cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgelog.llm import language, packing, quality, sharding, toxicity
from edgelog.llm.common import crc_mod
from edgelog.llm.queries import QUERIES, tokenizer
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD


# --- sharding -------------------------------------------------------------------------------------------------------
def _winner(key, weights):
    costs = []
    for i, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        costs.append((-math.log(u) / w, i))
    return min(costs)[1]


def test_sharding_matches_brute_force(spark):
    rows = QUERIES["op10_rendezvous"](spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == _winner(r["doc_id"], [1.0] * 8)
        assert r["grown_shard"] == _winner(r["doc_id"], [1.0] * 9)
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_sharding_follows_weights(spark):
    got = spark.range(4000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 4000 for r in got}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.03


def test_sharding_awkward_rows(documents):
    rows = sharding.shard_records(documents(AWKWARD), [1.0] * 8).collect()
    assert len(rows) == len(AWKWARD)
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [1]
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.shard_records(documents(AWKWARD).limit(0), [1.0] * 8).count() == 0


# --- language -------------------------------------------------------------------------------------------------------
def test_bundle_equals_adding_bound_vectors():
    first, second, third = language.letter_vectors()
    codes = language.letter_codes()
    text = "Ab c"
    padded = [0, *codes[[ord("a"), ord("b")]], 0, codes[ord("c")], 0]
    want = sum(first[a] * second[b] * third[c] for a, b, c in zip(padded, padded[1:], padded[2:]) if b)
    assert np.array_equal(language.bundles(*language.trigram_counts([text]))[0], want)


def test_language_held_out_accuracy(spark):
    got = QUERIES["op2_hyperdimensional"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").where("lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_awkward_rows(documents):
    docs = documents(AWKWARD)
    prototypes = language.learn_prototypes(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, prototypes).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert language.predict(docs, prototypes).count() == len(AWKWARD)
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}
    kept = language.keep_known(docs, prototypes, 0.0)
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language.keep_known(docs.limit(0), prototypes, 0.0).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet=" \n\tab1'é<|endoftext>", max_size=300))
def test_ids_equal_the_tokenizers_library(text):
    encoder = _encoder()
    assert encoder.ids(text).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


_kept = []


def _encoder():
    if not _kept:
        _kept.append(packing.Encoder(*tokenizer()))
    return _kept[0]


def test_special_token_text_and_corpus_ids(spark):
    encoder = _encoder()
    texts = ["x<|endoftext|>y", *[r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()]]
    for t in texts:
        assert encoder.ids(t).tolist() == encoder.exact.encode(t, add_special_tokens=False).ids


def _check_packing(rows, texts, capacity):
    encoder, by_doc = _encoder(), {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.append(encoder.ids(texts[doc] or ""), 2).astype("<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at: at + r["length"]].tobytes())
            assert r["length"] == capacity or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_whole_and_tight(spark):
    rows = QUERIES["op5_best_fit"](spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    n = _check_packing(rows, texts, 1024)
    assert -(-sum(r["length"] for r in rows) // 1024) <= n <= _best_fit([r["length"] for r in rows], 1024)


def test_plan_places_every_piece_and_uses_exact_fits():
    rng = random.Random(5)
    for _ in range(20):
        counts = [0] + [rng.choice([0, 0, 1, 2, 9]) for _ in range(64)]
        entries = packing.plan(counts, 64)
        used = [0] * 65
        for times, lengths in entries:
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
    assert packing.plan([0, 0, 0, 5, 0, 0, 0, 5, 0, 0, 0], 10) == [(5, [7, 3])]
    # 3 * (2 + 3 + 5) = 30: three sequences of 10 are the least there can be, and then each is full
    entries = packing.plan([0, 0, 3, 3, 0, 3, 0, 0, 0, 0, 0], 10)
    assert sum(times for times, _ in entries) == 3 and all(sum(lengths) == 10 for _, lengths in entries)


def _best_fit(lengths, capacity):
    gaps = []
    for size in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= size), default=capacity)
        if fit in gaps:
            gaps.remove(fit)
        gaps.append(fit - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_never_worse_than_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    counts = [0] + [rng.choice([0, 0, 0, 1, 2, 5]) for _ in range(capacity)]
    lengths = [x for x, n in enumerate(counts) for _ in range(n)]
    n = sum(times for times, _ in packing.plan(counts, capacity))
    assert -(-sum(lengths) // capacity) <= n <= _best_fit(lengths, capacity)


def test_packing_awkward_rows(documents):
    docs = documents([(i, t, x) for i, t, x in AWKWARD if i != 5] + [(5, "word " * 30000, "en")])
    rows = packing.pack_documents(docs, *tokenizer()).collect()
    _check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 1024)
    assert packing.pack_documents(docs.limit(0), *tokenizer()).count() == 0
    twice = packing.pack_documents(documents([(9, "same", None), (9, "same", None)]), *tokenizer()).collect()
    assert len(twice) == 2


# --- classifiers ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("key, label, least", [("op4_counterfactual", "toxic", 0.93), ("op6_nearest_neighbours", "quality", 0.96)])
def test_classifier_held_out_accuracy(spark, key, label, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[key](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where(F.col("predicted") == F.col(label)).count() >= least * held.count() > 0
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    threshold = 0.7 if label == "toxic" else 0.5
    assert got.where((F.col("score") < 0) | (F.col("score") > 1) | (F.col("predicted") != (F.col("score") >= threshold).cast("int"))).count() == 0


def test_held_out_is_the_contract_remainder(spark):
    got = spark.range(50).select("id", crc_mod("id", 3).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


def test_counterfactual_penalty_shrinks_the_effect_of_identity_terms():
    # feature 0: insult, 1 and 2: identity terms; term 1 goes with toxic texts in the sample
    y = np.array([1, 1, 1, 0, 0, 0, 0, 0] * 5, float)
    has = [[0, 1], [0, 1], [0], [1], [2], [2], [], []] * 5
    swapped = [[0, 2], [0, 2], None, [2], [1], [1], None, None] * 5
    free, _ = toxicity.train(y, has, [None] * len(y), 3)
    tied, _ = toxicity.train(y, has, swapped, 3)
    assert abs(tied[1] - tied[2]) < 0.1 * abs(free[1] - free[2]) and tied[0] > 1


def test_identity_swaps_in_the_design(spark, documents):
    docs = documents([(i, f"the {'women' if i % 2 else 'men'} are {'awful scum' if i < 20 else 'kind people'} number{i}", "en") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    chosen, weights, bias = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, chosen, weights, bias).collect()}
    assert min(got[i] for i in range(20)) > 0.7 > 0.3 > max(got[i] for i in range(20, 60))
    probe = documents([(1, "the women talk", None), (2, "the men talk", None)])
    a, b = (r["score"] for r in toxicity.score(probe, chosen, weights, bias).orderBy("doc_id").collect())
    assert abs(a - b) < 0.05


def test_classifiers_awkward_rows(spark, documents):
    docs = documents(AWKWARD)
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    tox = toxicity.score(docs, *toxicity.fit(docs, labels)).collect()
    qual = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(tox) == len(qual) == len(AWKWARD)
    assert all(0 <= r["score"] <= 1 for r in [*tox, *qual])
    empty = labels.limit(0)
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, *toxicity.fit(docs, empty)).collect())
    assert all(r["score"] == 0 for r in quality.score(docs, quality.fit(docs, empty)).collect())
    assert quality.score(docs.limit(0), None).count() == 0


def test_vote_is_exact_over_all_labelled_vectors():
    rng = np.random.default_rng(3)
    known, y = rng.normal(size=(200, 8)), rng.integers(0, 2, 200).astype(float)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    z = rng.normal(size=(30, 8))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    got = quality.vote(z.astype(np.float64), known, y)
    for i in range(30):
        cosine = known @ z[i]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-6) ** quality.POWER
        assert abs(got[i] - (w * y[near]).sum() / w.sum()) < 1e-9


def test_term_counts_ignore_the_neighbouring_text():
    from edgelog.llm.textops import Powers, byte_values
    kind, powers, values = quality.kinds(), Powers(), byte_values()
    texts = [b"Ab| c!", b"", b"xx xx xx"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    together = quality.term_counts(data, offsets, powers, values, kind)
    for i, t in enumerate(texts):
        alone = quality.term_counts(np.frombuffer(t, np.uint8), np.array([0, len(t)]), powers, values, kind)
        assert np.array_equal(together[i], alone[0])


def test_text_buffer_slices():
    from edgelog.llm.common import slices
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc", None, "é" * 10, ""], pa.string())})
    parts = [(r.num_rows, bytes(d), o.tolist()) for r, d, o in slices(iter([batch.slice(1)]), limit=4)]
    assert sum(n for n, _, _ in parts) == 3 and b"".join(d for _, d, _ in parts) == ("é" * 10).encode()
