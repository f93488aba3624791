"""Word-table BPE, hard negatives and centroid clustering: the library, brute force and defined cases."""

import functools
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgelog.llm import centroids, negatives, wordcodes
from edgelog.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture
def library():
    return _library()


# --- BPE through the word table -------------------------------------------------------------------------------------
@functools.cache
def _ids():
    splitter, encoder = wordcodes.Splitter(PATH), wordcodes.WordEncoder(PATH)

    def of(t):
        runs = splitter.runs(t) if max(t, default="") < wordcodes.PLAIN_LIMIT else None
        words = splitter.words(t) if runs is None else [w for r in runs for w in splitter.plain(r)]
        return [i for own in encoder.ids(words) for i in own]

    return of


def test_plain_splitting_equals_the_library_on_every_character(library):
    of = _ids()
    assert wordcodes.PLAIN_LIMIT.encode()[0] == wordcodes.PLAIN_BYTE > chr(ord(wordcodes.PLAIN_LIMIT) - 1).encode()[0]
    for c in range(ord(wordcodes.PLAIN_LIMIT)):
        for text in (chr(c), f"a{chr(c)}B1{chr(c)}{chr(c)} {chr(c)}'S x'{chr(c)}", "É" + chr(c)):
            assert of(text) == library.encode(text, add_special_tokens=False).ids, (hex(c), text)


ODD = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAéÉ̱H İΣς'stıſKK日本 \n\t\x85\xa0 12")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(ODD, st.sampled_from(["", "<|startoftext|>", "<|endoftext|>x", "<|endoftext"]))
def test_words_give_the_ids_of_the_library(text, special):
    whole = text + special + text
    assert _ids()(whole) == _library().encode(whole, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 31 - 1)), max_size=9), max_size=9))
def test_packed_numbers_round_trip(rows):
    column = wordcodes.packed(np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows], np.int64))
    for part, expected in ((column, rows), (column[1:], rows[1:])):
        values, counts = wordcodes.unpacked(part)
        assert [v.tolist() for v in np.split(values, np.cumsum(counts)[:-1])][: len(expected)] == expected and counts.tolist() == [len(r) for r in expected]


def test_encode_and_decode_equal_the_library(spark, documents, library):
    rows = AWKWARD + [(20, "Zoë's <|startoftext|> 12 ΣΑΣ H̱", "en"), (21, "x" * 5000, None), (22, "same words", "en"), (22, "same words", "en")]
    for chunk in (1, 40, 1 << 26):  # a chunk per row, chunks of a few rows, one chunk a task
        docs = documents(rows, 3)
        got = wordcodes.decode(wordcodes.encode(docs, PATH, chunk), PATH).collect()
        assert sorted(map(str, got)) == sorted(map(str, wordcodes.encode_and_decode(docs, PATH, chunk).collect()))
        expected = []
        for i, text, _ in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
        assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got), key=str) == sorted(expected, key=str)
    assert wordcodes.encode(documents([]), PATH).count() == 0


def test_decode_of_any_ids(spark):
    table = spark.createDataFrame([(1, [518, 2368]), (2, []), (3, None), (4, [49407, 99999999, -1, 518])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in wordcodes.decode(table, PATH).collect()}
    assert got == {1: "the</w> cat</w>", 2: "", 3: "", 4: "<|endoftext|> the</w>"}
    pieces = wordcodes.piece_table(spark, PATH)
    assert pieces.where("id = 518").first()["piece"] == "the</w>" and pieces.count() == 49408


def test_word_numbers_are_not_shuffled(spark, documents):
    plan = wordcodes.encode(documents([(1, "a b", "en"), (2, "b c", "en")]), PATH)._jdf.queryExecution().executedPlan().toString()
    codes = [line for line in plan.splitlines() if "codes" in line and "FileScan" in line]
    assert len(codes) == 1 and "Bucketed: true" in codes[0]
    above = plan[: plan.index(codes[0])].splitlines()
    assert not any("Exchange" in line for line in above)


def test_each_distinct_word_is_encoded_once(spark, documents, monkeypatch):
    monkeypatch.setattr(wordcodes, "ROWS_A_BLOCK", 3)
    monkeypatch.setattr(wordcodes, "RUNS_KEPT", 2)
    numbers = wordcodes.Numbers(str.split)
    assert [numbers[r] for r in ("a b", "a", "c a b", "a b")] == [(0, 1), (0,), (2, 0, 1), (0, 1)]
    rows = [(i, f"a a b{i % 7} c{i % 5}", "en") for i in range(50)]
    seen = []

    class Counting(wordcodes.WordEncoder):
        def ids(self, words):
            seen.extend(words)
            return super().ids(words)

    monkeypatch.setattr(wordcodes, "worker_cache", lambda key, build: Counting(PATH))
    words = sorted((w, c, i) for i, w in enumerate(["a", "b", "c", "d"]) for c in range(9))
    table = pa.table({"word": [w for w, _, _ in words], "_of": [c for _, c, _ in words], "_code": pa.array([i for _, _, i in words], pa.int32())})
    parts = list(wordcodes._encode(PATH)(iter(table.to_batches(max_chunksize=4))))
    assert seen == ["a", "b", "c", "d"]
    got = {(of, code) for p in parts for of, codes in zip(p.column("_of").to_pylist(), p.column("numbers")) for code in codes.as_py()}
    assert got == {(c, i) for _, c, i in words}
    monkeypatch.undo()
    assert wordcodes.encode(documents(rows, 3), PATH, 20).count() == 50


def test_query_on_whole_documents(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_word_table"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- hard negatives -------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.sampled_from([1, 127, 2 ** 20, 2 ** 29, 2 ** 40]), st.integers(0, 2 ** 32 - 1))
def test_look_ups_give_exact_products(width, top, seed):
    rng = np.random.default_rng(seed)
    rows, anchors = rng.integers(-top, top + 1, (7, width)), rng.integers(-top, top + 1, (3, width))
    rows[0, 0], anchors[0, 0] = -top, -top
    kind = negatives.number_kind(width, top)
    got = negatives.scores(negatives.bit_planes(rows, top.bit_length() + 1), negatives.subset_sums(anchors, kind))
    assert got.tolist() == (rows.astype(object) @ anchors.astype(object).T).tolist()


def _vectors(spark, tmp_path, rows, kind="float", parts=4):
    path = str(tmp_path / f"v{len(list(tmp_path.iterdir()))}")
    full = [(*r, 1, 2, "x") for r in rows]
    spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, label int, _row long, cluster int, planes string").repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and _usable(v)]
    out = []
    for a, (ai, av, al) in enumerate(kept):
        if ai % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for b, (i, v, lab) in enumerate(kept) if b != a)
        for ps, pi, _ in [x for x in near if x[2] == al][:5]:
            fits = [(i, -s) for s, i, lab in near if lab != al and 30 * -ps <= -100 * s <= 90 * -ps][:10]
            out += [(ai, pi, r + 1, ni, -ps, ns) for r, (ni, ns) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_group, anchors_a_group", [(4096, 4096), (23, 3)])
def test_hard_negatives_equal_brute_force(spark, tmp_path, monkeypatch, rows_a_group, anchors_a_group):
    monkeypatch.setattr(negatives, "ROWS", rows_a_group)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_a_group)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(rng.choice([3, 9]))], rng.choice([0, 0, 0, 1, 2])) for i in range(140)]
    rows += [(200 + i, [0.25, 0.25, 0.3], 0) for i in range(40)]  # a hot vector and label: ties everywhere
    rows += [(10, [0.3, 0.3, 0.3], 1), (10, [0.3, 0.3, 0.3], 0), (30, [0.1], None), (40, None, 1), (None, [1.0, 1.0, 1.0], 1),
             (50, [0.1, None], 1), (60, [float("nan")], 1), (70, [float("inf")], 1), (80, [], 1)]
    df = _vectors(spark, tmp_path, rows)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == brute_negatives(floats, 10)


def test_hard_negatives_without_rows(spark, tmp_path):
    df = _vectors(spark, tmp_path, [(1, [1.0], 0)])
    assert negatives.hard_negatives(df, F.col("vec_id") % 2 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") > 0).count() == 0
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") > 0).count() == 0


def test_scores_beyond_32_bits(spark, tmp_path):
    rows = [(i, [float(10 ** 4 * i), -3.0 * 10 ** 5], i % 2) for i in range(12)]
    got = negatives.hard_negatives(_vectors(spark, tmp_path, rows, "double"), F.col("vec_id") % 3 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(rows, 3)


# --- centroid clustering --------------------------------------------------------------------------------------------
def brute_clusters(rows, dims, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and _usable(v)]
    begin = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in begin[:clusters]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (_, j) in zip(kept, near) if j == k]
            if own:
                centres[k] = [sum(column) // len(own) for column in zip(*own)]
    near, total = assign(), 0
    per = [sum(d for d, j in near if j == k) for k in range(len(centres))]
    return [(i, k, d, per[k], sum(per), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, near)]


def _clusters(df, **kw):
    cols = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in centroids.cluster(df, **kw).select(*cols).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 5, 150])
def test_clusters_equal_brute_force(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.choice([0.0, 0.0, 0.3, -0.7]) for _ in range(4)]) for i in range(n)]
    if n > 5:
        rows += [(1000 + i, [0.5, 0.5, 0.5, -0.5]) for i in range(60)] + [(3, [0.5] * 4), (3, [0.5] * 4), (None, [0.1] * 4)]
    rows += [(900, None), (901, [1.0] * 3), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("-inf")] * 4), (906, [])]
    df = _vectors(spark, tmp_path, [(i, v, 0) for i, v in rows], "double")
    assert _clusters(df, dims=4) == sorted(brute_clusters(rows, 4), key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.sampled_from([3, 1000, centroids.LARGEST]))
def test_bounds_never_exceed_distances(seed, top):
    rng = np.random.default_rng(seed)
    x = rng.integers(-top, top + 1, (200, 5))
    x[100:] = x[0] + rng.integers(-1, 2, (100, 5))  # vectors close to one another and to the pivots
    pivots, centres = centroids.pivots_of(x[:40], 6), x[rng.integers(0, 200, 8)]
    to_pivots = np.sqrt(centroids.squared(x[:, None], pivots[None]))
    low = centroids.lower_bounds(to_pivots, np.sqrt(centroids.squared(centres[:, None], pivots[None])), np.sqrt(centroids.squared(pivots[:, None], pivots[None])))
    exact = centroids.squared(x[:, None], centres[None])
    assert (low <= exact).all()
    cluster, distance, checked = centroids.nearest(x, to_pivots, centres, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and checked <= exact.size


def test_pivots_exclude_centroids_of_far_groups():
    rng = np.random.default_rng(1)
    middle = rng.integers(-100_000, 100_000, (8, 16))
    x = middle[rng.integers(0, 8, 4000)] + rng.integers(-500, 500, (4000, 16))
    pivots = centroids.pivots_of(x[:1000], 6)
    _, _, checked = centroids.nearest(x, np.sqrt(centroids.squared(x[:, None], pivots[None])), middle, pivots)
    assert checked < 1.5 * len(x)  # of 8 a vector


def test_parts_out_of_range_raise(spark, tmp_path):
    df = _vectors(spark, tmp_path, [(1, [1e9], 0)], "double")
    with pytest.raises(Exception, match="vector parts beyond"):
        centroids.cluster(df, dims=1).collect()
