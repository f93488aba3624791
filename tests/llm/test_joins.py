"""Near-duplicates, repeated passages, decontamination, URL filter, top-k, pipeline: brute force and defined cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgelog.llm import components, decontaminate, language, minhash, oracle, repeats, suffixes, topk, urlfilter
from edgelog.llm.common import crc_mod
from edgelog.llm.queries import QUERIES, tokenizer
from tests.conftest import SF_SMALL
from tests.llm.conftest import AWKWARD
from tests.llm.test_small_ops import _check_packing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def small_texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


# --- SQL parity -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("key", sorted(oracle.ORACLES))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(oracle.ORACLES[key])
    names = [d[0] for d in res.description]
    got = QUERIES[key](spark, SF_SMALL).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(res.fetchall())


# --- near-duplicates ------------------------------------------------------------------------------------------------
def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Smallest id of the class of each (id, text)."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [(i, t or "", bag(t)) for i, t in rows]
    for x, (i, ti, a) in enumerate(bags):
        for j, tj, b in bags[:x]:
            both = sum((a & b).values())
            if ti == tj or both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_match_brute_force(spark, small_texts):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op1_bagminhash"](spark, SF_SMALL).collect()}
    assert got == brute_classes(sorted(small_texts.items()))


def edited(words, rng, rate):
    return [rng.choice("qwertyuiop") * 3 if rng.random() < rate else w for w in words]


def test_family_of_near_copies_keeps_every_link(documents):
    rng = random.Random(2)
    rows, i = [], 0
    for _ in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        for _ in range(45):
            rows.append((i, " ".join(edited(base, rng, rng.choice([0.005, 0.02, 0.05]))), "en"))
            i += 1
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == brute_classes([(a, b) for a, b, _ in sorted(rows)])


def test_blocked_comparison_equals_pairs(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # many blocks from a small family
    test_family_of_near_copies_keeps_every_link(documents)


def test_signature_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(0)
    agree, want = [], []
    for t in range(60):
        keys = rng.integers(1, 1 << 48, 60).astype(np.uint64)
        a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = minhash.signatures(text, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        agree.append((s[0] == s[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    assert np.corrcoef(agree, want)[0, 1] > 0.6


def test_near_duplicates_awkward_rows(documents):
    docs = documents(AWKWARD)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["class_row"])
    assert len(by_id[5]) == 1 and by_id[1] == by_id[2] and by_id[3] != by_id[1]
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    want = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == want


# --- repeated passages ----------------------------------------------------------------------------------------------
def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(raw[s:s + 100])
        cut = np.cumsum(gone)[:len(raw)] > 0
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        spans = sum(1 for k in range(len(raw)) if cut[k] and (k == 0 or not cut[k - 1]))
        out[i] = (len(raw), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def _digests(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats_match_brute_force(spark, small_texts):
    assert _digests(QUERIES["op8_suffix_groups"](spark, SF_SMALL)) == brute_repeats(small_texts.items())


def test_repeats_planted(documents):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefg éà") for _ in range(n))
    passage, line = noise(260), noise(75)
    rows = [(i, noise(rng.randrange(400)) + (passage if i % 3 == 0 else line) + noise(rng.randrange(200)) + line, "en") for i in range(60)]
    rows += [(100, "a" * 700, None), (101, "ab" * 300, None), (102, rows[0][1], None), (103, passage[40:], None), (104, passage[:99], None)]
    rows += [(110 + i, noise(30) + passage[i:i + 130] + noise(30), None) for i in range(0, 100, 7)]
    docs = documents(rows, 3)
    want = brute_repeats([(a, b) for a, b, _ in rows])
    assert _digests(repeats.judge(docs)) == want
    cut = repeats.cut(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        n, gone, _, sha = want[r["doc_id"]]
        raw = r["text"].encode()
        assert r["n_chars"] == len(r["text"]) and n - gone - 4 <= len(raw) <= n - gone
        if len(raw) == n - gone:
            assert hashlib.sha256(raw).hexdigest() == sha


def test_repeats_crowded_anchor_in_parts(documents, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    test_repeats_planted(documents)


def test_repeats_awkward_rows(documents):
    docs = documents([r for r in AWKWARD if r[0] != 5] + [(5, "word " * 30000, "en"), (6, "word " * 50, None)])
    got = _digests(repeats.judge(docs))
    assert got[1][:3] == (0, 0, 0) and got[5][0] - got[5][1] == 5 and got[6][1] == 250
    assert len(repeats.judge(documents(AWKWARD)).collect()) == len(AWKWARD)
    assert repeats.judge(docs.limit(0)).count() == 0
    assert {r["text"] for r in repeats.cut(docs).where("doc_id = 1").collect()} == {None}


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    for _ in range(60):
        strings = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 3, 20]), rng.randint(0, 40)
            s = [rng.randint(1, k) for _ in range(n)]
            strings.append(((s[:3] * 40)[:n] if rng.random() < 0.3 else s) + [0])
        start = np.cumsum([0] + [len(s) for s in strings])
        got = suffixes.suffix_arrays(np.array(sum(strings, [])), start)
        for s, a, b in zip(strings, start, start[1:]):
            assert [x - a for x in got[a:b]] == sorted(range(len(s)), key=lambda i: s[i:])


# --- decontamination ------------------------------------------------------------------------------------------------
def brute_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_planted(spark, documents):
    rng = random.Random(3)
    vocab = [f"v{i}é" for i in range(40)] + ["Ab", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(25)) for i in range(12)] + [(20, text(3)), (21, "x1"), (22, ""), (23, None), (24, "..."), (3, None), (25, text(10))]
    items.append((26, items[0][1]))
    rows = [(i, text(30) + ", " + " ".join(items[i % 12][1].split()[5:5 + 8 + i % 6]) + "; " + text(9), "en") for i in range(40)]
    rows += [(50, None, None), (51, "", None), (52, items[0][1], None), (53, "AB", None)]
    bench = spark.createDataFrame([(a, b, 1, "x") for a, b in items], "item_id long, text string, _row int, fp string")
    got = {r["doc_id"]: tuple(r)[2:] for r in decontaminate.contamination(documents(rows), bench).collect()}
    assert got == brute_contamination([(a, b) for a, b, _ in rows], items)
    clean = decontaminate.drop_contaminated(documents(rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {k for k, v in got.items() if not v[-1]}


def test_contamination_awkward_rows(spark, documents):
    bench = spark.createDataFrame([(1, "word word word word word word word word word word"), (None, "a")], "item_id long, text string")
    docs = documents(AWKWARD)
    rows = decontaminate.contamination(docs, bench).collect()
    assert len(rows) == len(AWKWARD)
    assert [r["n_hit"] for r in rows if r["doc_id"] == 5] == [30000, 30000]
    assert [(r["n_hit"], r["n_items"]) for r in rows if r["doc_id"] == 4] == [(1, 1)]
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(AWKWARD) and not any(r["contaminated"] for r in none)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


# --- URL filter -----------------------------------------------------------------------------------------------------
PAGES = "page_id long, url string, html string, host string, rules int"


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.net", "net/", None, "ftp://x.net?/en/", "http://example.com/de/1", "http://notexample.com/de/",
            "http://b.org/fr/", "http://borg/fr/", "http://é.example.com#/de/", "://", "x://y://z/fr/", "http://deep.a.org/fr/", "http://net/", "http://net"]
    pages = spark.createDataFrame([(i, u, "", "h", 1) for i, u in enumerate(urls)], PAGES)
    rules = spark.sql("select * from values ('block','net','/'),('allow','example.net','/en/'),('block','example.com','/de/'),('allow','org','/fr/') as t(verdict, host, path)")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {0: ("a.example.net", "/en/x", "example.net/en/"), 1: ("example.net", "", None), 2: ("", "", None), 3: ("", "", None),
                   4: ("x.net", "", None), 5: ("example.com", "/de/1", "example.com/de/"), 6: ("notexample.com", "/de/", None),
                   7: ("b.org", "/fr/", "org/fr/"), 8: ("borg", "/fr/", None), 9: ("é.example.com", "", None), 10: ("", "", None),
                   11: ("y:", "//z/fr/", None), 12: ("deep.a.org", "/fr/", "org/fr/"), 13: ("net", "/", "net/"), 14: ("net", "", None)}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_link_graph_spreads_trust_forward_and_distrust_backward(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)
    pages = [(1, "http://good.aa/ok/", link("friend.bb")), (2, "http://friend.bb/", link("friend2.cc")), (3, "http://friend2.cc/", ""),
             (4, "http://bad.dd/no/", ""), (5, "http://shill.ee/", link("bad.dd") * 3), (6, "http://shill2.ff/", link("shill.ee")), (7, "http://alone.gg/", None)]
    pages = spark.createDataFrame([(*p, "h", 1) for p in pages], PAGES)
    rules = spark.sql("select * from values ('allow','good.aa','/ok/'),('block','bad.dd','/no/') as t(verdict, host, path)")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, rules).collect()}
    assert got[2]["trust"] > got[3]["trust"] > 0 == got[2]["distrust"]
    assert got[5]["distrust"] > got[6]["distrust"] > 0 == got[5]["trust"]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5, 7)] == ["allow", "allow", "allow", "block", "block", "allow"]


def test_link_graph_verdicts_hold_when_every_page_repeats(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)
    rng = random.Random(5)
    pages = [(i, f"http://h{i % 7}.d{i % 3}.aa/{rng.choice(['ok', 'no', 'x', 'y'])}/", link(*(f"h{rng.randrange(7)}.d{rng.randrange(3)}.aa" for _ in range(3))))
             for i in range(90)]
    rules = spark.sql("select * from values ('allow','aa','/ok/'),('block','aa','/no/') as t(verdict, host, path)")
    once, often = ({r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(spark.createDataFrame(
        [(*p, "h", 1) for p in pages * times], PAGES), rules).collect()} for times in (1, 3))
    assert once == often and any(v[-1] for v in once.values()) and any(v[-2] for v in once.values())


def test_link_graph_passes_mass_through_a_hub(spark):
    """A hub of 2,000,000 edges passes its mass on to all of them (too many to broadcast: the merged form)."""
    wide = 2_000_000
    hub = spark.range(wide).selectExpr("'hub' as src", "concat('leaf', id) as dst", "1L as n")
    mass = urlfilter.propagate(hub, spark.createDataFrame([("hub", "t", urlfilter.MASS)], "host string, kind string, s long"))
    leaf = mass.where("host like 'leaf%'").selectExpr("count(*)", "min(m)", "max(m)").first()
    assert leaf[0] == wide and 0 <= urlfilter.MASS * 85 // 100 // wide * 15 // 100 - leaf[1] <= 2 and leaf[1] == leaf[2]


def test_link_graph_follows_a_chain_of_20_hosts(spark):
    chain = spark.range(20).selectExpr("concat('c', id) as src", "concat('c', id + 1) as dst", "1L as n")
    mass = urlfilter.propagate(chain, spark.createDataFrame([("c0", "t", urlfilter.MASS)], "host string, kind string, s long"))
    got = {r["host"]: r["m"] for r in mass.collect()}
    assert all(abs(got[f"c{i}"] - 0.15 * 0.85 ** i * urlfilter.MASS) < 40 for i in range(20)) and got["c20"] > 0


def test_url_rules_of_equal_length_and_evidence_below_half(spark):
    rules = spark.sql("select * from values ('block','a.bb','/x/'),('allow','bb','/yy/x'),('allow','a.bb','/x/') as t(verdict, host, path)")
    pages = spark.createDataFrame([(1, "http://a.bb/x/", "", "h", 1)], PAGES)
    assert urlfilter.judge(pages, rules).first()["verdict"] == "allow"  # the one that sorts first
    rules = spark.sql("select * from values ('block','bad.dd','/no/') as t(verdict, host, path)")
    rows = [(1, "http://bad.dd/no/")] + [(i, f"http://bad.dd/p{i}") for i in range(2, 12)] + [(i, f"http://h{i}.ee/") for i in range(12, 40)]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame([(*r, "", "h", 1) for r in rows], PAGES), rules).collect()}
    assert got[2]["verdict"] == "block" and got[2]["distrust"] > 0 and got[20]["verdict"] == "allow"  # one page of eleven is evidence


# --- top-k ----------------------------------------------------------------------------------------------------------
def brute_top(rows, k):
    out = {}
    whole = [(n, i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for n, (i, v) in enumerate(rows)]
    for n, i, q in whole:
        if i % 20 == 0:
            s = sorted((-int(q @ c), j) for m, j, c in whole if m != n)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def test_top_k_with_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.1 * rng.normal(size=6)).round(2).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]
    bad = [(601, None), (602, [1.0, None, 0, 0, 0, 0]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (None, rows[1][1])]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows + bad],
                               "vec_id long, embedding array<float>, label int, _row string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 20)
    few = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [r["rank"] for r in few] == [1, 2] and topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(2).normal(size=(500, 5)).round(1)
    t = topk.build_tree(x)
    assert sorted(t["order"].tolist()) == list(range(500))
    for lo, hi, centre, radius in zip(t["lo"], t["hi"], t["centre"], t["radius"]):
        assert np.sqrt(((x[t["order"][lo:hi]] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9


# --- pipeline -------------------------------------------------------------------------------------------------------
def test_pipeline_matches_brute_force(spark, small_texts):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    prototypes = language.learn_prototypes(docs.where(crc_mod("doc_id", 5) != 0))
    names, units = language._units(prototypes)
    ids = sorted(small_texts)
    langs, score = language.judge([small_texts[i] for i in ids], names, units)
    rows = [(i, small_texts[i]) for i, x, s in zip(ids, langs, score) if x != "und" and s >= corpus_pipeline.LEAST_COSINE]
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    seen, cut = set(), []
    for i, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(raw[s:s + 100])
        away = np.cumsum(gone)[:len(raw)] > 0
        cut.append((i, bytes(b for b, c in zip(raw, away) if not c).decode("utf-8", "ignore")))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    judged = brute_contamination(cut, items)
    left = {i: t for i, t in cut if not judged[i][-1]}
    _check_packing(corpus_pipeline.run(spark, SF_SMALL).collect(), left, 1024)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    assert tokenizer()[0].endswith("byte_bpe_50k.json")


def test_pipeline_stages_on_awkward_rows(spark, documents):
    docs = documents(AWKWARD).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF_SMALL).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= 1
