"""Near-duplicate classes by BagMinHash over word shingles.

A text is the bag of its runs of SHINGLE words.  Each shingle has a Poisson process in time over weights and registers,
seeded by the shingle; the weight axis is cut into dyadic cells (0, 1], (1, 2], (2, 4], ... with a process each, and a
text sees the points below its count of the shingle.  A register keeps the earliest point that any shingle puts there, so
two texts agree in a register with exactly the probability of their weighted Jaccard similarity.  Points later than
the text's last register can't matter, so only about REGISTERS * (ln REGISTERS + 8) points are made per text, however
long it is; texts with an empty register left are repeated with twice the time.

BANDS bands of BAND_ROWS registers: at similarity 0.8 a pair shares no bucket with probability 3e-6.  Equal texts are
one node.  Inside a bucket, members are compared with one leader at a time (a row per member, never all pairs), with exact
bag overlaps; linked texts form components.  Members of buckets that still hold several classes are then compared across
classes, bucket by bucket, so no link of a shared bucket is lost to the choice of leaders; while very many such pairs
are left, other leaders are tried before.

Defined cases: a null text counts as empty; texts with fewer than SHINGLE words are one shingle of all their words;
texts without words are alike only when equal; a class is named by its smallest doc_id (null if all are null) and keeps
its first row; repeated ids stay separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, broadcast_if_small, keyed, list_column, slices, stored
from edgelog.llm.components import components
from edgelog.llm.textops import Powers, byte_values, int64, lower_table, mix, ngrams, prefix_sums, words, words_hash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 4
REGISTERS = BANDS * BAND_ROWS
HASH_BITS = 48
LEADER_ROUNDS = 2
ENOUGH = 100  # cross-class pairs per open member at which leaders have done their work
BLOCK = 256
U = np.uint64


def shingle_bags(data: np.ndarray, offsets: np.ndarray, powers: Powers, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of all texts, sorted by text and hash."""
    n = len(offsets) - 1
    start, end, text = words(data, offsets)
    hashes = words_hash(data, prefix_sums(data, values, powers), start, end, powers)
    own, grams = [], []
    g = ngrams(hashes, SHINGLE)
    inside = text[: len(g)] == text[SHINGLE - 1:] if len(g) else np.zeros(0, bool)
    own.append(text[: len(g)][inside])
    grams.append(g[inside])
    counts = np.bincount(text, minlength=n)
    first = np.cumsum(counts) - counts
    for k in range(1, SHINGLE):
        short = np.flatnonzero(counts == k)
        own.append(short)
        grams.append(ngrams(hashes, k)[first[short]])
    key = np.sort(np.concatenate(own).astype(U) << U(HASH_BITS) | np.concatenate(grams) >> U(64 - HASH_BITS))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> U(HASH_BITS)).astype(np.int64), key[at] & U((1 << HASH_BITS) - 1), np.diff(np.append(at, len(key)))


def _unit(r: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from the top 53 bits."""
    return ((r >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """REGISTERS values per text; texts without shingles have zeros."""
    out = np.zeros((n, REGISTERS), U)
    total = np.bincount(text, weight, n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = (np.log(REGISTERS) + 8) / total[todo]
    while len(todo):
        pick = np.isin(text, todo) if len(todo) < n else np.ones(len(text), bool)
        own, h, w = text[pick], shingle[pick], weight[pick]
        # one entry per shingle and dyadic weight cell that it reaches into
        cells = np.ceil(np.log2(w)).astype(np.int64) + 1
        entry = np.repeat(np.arange(len(h)), cells)
        level = np.arange(len(entry)) - np.repeat(np.cumsum(cells) - cells, cells)
        own, w = own[entry], w[entry]
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        length = np.where(level > 0, low, 1)
        seed = mix(h[entry] * U(0x9E3779B97F4A7C15) + level.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(7))
        limit, rate = reach[own], length * float(REGISTERS)
        at, time, step = np.arange(len(own)), np.zeros(len(own)), 0
        earliest = np.full(n * REGISTERS, np.inf)
        points = []
        while len(at):
            step += 1
            r = mix(seed[at] + U(step * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            time = time - np.log(_unit(r)) / rate[at]
            live = time <= limit[at]
            at, time, r = at[live], time[live], r[live]
            r2 = mix(r ^ U(0xA5A5A5A55A5A5A5A))
            register = ((r2 >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
            cell = low[at] + 1 + ((r2 & U(0xFFFFFFFF)) * length[at].astype(U) >> U(32)).astype(np.int64)
            seen = cell <= w[at]
            slot = own[at[seen]] * REGISTERS + register[seen]
            np.minimum.at(earliest, slot, time[seen])
            points.append((slot, time[seen], r[seen]))
        slot, time, r = (np.concatenate(x) for x in zip(*points))
        first = time == earliest[slot]
        flat = np.zeros(n * REGISTERS, U)
        flat[slot[first]] = r[first]
        full = np.isfinite(earliest).reshape(n, REGISTERS).all(axis=1)
        done = todo[full[todo]]
        out[done] = flat.reshape(n, REGISTERS)[done]
        todo = todo[~full[todo]]
        reach[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = signature.reshape(len(signature), BANDS, BAND_ROWS)
    key = np.broadcast_to((np.arange(BANDS, dtype=U) + U(1)) * U(0xD6E8FEB86659FD93), rows.shape[:2])
    for i in range(BAND_ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key


def _sign(batches):
    """_row, doc_id, text class, total weight, band keys (none for a text without words)."""
    powers, values, lower = Powers(), byte_values(), lower_table()
    for rows, data, offsets in slices(batches):
        text, shingle, weight = shingle_bags(lower[data], offsets, powers, values)
        total = np.bincount(text, weight, rows.num_rows)
        some = total > 0
        keys = band_keys(signatures(text, shingle, weight, rows.num_rows)[some])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), rows.column(2), pa.array(total.astype(np.int64)),
             list_column(int64(np.ascontiguousarray(keys)).ravel(), some * BANDS, pa.int64())], ["_row", "doc_id", "cls", "weight", "bands"])


def _bags(batches):
    """Row key, shingles (sorted) and counts."""
    powers, values, lower = Powers(), byte_values(), lower_table()
    for rows, data, offsets in slices(batches):
        text, shingle, weight = shingle_bags(lower[data], offsets, powers, values)
        per = np.bincount(text, minlength=rows.num_rows)
        yield pa.RecordBatch.from_arrays([rows.column(0), list_column(int64(shingle), per, pa.int64()),
                                          list_column(weight, per, pa.int32())], ["node", "shingles", "counts"])


def bag_similarity(sa: np.ndarray, ca: np.ndarray, sb: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags given as sorted distinct shingles with counts."""
    _, i, j = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / max(int(ca.sum()) + int(cb.sum()) - both, 1)


def _verify(similarity: float):
    def run(batches):
        for b in batches:
            cols = [b.column(n) for n in ("sa", "ca", "sb", "cb")]
            flat = [c.flatten().to_numpy() for c in cols]
            ends = [c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py() for c in cols]
            keep = [bag_similarity(*(f[e[i]: e[i + 1]] for f, e in zip(flat, ends))) >= similarity for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose bags overlap enough."""
    left = bags.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(_verify(similarity), "a long, b long")


def _compare_block(similarity: float):
    """Links that join different classes among the members of one pair of blocks (or inside one)."""

    def run(rows: pa.Table) -> pa.Table:
        node, label, side = (rows[c].to_numpy() for c in ("node", "label", "side"))
        weight, inner = rows["weight"].to_numpy(), rows["i"][0].as_py() == rows["j"][0].as_py()
        a, b = np.nonzero(label[:, None] != label[None, :])
        wanted = (node[a] < node[b]) if inner else (side[a] < side[b])
        small, large = np.minimum(weight[a], weight[b]), np.maximum(weight[a], weight[b])
        wanted &= small >= similarity * large
        a, b = a[wanted], b[wanted]
        bags = [(np.array(s.as_py(), np.int64), np.array(c.as_py(), np.int64)) for s, c in zip(rows["shingles"], rows["counts"])]
        keep = np.zeros(len(a), bool)
        if len(a) < 300:
            keep[:] = [bag_similarity(*bags[x], *bags[y]) >= similarity for x, y in zip(a, b)]
        else:
            # the n-th copy of a shingle is an item of its own, so common items are what bags share; blocked products count them
            items = np.concatenate([np.repeat(s, c) for s, c in bags])
            nth = np.concatenate([_copies(c) for _, c in bags])
            owner = np.repeat(np.arange(len(bags)), [c.sum() for _, c in bags])
            column = np.unique(mix(items.view(U) * U(0x9E3779B97F4A7C15) + nth.astype(U)), return_inverse=True)[1]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            both = np.zeros((len(bags), len(bags)))
            for at in range(0, int(column[-1]) + 1, 4096):
                part = slice(*np.searchsorted(column, [at, at + 4096]))
                x = np.zeros((len(bags), 4096), np.float32)
                x[owner[part], column[part] - at] = 1
                both += x @ x.T
            keep = both[a, b] >= similarity * (weight[a] + weight[b] - both[a, b])
        # links that join classes which others here have joined already change nothing: one per join is enough
        of = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while of[x] != x:
                of[x] = x = of[of[x]]
            return x

        found = []
        for i in np.flatnonzero(keep):
            p, q = find(int(label[a[i]])), find(int(label[b[i]]))
            if p != q:
                of[p] = q
                found.append(i)
        first, second = np.minimum(node[a], node[b])[np.array(found, int)], np.maximum(node[a], node[b])[np.array(found, int)]
        return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})

    return run


def _copies(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for every count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _across_classes(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Every link between members of one bucket that are in different classes.

    A bucket is compared in one task; one of more than BLOCK members (``n``) is dealt by hash into blocks, and each pair
    of its blocks is a task.  No pair is a row, and no task holds more than two blocks.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    block, other = F.pmod(F.xxhash64("node"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (members.withColumn("blocks", blocks.cast("long")).withColumn("block", block).withColumn("other", other)
             .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "label", "weight"))
    return dealt.join(bags, "node").groupBy("bucket", "i", "j").applyInArrow(_compare_block(similarity), "a long, b long").distinct()


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after further links; only the classes that those connect change."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    for c in ("a", "b"):
        of = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        links = links.join(of, F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_l", c)).select("a", "b")
    moved = components(links).select(F.col("node").alias("was"), F.col("label").alias("now"))
    kept = labels.join(moved, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    fresh = moved.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return stored(kept.unionByName(fresh), "labels")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str | None = None) -> DataFrame:
    """Per row of ``docs``: _row (its stored column ``key``, or a key made here), doc_id, class_id (smallest doc_id of the class), class_row (its first row) and
    text_row (first row with an equal text)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")]
    rows = docs.select(F.col(key).alias("_row"), *columns) if key else keyed(docs.select(*columns))
    signed = stored(rows.select("_row", "doc_id", F.md5(F.col("text").cast("binary")).alias("cls"), "text")
                    .mapInArrow(_sign, "_row long, doc_id long, cls string, weight long, bands array<bigint>"), "signatures")
    # equal texts are one node, named by their first row, before anything is dealt by bucket
    nodes = signed.groupBy("cls").agg(F.min("_row").alias("node"), F.min("doc_id").alias("node_id"))
    first = signed.join(nodes.select(F.col("node").alias("_row")), "_row", "left_semi")
    buckets = first.select(F.col("_row").alias("node"), "weight", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(buckets.join(shared, "bucket"), "members")
    candidates = members.select("node").distinct()
    n_candidates = candidates.count()
    wanted = broadcast_if_small(candidates.select(F.col("node").alias("_row")), n_candidates, 16)
    bags = stored(rows.select("_row", "text").join(wanted, "_row", "left_semi")
                  .mapInArrow(_bags, "node long, shingles array<bigint>, counts array<int>"), "bags")

    def close(a: str, b: str):  # necessary for the similarity, and cheap
        return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)

    labels = None
    for turn in range(LEADER_ROUNDS + 1):
        labelled = members.withColumn("label", F.col("node")) if labels is None else \
            members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        lead = (labelled.groupBy("bucket").agg(
            F.min(F.struct(order.alias("o"), F.col("node").alias("leader"), F.col("weight").alias("w"), F.col("label").alias("l"))).alias("x"),
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
            .where("low != high").select("bucket", "x.leader", F.col("x.w").alias("lw"), F.col("x.l").alias("ll"), "n"))
        open_members = stored(labelled.join(lead, "bucket"), "open")
        # pairs across classes that are left in all buckets: n * n less the squares of the classes' sizes
        per_class = open_members.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.max("n").alias("n"))
        left = per_class.agg(F.sum(F.expr("k * (n - k)")).alias("p"), F.sum("k").alias("m")).first()
        if not left["m"]:
            break
        last = turn == LEADER_ROUNDS or turn > 0 and left["p"] <= ENOUGH * left["m"]
        if last:
            found = _across_classes(open_members, bags, similarity)
        else:
            pairs = (open_members.where((F.col("label") != F.col("ll")) & close("weight", "lw"))
                     .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
            found = _linked(pairs, bags, similarity)
        labels = _joined(labels, stored(found, "found"))
        if last:
            break
        members = open_members.select("bucket", "node", "weight")  # a bucket of one class stays one

    named = nodes.select("cls", "node", "node_id")
    if labels is not None:
        own = labels.join(nodes.select("node", "node_id"), "node")
        by_label = own.groupBy("label").agg(F.min("node_id").alias("class_id"))
        classes = own.select("node", "label").join(by_label, "label").select("node", F.col("label").alias("class_row"), "class_id")
        named = named.join(classes, "node", "left")
    else:
        named = named.withColumn("class_row", F.lit(None).cast("long")).withColumn("class_id", F.lit(None).cast("long"))
    named = named.select("cls", F.col("node").alias("text_row"), F.coalesce("class_id", "node_id").alias("class_id"),
                         F.coalesce("class_row", "node").alias("class_row"))
    return signed.select("_row", "doc_id", "cls").join(named, "cls").select("_row", "doc_id", "class_id", "class_row", "text_row")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first row of each class, all columns kept."""
    rows = keyed(docs, "__keep_row")
    gone = stored(near_duplicates(rows, similarity, "__keep_row").where("_row != class_row").select(F.col("_row").alias("__gone_row")), "gone")
    return rows.join(broadcast_if_small(gone, gone.count(), 16), rows["__keep_row"] == gone["__gone_row"], "left_anti").drop("__keep_row")
