"""Exact removal of repeated passages with suffix arrays (linear grouping construction, see ``suffixes``).

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller doc_id, or
earlier in the same one.  Windows (strings of LENGTH bytes) are compared as follows.

1. Winnowing splits each text into segments: runs of windows whose smallest K-byte hash is the same spot, the anchor.
   Equal windows have equal anchors at equal places, so only segments whose anchor hash occurs twice can hold repeats.
   Counting anchors is pre-aggregated; segments join the shared anchors.
2. Segments with the same bytes are one: all but the first go whole.  That settles copies, whatever their number.
3. First segments whose anchor has different surroundings elsewhere are sorted: the bytes of each anchor's segments form one
   string, its suffix array puts equal windows next to each other, and all but the earliest of a class go.
4. An anchor with more than GROUP different segments (a short common line, say) is split first: by the bytes that
   PIECE neighbouring windows share, counted from the anchor; what still has more than GROUP is sorted in parts, and
   the earliest window of each class of a part is compared across parts by a 128-bit hash.  No group grows with the corpus.

Defined cases: a null text counts as empty; texts under LENGTH bytes keep everything; matches never cross texts; a
null doc_id comes before all others; rows with the same doc_id are ordered by row; an empty table gives no rows; other
columns are ignored (``cut`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, broadcast_if_small, keyed, list_column, slices, stored
from edgelog.llm.suffixes import suffix_arrays
from edgelog.llm.textops import Powers, byte_values, int64, mix, prefix_sums, sliding_min, spans_hash

LENGTH, K = 100, 32
GROUP, PIECE = 8, 8
SORT_BYTES = 1 << 19
STRETCH = 1 << 21
U = np.uint64


def segments(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, powers: Powers):
    """(text, first window, number of windows, anchor place, anchor hash) of all segments; places count in ``data``.

    A stretch of STRETCH window starts at a time, so a very long text needs no more memory than others.
    """
    w = LENGTH - K + 1
    out = []
    _, down = powers.need(len(sums))
    ending = np.repeat(offsets[1:] - LENGTH, np.diff(offsets))  # the last window of the text at each byte
    for begin in range(0, max(len(data) - LENGTH + 1, 0), STRETCH):
        stop = min(begin + STRETCH, len(data) - LENGTH + 1)  # windows begin .. stop - 1
        n = stop - begin + w - 1
        h = (sums[begin + K: begin + K + n] - sums[begin: begin + n]) * down[begin: begin + n]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(29)
        low = sliding_min(h, w)
        valid = np.arange(begin, stop) <= ending[begin:stop]
        fresh = np.ones(stop - begin, bool)
        fresh[1:] = (low[1:] != low[:-1]) | ~valid[:-1]  # between two texts stand windows that are not valid
        first = np.flatnonzero(fresh & valid)
        if not len(first):
            continue
        borders = np.append(np.flatnonzero(fresh | ~valid), stop - begin)
        last = borders[np.searchsorted(borders, first, side="right")]  # one behind
        equal = h[first[:, None] + np.arange(w)] == low[first][:, None]
        anchor = first + equal.argmax(axis=1)
        plain = last - 1 <= anchor
        parts = [(first[plain], last[plain], anchor[plain])]
        extra = []
        for a, e in zip(first[~plain], last[~plain]):  # the smallest hash occurs again inside the run: the leftmost one counts
            for p in a + np.flatnonzero(h[a: e + w - 1] == low[a]):
                extra.append((a, min(p + 1, e), p))
                a = p + 1
                if a >= e:
                    break
        if extra:
            parts.append(tuple(np.array(x) for x in zip(*extra)))
        a, e, p = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(a, kind="stable")
        a, e, p = a[order], e[order], p[order]
        out.append((np.searchsorted(offsets, a + begin, side="right") - 1, a + begin, e - a, p + begin, h[p]))
    if not out:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors(batches):
    """The anchor hash of every segment."""
    powers, values = Powers(), byte_values(3)
    for _, data, offsets in slices(batches):
        anchor = segments(data, offsets, prefix_sums(data, values, powers), powers)[4]
        yield pa.RecordBatch.from_arrays([pa.array(int64(anchor))], ["anchor"])


def _segments(batches):
    """anchor, hash of the segment's bytes, document order (o, node), first window, anchor's distance, number of windows."""
    powers, values = Powers(), byte_values(3)
    for rows, data, offsets in slices(batches):
        sums = prefix_sums(data, values, powers)
        text, at, m, p, anchor = segments(data, offsets, sums, powers)
        ctx = spans_hash(sums, at, at + m + LENGTH - 1, powers)
        node, o = (rows.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(int64(anchor)), pa.array(int64(ctx)), pa.array(o), pa.array(node), pa.array(at - offsets[text]),
             pa.array((p - at).astype(np.int16)), pa.array(m.astype(np.int16))], ["anchor", "ctx", "o", "node", "at", "rel", "m"])


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _piece_bounds(s0: np.ndarray, m: np.ndarray, p: np.ndarray):
    """Cut segments (first window, number of windows, anchor) into pieces of windows whose distance to the anchor has one
    quotient by PIECE: (segment, quotient, first window, number of windows, begin of the bytes that all of them share)."""
    low, high = np.maximum(p - (s0 + m - 1), 0) // PIECE, (p - s0) // PIECE
    count = high - low + 1
    seg = np.repeat(np.arange(len(s0)), count)
    j = _runs(low, count)
    a, b = np.maximum(s0[seg], p[seg] - PIECE * j - PIECE + 1), np.minimum(s0[seg] + m[seg], p[seg] - PIECE * j + 1)
    return seg, j, a, b - a, p[seg] - PIECE * j


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Arrow binaries of runs of ``data``."""
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[_runs(start, size)])])


def _snippets(batches):
    """Bytes of the wanted segments; those of crowded anchors in pieces keyed by the bytes that the piece's windows share."""
    powers, values = Powers(), byte_values(3)
    for rows, data, offsets in slices(batches):
        sums = prefix_sums(data, values, powers)
        wanted = rows.column(rows.schema.get_field_index("wanted"))
        owner = np.repeat(np.arange(rows.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
        x = {f.name: a.to_numpy(zero_copy_only=False).astype(np.int64) for f, a in zip(wanted.type.value_type, wanted.flatten().flatten())}
        node, o = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[owner] for c in ("_row", "o"))
        s0 = offsets[owner] + x["at"]
        crowded = np.flatnonzero(x["n"] > GROUP)
        plain = np.flatnonzero(x["n"] <= GROUP)
        seg, j, a, m, begin = _piece_bounds(s0[crowded], x["m"][crowded], s0[crowded] + x["rel"][crowded])
        seg = crowded[seg]
        shared = spans_hash(sums, begin, begin + LENGTH - PIECE + 1, powers) if len(seg) else np.zeros(0, U)
        keys = mix(shared + x["anchor"][seg].view(U) * U(3) + j.astype(U))
        at = np.concatenate([s0[plain], a])
        m = np.concatenate([x["m"][plain], m])
        source = np.concatenate([plain, seg])
        rel = np.concatenate([x["rel"][plain], np.zeros(len(seg), np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x["anchor"][plain], int64(keys)])), pa.array(np.arange(len(at)) >= len(plain)), pa.array(o[source]),
             pa.array(node[source]), pa.array(at - offsets[owner[source]]), pa.array(rel.astype(np.int16)), pa.array(m.astype(np.int16)),
             _binary(data, at, m + LENGTH - 1)], ["key", "crowded", "o", "node", "at", "rel", "m", "snippet"])


def repeated_windows(snippets: list[bytes], counts: np.ndarray, group: np.ndarray, powers: Powers, values: np.ndarray):
    """(snippet number, window, True where an equal window stands before it in the group, 128-bit hash parts of the window).

    ``group`` numbers the groups of consecutive snippets, which are in document order; ``counts`` are their windows.
    """
    sizes = np.array([len(x) for x in snippets])
    begin = np.cumsum(sizes + 1) - sizes - 1  # every snippet is followed by a separator
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    x = raw.astype(np.int64) + 2
    ends = begin + sizes
    x[ends] = 1
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    x[ends[last]] = 0  # the group's end
    start = np.concatenate([[0], ends[last] + 1])
    order = suffix_arrays(x, start)
    snippet = np.repeat(np.arange(len(snippets)), sizes + 1)
    place = np.arange(len(x)) - begin[snippet]
    window = place < counts[snippet]
    order = order[window[order]]
    same = np.zeros(len(order), bool)  # equal to the window before it in the suffix array
    here, before = order[1:], order[:-1]
    alike = np.flatnonzero((x[here] == x[before]) & (group[snippet[here]] == group[snippet[before]]))
    alike = alike[(raw[here[alike][:, None] + np.arange(LENGTH)] == raw[before[alike][:, None] + np.arange(LENGTH)]).all(axis=1)]
    same[alike + 1] = True
    cls = np.cumsum(~same) - 1
    earliest = np.full(int(cls[-1]) + 1 if len(cls) else 0, len(x))
    np.minimum.at(earliest, cls, order)
    gone = order != earliest[cls]
    sums = prefix_sums(raw, values, powers)
    h1 = spans_hash(sums, order, order + LENGTH, powers)
    h2 = mix(spans_hash(sums, order, order + LENGTH // 2, powers) * U(0x9FB21C651E98DF25) + spans_hash(sums, order + LENGTH // 3, order + LENGTH, powers))
    return snippet[order], place[order], gone, h1, h2


def _promising(snippets: list[bytes], m: np.ndarray, rel: np.ndarray, group: np.ndarray, crowded: np.ndarray, powers: Powers, values: np.ndarray):
    """Cut the segments down to windows in pieces whose shared bytes occur twice in the group (pieces of crowded anchors have
    been chosen so before and stay): (bytes, which snippet, windows skipped, number of windows)."""
    raw = np.frombuffer(b"".join(snippets), np.uint8)
    sizes = np.array([len(x) for x in snippets])
    begin = np.cumsum(sizes) - sizes
    open_ = np.flatnonzero(~crowded)
    seg, j, a, n, shared = _piece_bounds(begin[open_], m[open_], begin[open_] + rel[open_])
    seg = open_[seg]
    h = spans_hash(prefix_sums(raw, values, powers), shared, shared + LENGTH - PIECE + 1, powers)
    _, which, times = np.unique(mix(h + j.astype(U)) ^ mix(group[seg].astype(U) + U(1)), return_inverse=True, return_counts=True)
    twice = times[which] > 1
    seg, a, n = seg[twice], a[twice], n[twice]
    order = np.lexsort((a, seg))
    seg, a, n = seg[order], a[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (a[1:] != a[:-1] + n[:-1])])) if len(seg) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(seg)) - 1
    seg, first, last = seg[head], a[head], a[tail] + n[tail] if len(seg) else a
    whole = np.flatnonzero(crowded)
    source = np.concatenate([seg, whole])
    first = np.concatenate([first, begin[whole]])
    count = np.concatenate([last - first[: len(seg)], m[whole]])
    order = np.lexsort((first, source))
    source, first, count = source[order], first[order], count[order]
    data = raw.tobytes()
    return [data[f: f + c + LENGTH - 1] for f, c in zip(first.tolist(), count.tolist())], source, first - begin[source], count


def _sort_groups(batches):
    """Suffix-sorts the groups (key, part) of a sorted partition, about SORT_BYTES at a time.

    Rows out: runs of windows to remove (h1 null), and for groups that are parts the windows that stay (from, with hash).
    """
    powers, values = Powers(), byte_values(5)

    def flush(rows: list[tuple]):
        ids = np.array([(r[0], r[1]) for r in rows])
        group = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))]) if len(rows) > 1 else np.zeros(len(rows), np.int64)
        m, rel = (np.array([r[i] for r in rows], np.int64) for i in (6, 8))
        snippets, source, skipped, m = _promising([r[7] for r in rows], m, rel, group, np.array([r[9] for r in rows], bool), powers, values)
        o, node, at = (np.array([r[i] for r in rows], np.int64)[source] for i in (3, 4, 5))
        at = at + skipped
        split = np.array([r[2] for r in rows], bool)[source]
        if not snippets:
            return None
        snippet, window, gone, h1, h2 = repeated_windows(snippets, m, group[source], powers, values)
        out = {k: [] for k in ("o", "node", "from", "to")}
        a, b = snippet[gone], window[gone]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1] + 1)])) if len(a) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(a)) - 1
        a, begin, end = a[head], b[head], b[tail] + LENGTH
        stay = ~gone & split[snippet]
        c, w = snippet[stay], window[stay]
        out["o"], out["node"] = np.concatenate([o[a], o[c]]), np.concatenate([node[a], node[c]])
        out["from"] = np.concatenate([at[a] + begin, at[c] + w])
        out["to"] = np.concatenate([at[a] + end, at[c] + w + LENGTH])
        none = np.arange(len(a) + len(c)) < len(a)
        arrays = [pa.array(v) for v in out.values()]
        for h in (h1, h2):
            arrays.append(pa.array(np.concatenate([np.zeros(len(a), np.int64), int64(h[stay])]), pa.int64(), mask=none))
        return pa.RecordBatch.from_arrays(arrays, [*out, "h1", "h2"])

    rows: list[tuple] = []
    size, names = 0, ("key", "part", "split", "o", "node", "at", "m", "snippet", "rel", "crowded")
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
            if size >= SORT_BYTES and row[:2] != rows[-1][:2]:
                if (out := flush(rows)) is not None:
                    yield out
                rows, size = [], 0
            rows.append(row)
            size += len(row[7])
    if rows and (out := flush(rows)) is not None:
        yield out


def _merge(batches):
    """Union of each document's spans."""
    for b in batches:
        out_from, out_to, per = [], [], []
        for spans in b.column(1).to_pylist():
            spans.sort(key=lambda s: (s["from"], s["to"]))
            merged: list[list[int]] = []
            for s in spans:
                if merged and s["from"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["to"])
                else:
                    merged.append([s["from"], s["to"]])
            per.append(len(merged))
            out_from += [x for x, _ in merged]
            out_to += [x for _, x in merged]
        yield pa.RecordBatch.from_arrays([b.column(0), list_column(np.array(out_from, np.int64), np.array(per), pa.int64()),
                                          list_column(np.array(out_to, np.int64), np.array(per), pa.int64())], ["node", "begins", "ends"])


def _ordered(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"), F.coalesce("text", F.lit("")).alias("text"))


def removed_spans(docs: DataFrame, key: str = "_row") -> DataFrame:
    """Stored (node, begins, ends): disjoint byte spans to remove, ascending, of every row that has any.  ``node`` is the
    row's stored column ``key``."""
    bounded_batches(docs.sparkSession)
    rows = _ordered(docs, key)
    shared = stored(rows.select("text").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
                    .where("n > 1").select("anchor"), "anchors")
    found = rows.mapInArrow(_segments, "anchor long, ctx long, o long, node long, at long, rel smallint, m smallint")
    held = stored(found.join(shared, "anchor"), "segments")
    spot = F.struct("o", "node", "at")
    firsts = stored(held.groupBy("anchor", "ctx").agg(F.min(F.struct("o", "node", "at", "rel", "m")).alias("f"), F.count("*").alias("copies")), "contexts")
    copies = firsts.where("copies > 1").select("anchor", "ctx", F.struct("f.o", "f.node", "f.at").alias("first"))
    spans = [held.join(copies, ["anchor", "ctx"]).where(spot != F.col("first"))
             .select("node", F.col("at").alias("from"), (F.col("at") + F.col("m") + (LENGTH - 1)).alias("to"))]

    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    open_ = firsts.join(several, "anchor").select("anchor", "f.*", "n")
    wanted = stored(open_.groupBy("node").agg(F.collect_list(F.struct("anchor", "at", "rel", "m", "n")).alias("wanted")), "wanted")
    n_wanted = wanted.count()
    some = rows.join(broadcast_if_small(wanted.select(F.col("node").alias("_row")), n_wanted, 16), "_row", "left_semi")
    texts = some.join(wanted, F.col("_row") == F.col("node")).select("_row", "o", "text", "wanted")
    bits = stored(texts.mapInArrow(_snippets, "key long, crowded boolean, o long, node long, at long, rel smallint, m smallint, snippet binary"), "snippets")

    pieces = bits.where("crowded")
    kept = stored(pieces.groupBy("key", "snippet").agg(F.min(F.struct("o", "node", "at", "m")).alias("f"), F.count("*").alias("copies")), "pieces")
    again = kept.where("copies > 1").select("key", "snippet", F.struct("f.o", "f.node", "f.at").alias("first"))
    spans.append(pieces.join(again, ["key", "snippet"]).where(spot != F.col("first"))
                 .select("node", F.col("at").alias("from"), (F.col("at") + F.col("m") + (LENGTH - 1)).alias("to")))
    crowd = kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    split = kept.join(crowd, "key").select(
        "key", F.pmod(F.xxhash64("snippet"), F.ceil(F.col("n") / GROUP)).cast("int").alias("part"), (F.col("n") > GROUP).alias("split"),
        "f.o", "f.node", "f.at", "f.m", "snippet", F.lit(0).cast("smallint").alias("rel"), F.lit(True).alias("crowded"))
    plain = bits.where("not crowded").select("key", F.lit(0).alias("part"), F.lit(False).alias("split"), "o", "node", "at", "m", "snippet", "rel", "crowded")
    groups = plain.unionByName(split).repartition("key", "part").sortWithinPartitions("key", "part", "o", "node", "at")
    ranked = stored(groups.mapInArrow(_sort_groups, "o long, node long, `from` long, `to` long, h1 long, h2 long"), "sorted")
    spans.append(ranked.where("h1 is null").select("node", "from", "to"))
    rest = ranked.where("h1 is not null")
    classes = (rest.groupBy("h1", "h2").agg(F.min(F.struct("o", "node", "from")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    spans.append(rest.join(classes, ["h1", "h2"]).where(F.struct("o", "node", "from") != F.col("first")).select("node", "from", "to"))

    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    by_node = every.groupBy("node").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return stored(by_node.mapInArrow(_merge, "node long, begins array<bigint>, ends array<bigint>"), "spans")


def _kept(raw: bytes, begins, ends) -> bytes:
    out, at = [], 0
    for b, e in zip(begins or (), ends or ()):
        out.append(raw[at:b])
        at = e
    return b"".join([*out, raw[at:]])


def _digest(batches):
    for b in batches:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for doc, text, begins, ends in zip(*(b.column(i).to_pylist() for i in range(4))):
            raw = (text or "").encode()
            kept = _kept(raw, begins, ends)
            for k, v in zip(out, (doc, len(raw), len(raw) - len(kept), len(begins or ()), hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()], list(out))


ROW, NODE, BEGINS, ENDS = "__cut_row", "__cut_node", "__cut_begins", "__cut_ends"  # beside any columns of the input


def _with_spans(docs: DataFrame, columns: list) -> DataFrame:
    rows = keyed(docs.select(*columns), ROW)
    spans = removed_spans(rows, ROW).toDF(NODE, BEGINS, ENDS)
    size = spans.agg(F.count("*").alias("n"), F.sum(F.size(BEGINS)).alias("m")).first()
    return rows.join(broadcast_if_small(spans, size["n"] * 3 + (size["m"] or 0), 16), F.col(ROW) == F.col(NODE), "left").drop(ROW, NODE)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _with_spans(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"]).mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes cut out of ``text``; a character of which only a part
    is left goes too.  A whole-number column n_chars gets the new length."""
    names = docs.columns

    def run(batches):
        for b in batches:
            at = {n: b.schema.get_field_index(n) for n in (*names, BEGINS, ENDS)}
            texts = []
            for text, begins, ends in zip(*(b.column(at[n]).to_pylist() for n in ("text", BEGINS, ENDS))):
                texts.append(_kept(text.encode(), begins, ends).decode("utf-8", "ignore") if begins else text)
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in at and pa.types.is_int64(b.schema.field(at["n_chars"]).type):
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(at[n])) for n in names], names)

    return _with_spans(docs, names).mapInArrow(run, docs.schema)
