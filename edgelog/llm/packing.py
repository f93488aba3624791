"""Best-fit packing of tokenised documents with exact-complement hashing.

Pieces of documents (at most ``capacity`` tokens) are put into as few sequences as possible.  Only how many pieces there
are of each length matters for the plan, so the driver plans on that histogram (at most ``capacity`` numbers):
lengths are taken from the longest down; the gap they leave is looked up among the available single lengths, then
pair sums, then triple sums, and combinations that fill it exactly are used up as often as the counts allow.  What
finds no exact complement is packed best-fit, longest first.  A plan entry says which rank of which length goes
where, so every task places its own pieces; ranks come from per-chunk counts, not from one task per length.

Defined cases: a null text is empty and yields the one closing token; repeated documents are packed each; a text of
any length is cut into whole sequences with the remainder first; an empty table gives no rows; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, row_key, stored, with_slots, worker_cache

CAPACITY = 1024
CLOSE = 2  # id that ends every document


class Encoder:
    """Byte-level BPE ids as the ``tokenizers`` library gives them for a vocabulary file.

    ``tokenizers`` itself encodes about 1.2 MB a CPU second of text with a long tail of rare words, tiktoken about 8
    with the same ids, so tiktoken runs on the vocabulary read from that file (ids follow the merge order there); a
    text that spells a special token, or that tiktoken can't handle, goes through ``tokenizers``.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # the printable stand-ins that byte-level vocabularies use for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        """The library itself, loaded by the first text that needs it (it takes as much memory as all the rest)."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text)
            except BaseException as e:  # the Rust side panics on some inputs, outside Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(path: str, pattern: str, capacity: int):
    def cut(batches):
        encoder = worker_cache(f"bpe:{path}", lambda: Encoder(path, pattern))
        for batch in batches:
            out = {k: [] for k in ("_row", "doc_id", "piece", "start", "length", "ids_crc32")}
            for row, doc, text in zip(*(batch.column(i) for i in range(3))):
                ids = np.append(encoder.ids(text.as_py() or ""), CLOSE).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[at: first if not at else at + capacity]
                    for name, v in zip(out, (row.as_py(), doc.as_py(), k, at, len(own), zlib.crc32(own.tobytes()))):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], list(out))

    return cut


def _exact(gap: int, left: list[int], most: int) -> list[int] | None:
    """Available lengths (at most ``most``) that add up to ``gap``: one, two or three of them, longest first."""
    if gap <= most and left[gap]:
        return [gap]
    free = np.array(left[: gap + 1]) > 0
    free[min(most, gap) + 1:] = False

    def pair(total: int, top: int) -> list[int] | None:
        if total < 2:
            return None
        a = np.arange(min(total - 1, top), (total - 1) // 2, -1)
        for x in a[free[a] & free[total - a]]:
            if x != total - x or left[x] > 1:
                return [int(x), int(total - x)]
        return None

    if found := pair(gap, most):
        return found
    for a in range(min(gap - 2, most), (gap - 1) // 3, -1):
        if left[a]:
            left[a] -= 1
            free[a] = left[a] > 0
            found = pair(gap - a, a)
            left[a] += 1
            free[a] = True
            if found:
                return [a, *found]
    return None


def plan(counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each) for a histogram: counts[l] pieces of length l.

    Complements of small pieces may use up what long pieces need, so the exact phase is planned down to each of a few
    least lengths (none: plain best-fit) and the plan of fewest sequences is taken, the one with most exact fits among equals."""
    plans = [_plan(counts, capacity, least) for least in (1, capacity // 4, capacity // 3, capacity // 2, 3 * capacity // 4, capacity)]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def _plan(counts: list[int], capacity: int, least: int) -> list[tuple[int, list[int]]]:
    """Exact complements for lengths from ``least`` up, the rest best-fit."""
    left, out = [*counts, *[0] * (capacity + 1 - len(counts))], []
    residual = [0] * (capacity + 1)
    for big in range(capacity, 0, -1):
        while left[big]:
            left[big] -= 1
            rest = (_exact(capacity - big, left, big) if big >= least else None) if big < capacity else []
            left[big] += 1
            if rest is None:
                residual[big], left[big] = left[big], 0
                break
            lengths = [big, *rest]
            times = min(left[x] // lengths.count(x) for x in set(lengths))
            for x in lengths:
                left[x] -= times
            out.append((times, lengths))
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}  # by gap
    for size in range(capacity, 0, -1):
        n = residual[size]
        while n:
            gap = min((g for g, bins in open_bins.items() if g >= size and bins), default=None)
            if gap is None:
                per = capacity // size
                for times, k in ((n // per, per), (1 if n % per else 0, n % per)):
                    if times:
                        open_bins.setdefault(capacity - k * size, []).append((times, [size] * k))
                break
            times, lengths = open_bins[gap].pop()
            used = min(times, n)
            if used < times:
                open_bins[gap].append((times - used, lengths))
            open_bins.setdefault(gap - size, []).append((used, [*lengths, size]))
            n -= used
    return out + [b for _, bins in sorted(open_bins.items()) for b in bins]


def _placement(entries: list[tuple[int, list[int]]], capacity: int) -> np.ndarray:
    """Rows (length * 2**40 + first rank, sequence of that rank, offset), sorted: ranks go up one sequence each."""
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for times, lengths in entries:
        offset = 0
        for x in lengths:
            rows.append((x << 40 | used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows) or [(0, 0, 0)], np.int64)


def _place(rows: np.ndarray):
    def place(batches):
        for b in batches:
            key = b.column("length").to_numpy(zero_copy_only=False) << 40 | b.column("slot").to_numpy(zero_copy_only=False)
            own = rows[np.searchsorted(rows[:, 0], key, side="right") - 1]
            keep = [c for c in b.schema.names if c != "slot"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(own[:, 1] + key - own[:, 0]), pa.array(own[:, 2])],
                                             [*keep, "sequence_id", "offset"])

    return place


def tokenised_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: _row, doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    keyed = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("_row", "doc_id", "text")
    return keyed.mapInArrow(_pieces(path, pattern, capacity),
                            "_row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (any columns with _row, piece and length)."""
    counts = [0] * (capacity + 1)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    rows = _placement(plan(counts, capacity), capacity)
    ranked = with_slots(pieces, "length", ["_row", "piece"], sum(counts))
    types = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(_place(rows), f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise once into a stored table of small rows, then pack those."""
    return pack(stored(tokenised_pieces(docs, path, pattern, capacity), "pieces"), capacity).drop("_row")
