"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers, floor(scale * x), kept as packed bit planes: for each group of eight dimensions and each
bit of the two's complement one byte holds that bit of the eight parts.  For an anchor, a table per group lists the sums
of all 256 subsets of its eight parts.  The exact inner product is then the sum of the entries that a plane's bytes
select, shifted and added over the planes (the sign plane is subtracted).

Rows are dealt by hash into groups of about ROWS candidates and ANCHORS anchors; each group of candidates meets each
group of anchors once in the positives pass and once in the negatives pass, so no label, vector or id fills a task and
what a task holds is fixed.  A task emits at most the first few rows per anchor; a window joins those of all groups.

Defined cases: rows without id or label, and vectors that are null or hold null or non-finite parts, take no part;
shorter vectors count as padded with zeros; equal scores go to the smaller id; repeated ids are different rows (an anchor
skips only its own row); an anchor without another row of its label, or a positive without a row between its limits, gives
no rows; an empty table gives none; other columns are ignored.  Scores outside a long raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelog.llm.common import row_key, stored
from edgelog.llm.topk import _matrix

ROWS, ANCHORS, AT_ONCE = 4096, 4096, 64


def bit_planes(v: np.ndarray, bits: int) -> np.ndarray:
    """[row, bit, group of eight dimensions] bytes of the two's complement; dimension 8 g + i is bit i of byte g."""
    n, width = v.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.int64)
    wide[:, :width] = v
    return np.stack([np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """[group of eight dimensions, subset, anchor] sums of the parts in each subset."""
    n, width = anchors.shape
    groups = -(-width // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :width] = anchors
    parts = wide.astype(kind).T.reshape(groups, 8, n)
    sums = np.zeros((groups, 256, n), kind)
    for i in range(8):
        sums[:, 1 << i: 2 << i] = sums[:, : 1 << i] + parts[:, i, None, :]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """[candidate, anchor] inner products: table look-ups, shifted and added from the sign plane down."""
    n, bits, groups = planes.shape
    total = np.zeros((n, sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        if b < bits - 1:
            total += total
        for g in range(groups):
            np.take(sums[g], planes[:, b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                total -= found
            else:
                total += found
    return total


def number_kind(width: int, top: int):
    """Narrowest type that holds every partial sum of ``width`` products of numbers up to ``top``."""
    bound = 4 * max(width, 1) * (top + 1) * (top + 1)
    return np.int32 if bound < 2 ** 31 else np.int64 if bound < 2 ** 63 else object


def first_of(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, anchor) of the k best allowed candidates of each anchor; among equal scores earlier candidates first."""
    n = len(score)
    least = -(1 << 200) if score.dtype == object else np.iinfo(score.dtype).min
    own = np.where(allowed, score, least)
    if n > k:
        allowed = allowed & (own >= np.partition(own, n - k, axis=0)[n - k])
    at, anchor = np.nonzero(allowed)
    order = np.lexsort((at, -score[at, anchor], anchor))
    at, anchor = at[order], anchor[order]
    place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    return at[place < k], anchor[place < k]


def _meet(width: int, bits: int, kind, pick):
    """Scores of one group of candidates and one of anchors, a few anchors at once; ``pick`` makes the rows of each."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("_row", "ascending")])
        groups = -(-width // 8)
        planes = np.frombuffer(b"".join(x.as_py() for x in rows["planes"]), np.uint8).reshape(len(rows), bits, groups)
        own = {c: rows[c].to_numpy() for c in ("_row", "vec_id", "label")}
        out = []
        for at in range(0, len(anchors), AT_ONCE):
            some = anchors.slice(at, AT_ONCE)
            sums = subset_sums(_matrix(some["v"], width), kind)
            score = np.concatenate([scores(planes[i: i + 1024], sums) for i in range(0, len(planes), 1024)]) if len(planes) else np.zeros((0, len(some)), kind)
            out += pick(own, some, score)
        return pa.concat_tables(out) if out else pick(own, anchors.slice(0, 0), np.zeros((0, 0), kind))[0]

    return run


def _positives(k: int):
    def pick(own, some, score):
        if not len(score):
            at = anchor = np.zeros(0, np.int64)
        else:
            same = own["label"][:, None] == some["label"].to_numpy()[None, :]
            at, anchor = first_of(score, same & (own["_row"][:, None] != some["_row"].to_numpy()[None, :]), k)
        return [pa.table({"_anchor": some["_row"].take(pa.array(anchor)), "positive_id": pa.array(own["vec_id"][at]),
                          "positive_score": pa.array(score[at, anchor].tolist() if len(at) else [], pa.int64())})]

    return pick


def _negatives(k: int, low: int, high: int):
    def pick(own, some, score):
        out = []
        positives = some["positives"].to_pylist()
        other = own["label"][:, None] != some["label"].to_numpy()[None, :] if len(score) else None
        for p in range(max(map(len, positives), default=0)):
            has = np.array([i for i, x in enumerate(positives) if len(x) > p], np.int64)
            ps = [positives[i][p] for i in has]
            top = np.array([high * x["positive_score"] // 100 for x in ps], score.dtype)
            floor = np.array([-(-low * x["positive_score"] // 100) for x in ps], score.dtype)
            s = score[:, has]
            at, which = first_of(s, other[:, has] & (s <= top) & (s >= floor), k)
            out.append(pa.table({
                "_anchor": some["_row"].take(pa.array(has[which])), "anchor_id": some["vec_id"].take(pa.array(has[which])),
                "_positive": pa.array(np.full(len(at), p, np.int32)),
                "positive_id": pa.array([ps[i]["positive_id"] for i in which], pa.int64()),
                "negative_id": pa.array(own["vec_id"][at]),
                "positive_score": pa.array([ps[i]["positive_score"] for i in which], pa.int64()),
                "negative_score": pa.array(s[at, which].tolist(), pa.int64())}))
        return out or [pa.table({"_anchor": pa.array([], pa.int64()), "anchor_id": pa.array([], pa.int64()), "_positive": pa.array([], pa.int32()),
                                 **{c: pa.array([], pa.int64()) for c in ("positive_id", "negative_id", "positive_score", "negative_score")}})]

    return pick


def _pack(width: int, bits: int):
    def run(batches):
        for b in batches:
            planes = bit_planes(_matrix(b.column(b.schema.get_field_index("v")), width), bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.tobytes() for p in planes], pa.binary())], [*b.schema.names, "planes"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (vec_id, embedding, label).

    Anchors are the rows that the condition ``is_anchor`` selects.  An anchor's positives are its first ``positives``
    other rows of the same label; for each, the first ``negatives`` rows of other labels are returned whose score is at
    least ``low`` and at most ``high`` percent of the positive's."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine
    rows = row_key(vectors.select("vec_id", "embedding", "label", is_anchor.alias("_is"))).where(usable)
    rows = rows.select("_row", F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "_is", whole.alias("v"))
    width, top = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    width, top = max(width or 1, 1), top or 0
    bits, kind = top.bit_length() + 1, number_kind(width, top)
    packed = stored(rows.mapInArrow(_pack(width, bits), "_row long, vec_id long, label int, _is boolean, v array<bigint>, planes binary"), "planes")
    n, m = packed.agg(F.count("*"), F.count_if("_is")).first()
    groups, slabs = max(1, -(-n // ROWS)), max(1, -(-m // ANCHORS))
    every = packed.select("_row", "vec_id", "label", "planes", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int").alias("_g"),
                          F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("_s"))
    anchors = packed.where("_is").select("_row", "vec_id", "label", "v")

    def meet(some: DataFrame, pick, types: str) -> DataFrame:
        dealt = some.withColumn("_s", F.pmod(F.xxhash64("_row"), F.lit(slabs)).cast("int"))
        dealt = dealt.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return every.groupBy("_g", "_s").cogroup(dealt.groupBy("_g", "_s")).applyInArrow(_meet(width, bits, kind, pick), types)

    near = meet(anchors, _positives(positives), "_anchor long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("_anchor").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("_place", place).where(F.col("_place") <= positives)
    lists = near.groupBy("_anchor").agg(F.sort_array(F.collect_list(F.struct("_place", "positive_id", "positive_score"))).alias("positives"))
    known = stored(anchors.join(lists, anchors["_row"] == lists["_anchor"]).drop("_anchor"), "positives")
    found = meet(known, _negatives(negatives, low, high),
                 "_anchor long, anchor_id long, _positive int, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("_anchor", "_positive").orderBy(F.desc("negative_score"), "negative_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
