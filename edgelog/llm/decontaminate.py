"""Benchmark decontamination by winnowing.

Every run of WINDOW consecutive words is represented by the smallest of its K-word hashes (winnowing with a window
of WINDOW - K + 1 hashes), so a document and a benchmark item that share a run of WINDOW words share that
fingerprint for certain.  Document windows whose fingerprint is not among the benchmark's are dropped inside the scan
by a bit table of fixed size; survivors are joined on (fingerprint, words) with the distinct benchmark windows, which
extends the hit to an exact match, and the matched spans are merged per document.  Items shorter than WINDOW words
are one window of their own length, fingerprinted whole; the documents look up only the lengths that occur.

Defined cases: null or word-less texts have no words and no hits; items without words match nothing; a null item id
counts as the empty text; repeated documents are judged row by row, repeated items are listed once; empty tables give
no rows (documents) or no hits (benchmark); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, keyed, row_key, slices
from edgelog.llm.textops import (Powers, byte_values, int64, lower_table, ngrams, prefix_sums, sliding_min, spans_hash,
                                 words)

WINDOW, K = 10, 5
BITS = 22
"""The lookup in the scan has 2**BITS bits (512 KiB) whatever the benchmark's size; false hits fall in the join."""


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each run of n words."""
    return sliding_min(ngrams(hashes, K), n - K + 1) if n == WINDOW else ngrams(hashes, n)


def _item_windows(batches):
    """Distinct windows of benchmark texts: item, length, fingerprint, words."""
    powers, values, lower = Powers(), byte_values(), lower_table()
    for rows, data, offsets in slices(batches):
        data = lower[data]
        start, end, text = words(data, offsets)
        hashes = spans_hash(prefix_sums(data, values, powers), start, end, powers)
        raw, items = data.tobytes(), rows.column(0).to_pylist()
        out = []
        for t in range(rows.num_rows):
            a, b = np.searchsorted(text, [t, t + 1])
            n = min(WINDOW, int(b - a))
            if n:
                fp = int64(_windows(hashes[a:b], n))
                own = [raw[s:e].decode() for s, e in zip(start[a:b], end[a:b])]
                out += [(items[t], n, int(f), " ".join(own[i: i + n])) for i, f in enumerate(fp)]
        yield pa.RecordBatch.from_pylist([dict(zip(("item", "n", "fp", "words"), x)) for x in out], pa.schema(
            [("item", pa.string()), ("n", pa.int32()), ("fp", pa.int64()), ("words", pa.string())]))


def _document_windows(bits: bytes, lengths: list[int]):
    """Per row: key, number of words, and the windows whose fingerprint may be a benchmark's."""

    def scan(batches):
        powers, values, lower = Powers(), byte_values(), lower_table()
        table = np.frombuffer(bits, np.uint8)
        for rows, data, offsets in slices(batches):
            data = lower[data]
            start, end, text = words(data, offsets)
            hashes = spans_hash(prefix_sums(data, values, powers), start, end, powers)
            counts = np.bincount(text, minlength=rows.num_rows)
            first = np.cumsum(counts) - counts
            found = []
            for n in lengths:
                fp = _windows(hashes, n)
                if not len(fp):
                    continue
                low = fp & np.uint64((1 << BITS) - 1)
                hit = (table[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1
                at = np.flatnonzero(hit)
                at = at[text[at] == text[at + n - 1]]  # inside one text
                found += [(int(text[i]), int(i), n, int(f)) for i, f in zip(at, int64(fp[at]))]
            found.sort()
            raw = data.tobytes()
            per = np.bincount(np.array([x[0] for x in found], np.int64), minlength=rows.num_rows)
            entries = pa.StructArray.from_arrays([
                pa.array([i - int(first[t]) for t, i, _, _ in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()),
                pa.array([x[3] for x in found], pa.int64()),
                pa.array([" ".join(raw[start[j]: end[j]].decode() for j in range(i, i + n)) for _, i, n, _ in found], pa.string())],
                ["at", "n", "fp", "words"])
            ends = np.zeros(rows.num_rows + 1, np.int32)
            np.cumsum(per, out=ends[1:])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends), entries)],
                                             ["_row", "doc_id", "n_words", "found"])

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, key: str | None = None) -> DataFrame:
    """Per row of ``docs`` (with its row key ``_row``, the stored column ``key`` if given): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    bounded_batches(docs.sparkSession)
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
             .mapInArrow(_item_windows, "item string, n int, fp long, words string"))
    # one row per distinct window, with the items that hold it
    windows = items.groupBy("fp", "n", "words").agg(F.collect_set("item").alias("items"))
    low = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1))
    table = np.zeros(1 << BITS - 3, np.uint8)
    positions = np.array([r[0] for r in items.select(low.alias("low")).distinct().collect()], np.int64)  # < 2**BITS
    np.bitwise_or.at(table, positions >> 3, (1 << (positions & 7)).astype(np.uint8))
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most WINDOW values

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    rows = docs.select(F.col(key).alias("_row"), *columns) if key else row_key(docs.select(*columns)).select("_row", "doc_id", "text")
    scanned = rows.mapInArrow(
        _document_windows(table.tobytes(), lengths),
        "_row long, doc_id long, n_words long, found array<struct<at:int,n:int,fp:long,words:string>>")
    hits = (scanned.select("_row", "doc_id", "n_words", F.explode_outer("found").alias("f"))
            .select("_row", "doc_id", "n_words", "f.*")
            .join(windows.select("fp", "n", "words", "items"), ["fp", "n", "words"], "left"))
    matched = F.col("items").isNotNull()
    per_row = hits.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(matched, F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")), lambda s, x: F.struct(
        F.greatest(s["end"], x["b"]).alias("end"),
        (s["sum"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).cast("long").alias("sum")))["sum"]
    return per_row.select(
        "_row", "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, all columns kept."""
    rows = keyed(docs, "__keep_row")
    hit = contamination(rows, benchmark, "__keep_row").where("contaminated").select(F.col("_row").alias("__hit_row"))
    return rows.join(hit, rows["__keep_row"] == hit["__hit_row"], "left_anti").drop("__keep_row")
