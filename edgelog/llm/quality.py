"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are trigrams of character kinds (letters by case, digits, line ends, each ASCII sign for itself), hashed
into TERMS buckets, and large shares of words that repeat the word before them.  Log counts, weighted by rarity in the labelled sample
and scaled to length one, are projected onto the RANK leading singular vectors of that sample.  Every document is compared with
all labelled vectors by blocked matrix products (exact cosines) and takes the similarity-weighted vote of its NEIGHBOURS
nearest.

The broadcast holds TERMS x RANK and ROWS x RANK numbers, whatever the corpus size (ROWS bounds the labelled sample,
drawn by hash).

Defined cases: a null or empty text has no term and gets the sample's share of label 1; ties among neighbours go to
the labelled row that comes first in the sample's fixed order; repeated rows are scored alike; without labelled rows
every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, labelled_sample, list_column, slices
from edgelog.llm.textops import Powers, byte_values, prefix_sums, spans_hash, words

ROWS, TERMS, RANK, NEIGHBOURS = 6000, 2048, 48, 15
THRESHOLD = 0.5
POWER = 8
REPEATED = (0.05, 0.2, 0.5)  # shares of repeated words, each a term when exceeded


def kinds() -> np.ndarray:
    """Kind of each byte: 1 lower case and beyond ASCII, 2 upper case, 3 digits, 4 line ends, 5 other white space, then signs."""
    t = np.ones(256, np.int64)
    t[65:91], t[48:58], t[[10, 13]], t[[9, 11, 12, 32]] = 2, 3, 4, 5
    signs = [b for b in range(128) if not chr(b).isalnum() and b not in (9, 10, 11, 12, 13, 32)]
    t[signs] = 6 + np.arange(len(signs))
    return t


def term_counts(data: np.ndarray, offsets: np.ndarray, powers: Powers, values: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Counts per text and term."""
    n = len(offsets) - 1
    k = kind[data]
    size = int(kind.max()) + 1
    code = (k[:-2] * size + k[1:-1]) * size + k[2:] if len(k) > 2 else np.zeros(0, np.int64)
    bucket = (code * 0x9E3779B1 >> 11) % (TERMS - len(REPEATED))
    text = np.repeat(np.arange(n), np.diff(offsets))
    inside = text[:-2] == text[2:] if len(k) > 2 else np.zeros(0, bool)
    out = np.bincount(text[: len(code)][inside] * TERMS + bucket[inside], minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    start, end, owner = words(data, offsets)
    h = spans_hash(prefix_sums(data, values, powers), start, end, powers)
    same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) if len(h) else np.zeros(0, np.int64)
    share = np.bincount(owner[same], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    out[:, TERMS - len(REPEATED):] = np.where(share[:, None] > np.array(REPEATED), 1000, 0)
    return out


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * rarity
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _sample_counts(batches):
    powers, values, kind = Powers(), byte_values(), kinds()
    for rows, data, offsets in slices(batches):
        counts = term_counts(data, offsets, powers, values, kind)
        row, col = np.nonzero(counts)
        per = np.bincount(row, minlength=rows.num_rows)
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index("y")), list_column(col, per, pa.int16()), list_column(counts[row, col], per, pa.int32())],
            ["y", "term", "n"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS):
    """(rarity, projection, labelled unit vectors, labels) from ``labels`` (doc_id, quality)."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows, "quality-sample")
    got = sample.mapInArrow(_sample_counts, "y int, term array<smallint>, n array<int>").toArrow()  # at most ``rows`` rows
    if not got.num_rows:
        return None
    rows_ = sorted(zip(got["y"].to_pylist(), got["term"].to_pylist(), got["n"].to_pylist()))
    x = np.zeros((len(rows_), TERMS), np.float32)
    for i, (_, term, n) in enumerate(rows_):
        x[i, term] = n
    y = np.array([r[0] for r in rows_], np.float32)
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = weighted(x, rarity)
    size, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = vectors[:, ::-1][:, : min(RANK, len(x))].astype(np.float32)
    return rarity, projection, _unit(x @ projection), y


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def vote(z: np.ndarray, known: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors of each row."""
    k = min(NEIGHBOURS, len(known))
    cosine = (z @ known.T).astype(np.float64)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** POWER
    return (weight * y[near]).sum(axis=1) / weight.sum(axis=1)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches):
        powers, values, kind = Powers(), byte_values(), kinds()
        for rows, data, offsets in slices(batches):
            p = np.zeros(rows.num_rows)
            if model is not None:
                rarity, projection, known, y = model
                z = weighted(term_counts(data, offsets, powers, values, kind), rarity) @ projection
                p = np.where(np.abs(z).sum(axis=1) > 0, vote(_unit(z), known, y), y.mean())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p.astype(np.float64)), pa.array((p >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
