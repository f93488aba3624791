"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the words and word beginnings that a text holds once, twice or four times at least.  The loss is the logistic loss of the labelled texts plus a
penalty on (z(x) - z(x'))**2, where x' is the text with its identity terms swapped for another of the same group:
the score may not depend on which group a text mentions, so neutral mentions aren't taken for toxicity.

The classifier is fitted on at most ROWS labelled rows (drawn by hash), with the at most FEATURES features that tell the classes
apart best by the G-test, above the value that the best of so many features reaches by chance; counts come from Spark jobs over that sample, the driver holds the chosen features of the sample only.
Scoring covers every whole text, vectorised in the scan.

Defined cases: a null or empty text has no feature and gets the score of the intercept; repeated rows are scored
alike; equal G values: the smaller feature hash; without labelled rows of both classes every score is 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, labelled_sample, list_column, slices
from edgelog.llm.textops import Powers, byte_values, int64, lower_table, mix, prefix_sums, spans_hash, words

ROWS, FEATURES, LEAST_DOCS = 8000, 4096, 3
PENALTY, RIDGE, STEPS = 4.0, 3e-5, 400
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
LEVELS = (1, 2, 4)  # a feature counts once for each of these numbers of occurrences that it reaches
BITS = 20

# Identity terms by group; a term is swapped for the next of its group.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girl", "boy"], ["she", "he"], ["mother", "father"],
    ["gay", "straight"], ["lesbian", "heterosexual"], ["transgender", "cisgender"],
    ["black", "white", "asian", "latino"], ["african", "european", "american"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["immigrant", "native"], ["disabled", "blind", "deaf"], ["old", "young"],
    ["femme", "homme"], ["femmes", "hommes"], ["musulman", "chrétien", "juif"], ["noir", "blanc"],
    ["frau", "mann"], ["frauen", "männer"], ["muslime", "christen", "juden"], ["schwarz", "weiß"],
    ["mujer", "hombre"], ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negro", "blanco"],
]


def _features(data: np.ndarray, offsets: np.ndarray, powers: Powers, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and word beginning, with repeats."""
    start, end, text = words(data, offsets)
    sums = prefix_sums(data, values, powers)
    found = [(text, spans_hash(sums, start, end, powers))]
    for n in BEGINNINGS:
        longer = end - start > n
        found.append((text[longer], mix(spans_hash(sums, start[longer], start[longer] + n, powers) + np.uint64(n))))
    return np.concatenate([t for t, _ in found]), np.concatenate([f for _, f in found])


def _term_features(term: str, powers: Powers, values: np.ndarray) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return _features(data, np.array([0, len(data)]), powers, values)[1]


def _swaps(powers: Powers, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(hash of a term, its features, the features of the term that replaces it)."""
    out = []
    for group in IDENTITY_TERMS:
        own = [_term_features(t, powers, values) for t in group]
        out += [(int(own[i][0]), own[i], own[(i + 1) % len(group)]) for i in range(len(group))]
    return out


def _counted(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) with the number of occurrences."""
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(first)
    return text[at], feature[at], np.diff(np.append(at, len(text)))


def _levels(text: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature place * number of levels + level) for every level that the count reaches, text by text."""
    reached = n[:, None] >= np.array(LEVELS)
    return np.repeat(text, reached.sum(axis=1)), (place[:, None] * len(LEVELS) + np.arange(len(LEVELS)))[reached]


class Lookup:
    """Position of a hash in a sorted set, behind a bit table that turns most misses away."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.sort(hashes)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.sorted & np.uint64((1 << BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are in the set, where there)."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[hashes & np.uint64((1 << BITS) - 1)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        return at[hit], place[hit]


def _count(known: np.ndarray | None):
    """Per feature (only those in ``known`` if given) the number of this task's texts that reach each level."""

    def run(batches):
        powers, values, lower = Powers(), byte_values(), lower_table()
        lookup = None if known is None else Lookup(known)
        for _, data, offsets in slices(batches):
            text, feature = _features(lower[data], offsets, powers, values)
            if lookup:
                at, _ = lookup.find(feature)
                text, feature = text[at], feature[at]
            _, feature, n = _counted(text, feature)
            own, place = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(int64(own)), *(pa.array(np.bincount(place[n >= x], minlength=len(own))) for x in LEVELS)],
                ["feature", *(f"n{x}" for x in LEVELS)])

    return run


def _design(chosen: np.ndarray):
    """Per labelled text: label, chosen features, and the chosen features after the swap (null without an identity term)."""

    def run(batches):
        powers, values, lower = Powers(), byte_values(), lower_table()
        lookup, swaps = Lookup(chosen), _swaps(powers, values)
        terms = np.array([t for t, _, _ in swaps], np.uint64)
        for rows, data, offsets in slices(batches):
            text, feature, n = _counted(*_features(lower[data], offsets, powers, values))
            at, place = lookup.find(feature)
            owner, place = _levels(text[at], place, n[at])
            swapped: list[list[int] | None] = [None] * rows.num_rows
            for t in np.unique(text[np.isin(feature, terms)]):
                before = dict(zip(feature[text == t].tolist(), n[text == t].tolist()))
                after = dict(before)
                for term, old, new in swaps:
                    if times := before.get(term, 0):
                        for f in old.tolist():
                            after[f] = after.get(f, 0) - times
                        for f in new.tolist():
                            after[f] = after.get(f, 0) + times
                own = np.array(sorted(f for f, k in after.items() if k > 0), np.uint64)
                hit, where = lookup.find(own)
                kept = np.array([after[int(f)] for f in own[hit]], np.int64)
                swapped[t] = _levels(np.zeros(len(hit), np.int64), where, kept)[1].tolist()
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("y")),
                 list_column(place, np.bincount(owner, minlength=rows.num_rows), pa.int32()), pa.array(swapped, pa.list_(pa.int32()))],
                ["y", "has", "swapped"])

    return run


class _Sparse:
    def __init__(self, lists: list, width: int) -> None:
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.col = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        self.shape = len(lists), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


def train(y: np.ndarray, has: list, swapped: list, width: int, penalty: float = PENALTY, ridge: float = RIDGE,
          steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample; rows of ``swapped`` that are None have no counterfactual."""
    x = _Sparse(has, width)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    a, b = _Sparse([has[i] for i in pairs], width), _Sparse([swapped[i] for i in pairs], width)
    w, bias = np.zeros(width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40)))
        g = x.back(p - y) / len(y) + ridge * w
        if pairs:
            d = 2 * penalty * (a.dot(w) - b.dot(w)) / len(pairs)
            g += a.back(d) - b.back(d)
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, weights, intercept) learned from ``labels`` (doc_id, toxic)."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", rows, "toxic-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    none = np.zeros(0, np.uint64), np.zeros(0), -40.0
    if not sizes.get(0) or not sizes.get(1):
        return none

    columns = [f"n{x}" for x in LEVELS]

    def counts(y: int, known: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
        part = sample.where(F.col("y") == y).select("text").mapInArrow(_count(known), "feature long, " + ", ".join(f"{c} long" for c in columns))
        got = part.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).where(F.col("n1") >= least).orderBy("feature").toArrow()
        return got["feature"].to_numpy(), np.stack([got[c].to_numpy() for c in columns], axis=1).astype(float)  # bounded by the sample

    hashes, k1 = counts(1, None, LEAST_DOCS)
    if not len(hashes):
        return none
    seen, n_other = counts(0, hashes.view(np.uint64), 1)
    k0 = np.zeros_like(k1)
    k0[np.searchsorted(hashes, seen)] = n_other
    n1, n0 = sizes[1], sizes[0]

    def part(k, expected):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)

    share = (k1 + k0) / (n1 + n0)
    g = part(k1, n1 * share) + part(k0, n0 * share) + part(n1 - k1, n1 * (1 - share)) + part(n0 - k0, n0 * (1 - share))
    # by chance alone the best of n features reaches a G of about ln(n); what stays below can't be told from noise
    best = np.lexsort((hashes, -g.max(axis=1)))[:min(FEATURES, max(1, int((g.max(axis=1) > np.log(len(hashes))).sum())))]
    chosen = np.sort(hashes[best].view(np.uint64))
    design = sample.mapInArrow(_design(chosen), "y int, has array<int>, swapped array<int>").toArrow()
    order = sorted(range(design.num_rows), key=lambda i: (design["y"][i].as_py(), design["has"][i].as_py()))
    y, has, swapped = (design[c].to_pylist() for c in ("y", "has", "swapped"))
    weights, bias = train(np.array([y[i] for i in order], float), [has[i] for i in order], [swapped[i] for i in order], len(chosen) * len(LEVELS))
    return chosen, weights, bias


def score(docs: DataFrame, chosen: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches):
        powers, values, lower, lookup = Powers(), byte_values(), lower_table(), Lookup(chosen)
        for rows, data, offsets in slices(batches):
            text, feature = _features(lower[data], offsets, powers, values)
            at, place = lookup.find(feature)
            own, feature = _levels(*_counted(text[at], place))
            z = np.bincount(own, weights[feature], rows.num_rows) + bias if len(own) else np.full(rows.num_rows, bias)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
