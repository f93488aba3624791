"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of DIMENSIONS signs.  A letter trigram is bound into one vector: the element-wise
product of its letters' vectors, the first rotated twice, the second once, the third not, so order counts.  A text is
the sum (bundle) of its trigram vectors, a language prototype the sum over all texts it is learned from, and a text
gets the language whose prototype has the highest cosine.

Letters are lower-cased; a-z have codes of their own, every other letter falls into one of 37 more; everything else
is a word boundary, which takes part in trigrams as a symbol.  Counting trigrams first and multiplying the counts with
the trigram vectors gives the same sums as adding vector after vector.  A text's product with a prototype is the sum of its
trigrams' products, which each worker computes once per trigram; as the length of its bundle counts the one that it has
when trigram vectors are orthogonal (at DIMENSIONS signs they are to about 1 %), so no text's bundle is built.

Defined cases: a null text or one without letters is ``und`` with score 0 and learns nothing; rows with a null lang
learn nothing; ties go to the language that sorts first; repeated rows are judged alike and learned each; with no
prototype at all every text is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, slices, worker_cache

DIMENSIONS = 8192  # a random vector's cosine has a standard deviation of 0.011
BLOCK = 256  # trigram vectors at a time
CODES = 64
UNDEFINED = "und"


def letter_codes() -> np.ndarray:
    """Code per code point: 0 no letter, 1-26 a-z, 27-63 all other letters."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            t[c] = 27 + c % 37
    t[97:123] = np.arange(1, 27)
    return t


def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign vectors of all codes, rotated for the first, second and third place."""
    v = np.random.default_rng(20240229).integers(0, 2, (CODES, DIMENSIONS)).astype(np.float32) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts per text and trigram, the trigrams' codes) for the trigrams that occur."""
    table = worker_cache("letter codes", letter_codes)
    lowered = [(t or "").lower() for t in texts]
    joined = " " + " ".join(lowered) + " "
    codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    text = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [len(t) + 1 for t in lowered] + [1])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # runs of boundaries count once
    codes, text = codes[keep].astype(np.int32), text[keep]
    middle = np.flatnonzero(codes[1:-1]) + 1  # a trigram never bridges two words
    grams = codes[middle - 1] << 12 | codes[middle] << 6 | codes[middle + 1]
    owner = text[middle]  # the separator before a text counts to it
    seen = np.flatnonzero(np.bincount(grams, minlength=1))
    place = np.zeros(CODES ** 3, np.int64)
    place[seen] = np.arange(len(seen))
    counts = np.bincount(owner.astype(np.int64) * len(seen) + place[grams], minlength=len(texts) * len(seen))
    return counts.reshape(len(texts), len(seen)).astype(np.float32), seen


def bundles(counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Sum of the trigram vectors of each row of counts."""
    first, second, third = worker_cache("letter vectors", letter_vectors)
    out = np.zeros((len(counts), DIMENSIONS), counts.dtype)
    for at in range(0, len(grams), BLOCK):
        g = grams[at: at + BLOCK]
        out += counts[:, at: at + BLOCK] @ (first[g >> 12] * second[g >> 6 & 63] * third[g & 63])
    return out


def _learn(batches):
    """Per language the sum over this task's texts (a few rows of DIMENSIONS whole numbers)."""
    held: dict[str, np.ndarray] = {}
    sums: dict[str, np.ndarray] = {}

    def bundle_held():
        for x, n in held.items():
            grams = np.flatnonzero(n)
            sums[x] = sums.get(x, 0) + np.rint(bundles(n[None, grams], grams)[0]).astype(np.int64)
        held.clear()

    for rows, _, _ in slices(batches):
        counts, grams = trigram_counts(rows.column(0).to_pylist())
        langs = np.array(rows.column(1).to_pylist())
        for x in sorted(set(langs)) if len(grams) else ():
            held.setdefault(x, np.zeros(CODES ** 3))[grams] += counts[langs == x].sum(axis=0, dtype=np.float64)
        if len(held) > 32:
            bundle_held()
    bundle_held()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])


def learn_prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype per language from all rows (text, lang); the driver gets DIMENSIONS numbers per language."""
    bounded_batches(labelled.sparkSession)
    known = labelled.select("text", "lang").where("lang is not null and text is not null")
    parts = known.mapInArrow(_learn, "lang string, sums array<bigint>")
    rows = parts.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    prototypes = {x: np.zeros(DIMENSIONS) for x in sorted({r["lang"] for r in rows})}
    for r in rows:
        prototypes[r["lang"]][r["i"]] = r["x"]
    return prototypes


def gram_products(grams: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Cosines of trigram vectors with unit prototypes, computed once per worker."""
    table = worker_cache("gram products " + hashlib.sha256(units.tobytes()).hexdigest(),
                         lambda: np.full((CODES ** 3, len(units)), np.nan))
    first, second, third = worker_cache("letter vectors", letter_vectors)
    new = grams[np.isnan(table[grams, 0])]
    for at in range(0, len(new), BLOCK):
        g = new[at: at + BLOCK]
        table[g] = (first[g >> 12] * second[g >> 6 & 63] * third[g & 63]).astype(np.float64) @ units.T / np.sqrt(DIMENSIONS)
    return table[grams]


def _judge(texts: list[str | None], names: list[str], units: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    counts, grams = trigram_counts(texts)
    if not names or not len(grams):
        return [UNDEFINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    size = np.sqrt(np.square(counts, dtype=np.float64).sum(axis=1))
    cosine = (counts @ gram_products(grams, units)) / np.maximum(size, 1e-9)[:, None]
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
    some = size > 0
    return [names[b] if s else UNDEFINED for b, s in zip(best, some)], np.where(some, score, 0.0), (counts > 0).sum(axis=1)


def judge(texts: list[str | None], names: list[str], units: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and cosine (0 to 1) of each text against unit prototypes."""
    return _judge(texts, names, units)[:2]


def _units(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = [k for k, v in prototypes.items() if np.any(v)]
    return names, np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), DIMENSIONS)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)
    names, units = _units(prototypes)

    def run(batches):
        for rows, _, _ in slices(batches):
            langs, score = judge(rows.column(1).to_pylist(), names, units)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float,
               by_size: tuple[tuple[int, float], ...] = ()) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has letters and reaches the cosine ``least`` with some prototype.

    ``by_size``: (different trigrams, least cosine) in ascending order, for texts of that many or more."""
    bounded_batches(docs.sparkSession)
    names, units = _units(prototypes)

    def run(batches):
        for rows, _, _ in slices(batches):
            langs, score, size = _judge(rows.column(rows.schema.get_field_index("text")).to_pylist(), names, units)
            limit = np.full(len(size), float(least))
            for n, x in by_size:
                limit[size >= n] = x
            yield rows.filter(pa.array(np.array([x != UNDEFINED for x in langs]) & (score >= limit)))

    return docs.mapInArrow(run, docs.schema)
