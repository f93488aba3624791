"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors become whole numbers, floor(64 * x).  They are dealt into cells around at most CELLS centres (fitted on a
bounded sample) and, inside a cell, by hash into blocks, so no cell or common vector fills one task.  Each block of
candidates and each block of queries is built into a cover tree once: a node has a centre and a covering radius, the
children of a node cover it at half its radius, small children share a leaf.  A pair of nodes can't
hold a product above  cq.cc + |cq| Rc + |cc| Rq + Rq Rc ; where that is below the worst kth score of the query
group, the pair is dropped, else the wider node is split, down to leaf pairs that are multiplied exactly.

A first pass over one block of the closest cell gives every query a lower bound of its kth score; the second pass visits
the block pairs of all cell pairs that the same bound leaves (a list of at most CELLS * CELLS), and a window keeps the
best k.  Equal vectors in a block keep their k + 1 smallest ids: more can't be among the k best of any query.

Defined cases: vectors that are null, or hold null or non-finite parts, and rows without id take no part; shorter
vectors count as padded with zeros; repeated ids are different rows (a query skips only its own row); ties go to
the smaller id; fewer candidates than k give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelog.llm.common import row_key, stored

K, CELLS, SAMPLE = 20, 16, 2000
BLOCK, QUERY_BLOCK, LEAF = 2048, 512, 64


def build_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """Cover tree over the rows of ``x``: ``order`` lists the rows so that each node is a run lo..hi-1 of it."""
    order, parts = [], {"lo": [], "hi": [], "centre": [], "radius": [], "first": [], "last": []}

    def node(rows: np.ndarray) -> int:
        me = len(parts["lo"])
        distance = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(axis=1))
        radius = float(distance.max())
        for k, v in (("lo", len(order)), ("hi", 0), ("centre", int(rows[0])), ("radius", radius), ("first", 0), ("last", 0)):
            parts[k].append(v)
        if len(rows) <= LEAF or radius == 0:
            order.extend(rows.tolist())
        else:
            groups, rest, small = [rows[distance <= radius / 2]], rows[distance > radius / 2], []
            while len(rest):
                near = ((x[rest] - x[rest[0]]) ** 2).sum(axis=1) <= (radius / 2) ** 2
                (groups if near.sum() > LEAF // 4 else small).append(rest[near])
                rest = rest[~near]
            joined: list[np.ndarray] = []
            for g in small:
                joined.append(g)
                if sum(map(len, joined)) >= LEAF:
                    groups.append(np.concatenate(joined))
                    joined = []
            if joined:
                groups.append(np.concatenate(joined))
            if len(groups) == 1:  # nothing was split off: halve, the radius still covers
                groups = [rows[: len(rows) // 2], rows[len(rows) // 2:]]
            children.append((me, groups))
            return me
        parts["hi"][me] = len(order)
        return me

    children: list = []

    def grow(rows: np.ndarray) -> int:
        me = node(rows)
        if children and children[-1][0] == me:
            _, groups = children.pop()
            kids = [grow(g) for g in groups]
            spread[me] = kids
            parts["hi"][me] = len(order)
        return me

    spread: dict[int, list[int]] = {}
    grow(np.arange(len(x)))
    flat: list[int] = []
    for me in range(len(parts["lo"])):
        parts["first"][me] = len(flat)
        flat += spread.get(me, [])
        parts["last"][me] = len(flat)
    centre = np.array(parts.pop("centre"))
    return {"order": np.array(order), "centre": x[centre], "kids": np.array(flat, np.int64)} | {k: np.array(v) for k, v in parts.items()}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products of all rows of ``a`` with all rows of ``b``."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if top < 2 ** 63 else (a.astype(object) @ b.astype(object).T).astype(np.int64)


def search(q: dict, c: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of all pairs that may be among the k best; raises ``q['worst']``, the lower
    bounds of the queries' kth scores."""
    qt, ct, qx, cx, worst = q["tree"], c["tree"], q["x"], c["x"], q["worst"]
    qn, cn = np.linalg.norm(qt["centre"], axis=1), np.linalg.norm(ct["centre"], axis=1)
    best = np.full((len(qx), k), np.iinfo(np.int64).min)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bounds(a, b):
        dot = (qt["centre"][a] * ct["centre"][b]).sum(axis=-1)
        top = dot + qn[a] * ct["radius"][b] + cn[b] * qt["radius"][a] + qt["radius"][a] * ct["radius"][b]
        return top + np.abs(top) * 1e-9 + 1e-6

    stack = [(0, 0, np.inf)]
    while stack:
        a, b, top = stack.pop()
        own = slice(qt["lo"][a], qt["hi"][a])
        rows = qt["order"][own]
        if top < worst[rows].min():
            continue
        a_leaf, b_leaf = qt["first"][a] == qt["last"][a], ct["first"][b] == ct["last"][b]
        if a_leaf and b_leaf:
            cols = ct["order"][ct["lo"][b]: ct["hi"][b]]
            s = products(qx[rows], cx[cols])
            s[q["row"][rows][:, None] == c["row"][cols][None, :]] = np.iinfo(np.int64).min
            i, j = np.nonzero((s >= worst[rows][:, None]) & (s > np.iinfo(np.int64).min))
            found.append((rows[i], cols[j], s[i, j]))
            both = np.concatenate([best[rows], s], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            worst[rows] = np.maximum(worst[rows], best[rows].min(axis=1))
        elif b_leaf or not a_leaf and qt["radius"][a] > ct["radius"][b]:
            kids = qt["kids"][qt["first"][a]: qt["last"][a]]
            stack += [(int(x), b, float(t)) for x, t in zip(kids, bounds(kids, np.full(len(kids), b)))]
        else:
            kids = ct["kids"][ct["first"][b]: ct["last"][b]]
            top = bounds(np.full(len(kids), a), kids)
            stack += [(a, int(kids[x]), float(top[x])) for x in np.argsort(top)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, j, s = (np.concatenate(x) for x in zip(*found))
    keep = s >= worst[i]
    return i[keep], j[keep], s[keep]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(width, 1)), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _block(width: int, keep: int | None):
    """One row per group: its tree and vectors.  ``keep``: how many ids equal vectors keep (all for queries)."""

    def build(rows: pa.Table) -> pa.Table:
        x, row, ids = _matrix(rows["v"], width), rows["_row"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.lexsort((row, ids))
        x, row, ids = x[order], row[order], ids[order]
        if keep is not None:
            _, same = np.unique(x, axis=0, return_inverse=True)
            by = np.argsort(same.ravel(), kind="stable")
            first = np.searchsorted(same.ravel()[by], same.ravel()[by])
            kept = np.sort(by[np.arange(len(by)) - first < keep])
            x, row, ids = x[kept], row[kept], ids[kept]
        narrow = np.int32 if np.abs(x).max(initial=0) < 2 ** 31 else np.int64
        blob = pickle.dumps({"x": x.astype(narrow), "row": row, "ids": ids, "tree": build_tree(x.astype(np.float64)),
                             "worst": np.full(len(x), np.iinfo(np.int64).min)}, protocol=5)
        return pa.table({"cell": pa.array([rows["cell"][0].as_py()], pa.int32()),
                         "block": pa.array([rows["block"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return build


def _first_pass(k: int):
    def run(batches):
        for b in batches:
            for cell, block, blob, other in zip(*(b.column(n) for n in ("cell", "block", "blob", "other"))):
                q = pickle.loads(blob.as_py())
                q["x"] = q["x"].astype(np.int64)
                if other.as_py() is not None:
                    c = pickle.loads(other.as_py())
                    search(q, c | {"x": c["x"].astype(np.int64)}, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()),
                     pa.array([int(q["worst"].min())]), pa.array([pickle.dumps(q, protocol=5)], pa.binary())], ["cell", "block", "worst", "blob"])

    return run


def _second_pass(k: int):
    def run(batches):
        for b in batches:
            for blob, other in zip(b.column("blob"), b.column("other")):
                q, c = pickle.loads(blob.as_py()), pickle.loads(other.as_py())
                i, j, s = search(q, c | {"x": c["x"].astype(np.int64)}, k)
                yield pa.RecordBatch.from_arrays([pa.array(q["row"][i]), pa.array(q["ids"][i]), pa.array(c["ids"][j]), pa.array(s)],
                                                 ["_row", "query_id", "vec_id", "score"])

    return run


def _centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Farthest-first centres of a sample, moved three times to their members' means."""
    pick, far = [0], np.full(len(x), np.inf)
    while len(pick) < min(cells, len(x)):
        far = np.minimum(far, ((x - x[pick[-1]]) ** 2).sum(axis=1))
        if far.max() == 0:
            break
        pick.append(int(far.argmax()))
    c = x[pick].copy()
    for _ in range(3):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _assign(centres: np.ndarray):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(2), centres.shape[1]).astype(np.float64)
            d = (x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)
            near = d.argmin(axis=1)
            radius = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(radius)],
                                             ["_row", "vec_id", "v", "cell", "radius"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row of ``vectors`` (vec_id, embedding) that the
    condition ``is_query`` selects, against all other rows."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = row_key(vectors.select("vec_id", "embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select("_row", F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("_row")).limit(SAMPLE).select("v").toArrow()["v"]
    spark = vectors.sparkSession
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = _centres(_matrix(sample, width).astype(np.float64), CELLS)
    placed = stored(rows.mapInArrow(_assign(centres), "_row long, vec_id long, v array<bigint>, cell int, radius double"), "vectors")

    def blocks(some: DataFrame, size: int, keep: int | None) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
        cells = {r["cell"]: (r["n"], r["radius"]) for r in some.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()}
        chunks = F.element_at(F.create_map(*[F.lit(x) for c, (n, _) in cells.items() for x in (c, -(-n // size))]), F.col("cell")) if cells else F.lit(1)
        dealt = some.withColumn("block", F.pmod(F.xxhash64("_row"), chunks).cast("int"))
        return stored(dealt.groupBy("cell", "block").applyInArrow(_block(width, keep), "cell int, block int, blob binary"), "blocks"), cells

    candidates, c_cells = blocks(placed, BLOCK, k + 1)
    queries, q_cells = blocks(placed.where(is_query), QUERY_BLOCK, None)
    if not q_cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dots = centres @ centres.T
    norms = np.sqrt(np.diag(dots))
    closest = [(q, max(c_cells, key=lambda c: (dots[q, c], -c))) for q in q_cells]
    other = candidates.select(F.col("cell").alias("c_cell"), F.col("block").alias("c_block"), F.col("blob").alias("other"))

    def paired(q: DataFrame, cells: list[tuple[int, int]], c: DataFrame) -> DataFrame:
        """Blocks of the given cell pairs, a few pairs a task."""
        pairs = spark.createDataFrame(cells, "q_cell int, c_cell int")
        n = sum(-(-q_cells[a][0] // QUERY_BLOCK) * -(-c_cells[b][0] // BLOCK) for a, b in cells)
        joined = q.join(F.broadcast(pairs), F.col("cell") == F.col("q_cell")).drop("q_cell").join(c, "c_cell")
        return joined.repartition(max(1, n // 4), "cell", "block", "c_cell", "c_block")

    bounded = stored(paired(queries, closest, other.where("c_block = 0")).select("cell", "block", "blob", "other")
                     .mapInArrow(_first_pass(k), "cell int, block int, worst long, blob binary"), "bounded")
    worst = {r["cell"]: r["worst"] for r in bounded.groupBy("cell").agg(F.min("worst").alias("worst")).collect()}
    reach = [(q, c) for q in q_cells for c in c_cells if
             (dots[q, c] + norms[q] * c_cells[c][1] + norms[c] * q_cells[q][1] + c_cells[c][1] * q_cells[q][1]) * (1 + 1e-9) + 1e-6 >= worst.get(q, -np.inf)]
    found = (paired(bounded, reach, other).select("blob", "other")
             .mapInArrow(_second_pass(k), "_row long, query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
