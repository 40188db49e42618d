"""Most similar vectors for every vector: stable random projections under kd-trees, with a chi-square stopping test.

Vectors of unit length are projected to ``DIMS`` dimensions by a Gaussian (2-stable) matrix, so that a squared
projected distance divided by the true squared distance follows the chi-square law with ``DIMS`` degrees of freedom.
A kd-tree over projections of a bounded sample deals all vectors to cells of about ``CELL``; inside a cell kd-trees
over further projections end in leaves of ``LEAF`` vectors.  A query takes the leaves of a tree in the order of their
projected distance and verifies their vectors exactly, ``VISITS`` leaves at most, leaving out those that the test
rules out: leaves so far off that a vector nearer than the k-th best so far would lie there with probability
``1 - CONFIDENCE`` at most.  The radius shrinks from leaf to leaf and from tree to tree.

One tree cuts some neighbours off; ``TOPS`` independent partitions with ``TREES`` trees in each cell make up for it.
So a query verifies ``TOPS * TREES * VISITS * LEAF`` vectors at most, however many there are, and the whole search
grows as n log n.  The price is accuracy: the tests measure the recall against brute force.

Byte-equal vectors are one class: any of them has the same neighbours, and of a class only the ``k + 1`` smallest
ids can be among somebody's k nearest, since ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstore.sources.tables import scratch

#: Projected dimensions (even), and the confidence of the stopping test.
DIMS, CONFIDENCE = 32, 0.99
#: Partitions into cells, trees in each cell, leaves of a tree that a query visits at most.
TOPS, TREES, VISITS = 4, 3, 10
#: Vectors aimed at per cell and per leaf.
CELL, LEAF = 24_000, 96
#: Classes that the partitions are fitted on, at most, and of these the least per cell; finer cells come from further
#: cuts at the medians of these.  Every class is indexed.
SAMPLE, LEAST = 20_000, 16


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of ``dims`` degrees <= x) = p, for even ``dims``: the tail is a Poisson sum."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        x = (lo + hi) / 2
        tail = sum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) for j in range(dims // 2)) if x else 1.0
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


def projection(size: int, seed: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dims))


def unit(raw: list[bytes], size: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=np.float32).astype(np.float64).reshape(-1, size)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            ok = np.asarray(lists.value_lengths().fill_null(0) if hasattr(lists, "value_lengths") else [len(x or ()) for x in lists.to_pylist()]) == size
            b = b.filter(pa.array(ok))
            v = np.asarray(b.column("embedding").flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, size)
            good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            raw = [x.tobytes() for x in v[good]]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").filter(pa.array(good)), pa.array([hashlib.md5(x).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "vkey", "vec"]
            )

    return run


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """(id, vkey, vec): rows of (id, embedding) of exactly ``size`` finite values, not all zero; the others are left out."""
    return vectors.where(F.col("id").isNotNull() & (F.size("embedding") == size)).select("id", "embedding").mapInArrow(_usable_batches(size), "id long, vkey binary, vec binary")


def cut(points: np.ndarray, rows: np.ndarray, target: int) -> tuple:
    """A kd-tree as nested tuples (axis, value, left, right); leaves are arrays of rows.  Cuts the axis of most variance at its median."""
    if len(rows) <= target:
        return rows
    # the axis is chosen on at most 512 rows, evenly taken; the median is that of all
    axis = int(np.argmax(points[rows[:: max(1, len(rows) // 512)]].var(axis=0)))
    own = points[rows, axis]
    value = float(np.median(own))
    left = own < value
    if left.all() or not left.any():
        half = len(rows) // 2  # all alike on every axis: any half will do
        return (axis, value, cut(points, rows[:half], target), cut(points, rows[half:], target))
    return (axis, value, cut(points, rows[left], target), cut(points, rows[~left], target))


def leaves(tree, out: list | None = None) -> list[np.ndarray]:
    out = [] if out is None else out
    if isinstance(tree, tuple):
        leaves(tree[2], out)
        leaves(tree[3], out)
    else:
        out.append(tree)
    return out


class Partition:
    """A kd-tree fitted on a sample, its cells numbered; ``levels`` further cuts of each cell at the sample's medians."""

    def __init__(self, points: np.ndarray, target: int, levels: int):
        self.levels, self.medians = levels, []
        self.tree = self._numbered(points, cut(points, np.arange(len(points)), max(1, target)))
        self.medians = np.stack(self.medians)

    def _numbered(self, points: np.ndarray, tree):
        if isinstance(tree, tuple):
            return (tree[0], tree[1], self._numbered(points, tree[2]), self._numbered(points, tree[3]))
        own = points[tree]
        self.medians.append(np.median(own, axis=0) if len(own) else np.zeros(points.shape[1]))
        return len(self.medians) - 1

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.empty(len(points), dtype=np.int64)

        def go(t, rows: np.ndarray) -> None:
            if not isinstance(t, tuple):
                out[rows] = t
                return
            left = points[rows, t[0]] < t[1]
            go(t[2], rows[left])
            go(t[3], rows[~left])

        go(self.tree, np.arange(len(points)))
        fine = np.zeros(len(points), dtype=np.int64)
        for k in range(self.levels):
            fine = 2 * fine + (points[:, k] < self.medians[out, k])
        return (out << self.levels) + fine


class Best:
    """The best ``width`` candidates of each query, by similarity rounded to six decimals, then by id."""

    def __init__(self, n: int, width: int):
        self.sim = np.full((n, width), -2_000_000, dtype=np.int64)
        self.who = np.full((n, width), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(self, query: np.ndarray, sim: np.ndarray, who: np.ndarray) -> None:
        """Candidates in millionths, in any order; an id that a query knows already counts once."""
        if not len(query):
            return
        rows, at = np.unique(query, return_inverse=True)
        width = self.sim.shape[1]
        q = np.concatenate([np.repeat(np.arange(len(rows)), width), at])
        s, w = np.concatenate([self.sim[rows].reshape(-1), sim]), np.concatenate([self.who[rows].reshape(-1), who])
        order = np.lexsort((w, -s, q))
        q, s, w = q[order], s[order], w[order]
        none = np.iinfo(np.int64).max
        new = np.r_[True, (q[1:] != q[:-1]) | (w[1:] != w[:-1]) | (w[1:] == none)]
        q, s, w = q[new], s[new], w[new]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < width
        self.sim[rows[q[keep]], place[keep]] = s[keep]
        self.who[rows[q[keep]], place[keep]] = w[keep]

    def radius(self) -> np.ndarray:
        """Squared distance to the worst kept candidate (4, the largest, while fewer are kept)."""
        return np.clip(2.0 - 2e-6 * self.sim[:, -1], 1e-6, 4.0)


def search(vectors: np.ndarray, ids: np.ndarray, width: int, seed: int, limit: float, trees: int = TREES, leaf: int = LEAF, visits: int = VISITS) -> tuple[Best, int]:
    """(the best of every vector among these, number of pairs verified): ``ids`` ascending."""
    n = len(ids)
    best, seen = Best(n, width), 0
    for t in range(trees):
        flat = (vectors @ projection(vectors.shape[1], seed + t)).astype(np.float32)
        parts = leaves(cut(flat, np.arange(n), leaf))
        low, high, mid = (np.stack([f(flat[x], axis=0) for x in parts]) for f in (np.min, np.max, np.mean))
        own = min(visits, len(parts))
        turn = np.empty((n, own), dtype=np.int64)
        for a in range(0, n, 4096):
            far = (mid * mid).sum(axis=1)[None] - 2 * (flat[a : a + 4096] @ mid.T)
            first = np.argpartition(far, own - 1, axis=1)[:, :own]
            turn[a : a + 4096] = np.take_along_axis(first, np.argsort(np.take_along_axis(far, first, axis=1), axis=1, kind="stable"), axis=1)
        for steps in (turn[:, :1], turn[:, 1:]):
            query, target = np.repeat(np.arange(n), steps.shape[1]), steps.reshape(-1)
            gap = np.maximum(low[target] - flat[query], flat[query] - high[target])
            np.maximum(gap, 0, out=gap)
            near = np.einsum("ij,ij->i", gap, gap) <= limit * best.radius()[query]
            query, target = query[near], target[near]
            order = np.argsort(target, kind="stable")
            query, target = query[order], target[order]
            least = (best.sim[:, -1] - 1) * 1e-6
            found: list[tuple] = []
            edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(target) else np.zeros(1, dtype=np.int64)
            for x, y in zip(edges[:-1], edges[1:]):
                rows, q = parts[target[x]], query[x:y]
                sims = vectors[q] @ vectors[rows].T
                i, j = np.nonzero(sims >= least[q][:, None])
                found.append((q[i], sims[i, j], ids[rows[j]]))
                seen += sims.size
            if found:
                q, sims, who = (np.concatenate([f[k] for f in found]) for k in range(3))
                best.offer(q, np.rint(np.round(sims, 6) * 1e6).astype(np.int64), who)
    return best, seen


NEAR = "cid long, near array<struct<s:long,who:long>>, verified long"


def _search_cell(size: int, width: int, limit: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        ids = table.column("cid").to_numpy()
        seed = 1000 + 100 * table.column("top")[0].as_py()
        best, seen = search(unit(table.column("vec").to_pylist(), size), ids, width, seed, limit)
        real = best.who < np.iinfo(np.int64).max
        flat = pa.StructArray.from_arrays([pa.array(-best.sim[real]), pa.array(best.who[real])], names=["s", "who"])
        ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
        verified = np.full(len(ids), seen // max(1, len(ids)), dtype=np.int64)
        return pa.table({"cid": ids, "near": pa.ListArray.from_arrays(pa.array(ends), flat), "verified": verified})

    return run


def partitions(sample: np.ndarray, n: int, size: int) -> list[Partition]:
    """``TOPS`` independent partitions of ``n`` vectors into cells of about ``CELL``, from a sample of them."""
    target = max(min(LEAST, len(sample)), CELL * len(sample) // max(n, 1))
    levels = max(0, math.ceil(math.log2(max(1.0, target * n / max(len(sample), 1) / CELL)))) if len(sample) else 0
    return [Partition(sample @ projection(size, 7 + t), target, levels) for t in range(TOPS)]


def class_neighbours(groups: DataFrame, width: int, size: int, limit: float) -> DataFrame:
    """(cid, near, verified): the ``width`` best of every class (cid, vec), as (-millionths, cid), and how many vectors were verified."""
    n = groups.count()
    rows = groups.select("cid", "vec").sample(min(1.0, SAMPLE / max(n, 1)), seed=5).orderBy("cid").limit(2 * SAMPLE).collect()
    sample = unit([bytes(r["vec"]) for r in rows], size) if rows else np.zeros((0, size))
    tops = groups.sparkSession.sparkContext.broadcast(partitions(sample, n, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = unit(b.column("vec").to_pylist(), size)
                for t, p in enumerate(tops.value):
                    yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("vec"), pa.array(np.full(len(v), t, dtype=np.int32)), pa.array(p.locate(v @ projection(size, 7 + t)))], names=["cid", "vec", "top", "cell"])

    placed = groups.select("cid", "vec").mapInArrow(place, "cid long, vec binary, top int, cell long")
    found = placed.groupBy("top", "cell").applyInArrow(_search_cell(size, width, limit), NEAR)
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, width)
    return found.groupBy("cid").agg(best.alias("near"), F.sum("verified").alias("verified"))


def nearest(vectors: DataFrame, k: int = 5, size: int = 64, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, neighbour, rank, sim): the ``k`` most similar usable vectors of every usable one of (id, embedding).

    ``sim`` is the cosine rounded to six decimals, ties go to the smaller id, and nothing is its own neighbour.
    Vectors that are null, of another length, all zero or not finite take no part; with fewer than k + 1 usable ones
    the lists are shorter; repeated ids count once.  The search is approximate (see above): some true neighbours are
    missed and the next ones take their place; what is found has its exact similarity.
    """
    limit = chi_square_quantile(confidence, DIMS)
    width = k + 1
    rows = scratch(usable(vectors, size).groupBy("id").agg(F.first("vkey").alias("vkey"), F.first("vec").alias("vec")), "usable")
    order = Window.partitionBy("vkey").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= width)
    groups = scratch(kept.groupBy("vkey").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec")).select(F.col("ids")[0].alias("cid"), "ids", "vkey", "vec"), "classes")
    found = class_neighbours(groups, width, size, limit).select("cid", F.explode("near").alias("x")).select("cid", F.col("x.s").alias("s"), F.col("x.who").alias("who"))
    # classes to ids: at most k + 1 of a class can matter
    ids = found.join(groups.select(F.col("cid").alias("who"), "ids"), "who").select("cid", F.transform("ids", lambda i: F.struct(F.col("s").alias("s"), i.alias("neighbour"))).alias("near"))
    lists = ids.groupBy("cid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, width).alias("near"))
    members = rows.select("id", "vkey").join(groups.select("vkey", "cid"), "vkey").join(lists, "cid")
    return members.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("at", "x")).select(
        "id", F.col("x.neighbour").alias("neighbour"), (F.col("at") + 1).alias("rank"), (-F.col("x.s") / F.lit(1e6)).alias("sim")
    )
