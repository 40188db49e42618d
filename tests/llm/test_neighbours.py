import numpy as np
import pyarrow.parquet as pq

from loomstore.llm import neighbours as N
from loomstore.llm.neighbours import nearest


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float32).astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for j in range(len(ids)):
        s[j, j] = -9
        for t in np.lexsort((ids, -s[j]))[:k]:
            if t != j:
                out.add((int(ids[j]), int(ids[t])))
    return out


def vectors(n, seed=0, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    x = [centres[rng.integers(12)] + 0.3 * rng.standard_normal(size) if rng.random() < 0.7 else rng.standard_normal(size) * rng.uniform(0.1, 5) for _ in range(n)]
    return [[float(np.float32(a)) for a in v] for v in x]


def test_recall_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 1200)
    rows = list(enumerate(_units("sf0.1")[:2200].tolist(), 1))
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r.id, r.neighbour) for r in nearest(df).collect()}
    want = brute(rows)
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def _units(name):
    lists = [x for x in pq.read_table(f"/root/testdata/{name}/dedup_decisions.parquet", columns=["embedding"])["embedding"].to_pylist() if x is not None and len(x) == 64]
    v = np.array(lists, dtype=np.float32)
    v = np.unique(v[np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)], axis=0).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_recall_and_visits_on_the_larger_table():
    """One cell of the whole table: recall over brute force, and no more verified pairs a query than the stated bound."""
    v = _units("sf0.1")
    ids = np.arange(len(v))
    both = N.Best(len(v), 6)
    seen = 0
    for top in range(N.TOPS):
        best, n = N.search(v, ids, 6, 1000 + 100 * top, N.chi_square_quantile(N.CONFIDENCE, N.DIMS))
        both.offer(np.repeat(ids, 6), best.sim.reshape(-1), best.who.reshape(-1))
        seen += n
    hit = 0
    for i in range(0, len(v), 10):
        s = np.rint(np.round(v @ v[i], 6) * 1e6)
        s[i] = -9e6
        hit += len(set(np.lexsort((ids, -s))[:5]) & set(both.who[i].tolist()))
    assert hit / (5 * len(range(0, len(v), 10))) >= 0.95
    assert seen / len(v) <= N.TOPS * N.TREES * N.VISITS * N.LEAF


def test_cells_are_bounded_beyond_the_sample(monkeypatch):
    """Cells that the sample is too small for come from further cuts."""
    monkeypatch.setattr(N, "CELL", 50)
    v = np.random.default_rng(2).standard_normal((6000, 64))
    p = N.partitions(v[:300], len(v), 64)[0]
    sizes = np.unique(p.locate(v @ N.projection(64, 7)), return_counts=True)[1]
    assert p.levels >= 2 and sizes.max() < 250 and sizes.sum() == 6000


def test_copies_ties_and_unusable(spark):
    same = vectors(1, 3)[0]
    rows = [(i, same) for i in range(40, 0, -1)] + [(100 + i, v) for i, v in enumerate(vectors(30, 5))]
    bad = [(200, None), (201, []), (202, [1.0] * 32), (203, [0.0] * 64), (204, [float("nan")] + [1.0] * 63), (None, same), (7, same)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], "id long, embedding array<float>, cid long, vec string")
    got = {(r.id, r.neighbour) for r in nearest(df).collect()}
    assert got == brute(rows)
    assert {b for a, b in got if a == 3} == {1, 2, 4, 5, 6} and {b for a, b in got if a == 30} == {1, 2, 3, 4, 5}
    assert nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[-3:], "id long, embedding array<float>")
    assert {(r.id, r.neighbour) for r in nearest(few).collect()} == brute(rows[-3:])


def test_chi_square():
    assert abs(N.chi_square_quantile(0.95, 10) - 18.307) < 1e-3 and abs(N.chi_square_quantile(0.99, 2) - 9.2103) < 1e-3
