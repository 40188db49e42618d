import random

import pytest

from loomstore.llm import history as H
from loomstore.llm.history import History
from loomstore.llm.texts import words

HIST, INPUT = "id string, namespace string, content string, cid long, words string", "input_id long, namespace string, content string, born long"


def brute(old, new):
    def grams(t):
        w = words(t)
        return frozenset(zip(w, w[1:], w[2:])), tuple(w)

    seen = [(ns or "default", *grams(t)) for ns, t in old if t is not None]
    out = set()
    for i, ns, t in sorted(new, key=lambda r: r[0]):
        if t is None:
            continue
        ns, (g, w) = ns or "default", grams(t)
        for n, h, v in seen:
            if n == ns and (v == w or (g & h and 2 * len(g & h) >= len(g | h))):
                out.add(i)
                break
        seen.append((ns, g, w))
    return out


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(n)]
    out = []
    for _ in range(n * 3):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], "extra"]])
            w = w or ["x"]
        out.append(" ".join(w))
    return out


def test_known_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 40)  # so that hot fingerprints are split here too
    rng = random.Random(4)
    old = [(rng.choice(["a", "b", None]), t) for t in texts(rng, 60)]
    new = [(i + 1, rng.choice(["a", "b", "default"]), t) for i, t in enumerate(texts(rng, 60))]
    old += [("a", None), ("a", ""), ("a", "two words")]
    new += [(1000, "a", None), (1001, "a", "..."), (1002, "a", "Two WORDS"), (1003, "b", "two words"), (1004, "a", "other words")]
    h = spark.createDataFrame([(str(i), ns, t, 0, "x") for i, (ns, t) in enumerate(old)], HIST)
    n = spark.createDataFrame([(i, ns, t, 0) for i, ns, t in new], INPUT)
    got = {r.input_id for r in History.open(h, store=False).known(n, batch_rows=500).collect()}
    assert got == brute(old, new)


@pytest.mark.parametrize("most,hits", [(5, 6_000_000), (1000, 50)])
def test_many_near_copies(spark, monkeypatch, most, hits):
    """Fingerprints with more texts than are compared at first: found among the first, or in the exact second turn."""
    monkeypatch.setattr(H, "MOST", most)
    monkeypatch.setattr(H, "HITS", hits)
    common = " ".join(f"c{i}" for i in range(12))
    old = [("a", f"{common} x{i} y{i}") for i in range(60)] + [("a", f"{common} " + " ".join(f"z{i}_{k}" for k in range(14))) for i in range(60)]
    new = [(i + 1, "a", f"{common} n{i} m{i}") for i in range(10)] + [(50 + i, "a", f"{common} " + " ".join(f"z{i} {k}" if k < 13 else "q" for k in range(14))) for i in range(60)] + [(500, "a", common + " " + " ".join(f"u{k}" for k in range(30)))]
    h = spark.createDataFrame([(str(i), ns, t, 0, "") for i, (ns, t) in enumerate(old)], HIST)
    got = {r.input_id for r in History.open(h, store=False).known(spark.createDataFrame([(*r, 0) for r in new], INPUT)).collect()}
    want = brute(old, new)
    assert got == want and 500 not in want and len(want) > 60


def test_batches_add_up(spark):
    rng = random.Random(9)
    old = [("a", t) for t in texts(rng, 25)]
    new = [(i + 1, "a", t) for i, t in enumerate(texts(rng, 25))]
    history = History.open(spark.createDataFrame([(str(i), ns, t, 0, "") for i, (ns, t) in enumerate(old)], HIST))
    got = set()
    for a in range(0, len(new), 30):
        batch = spark.createDataFrame([(*r, 0) for r in new[a : a + 30]], INPUT)
        got |= {r.input_id for r in history.known(batch).collect()}
        history = history.accept(batch)
    assert got == brute(old, new)


def test_copies_empty_and_long(spark):
    empty = spark.createDataFrame([], HIST)
    long = " ".join(f"t{i}" for i in range(40_000))
    n = spark.createDataFrame([(i, "a", "many copies of one text") for i in range(1, 200)] + [(200, None, long), (201, "default", long + " more")], "input_id long, namespace string, content string")
    got = {r.input_id for r in History.open(empty, store=False).known(n).collect()}
    assert got == set(range(2, 200)) | {201}
    assert History.open(empty, store=False).known(n.limit(0)).count() == 0


def test_hits_that_cannot_be_pairs_stay_in_the_bucket():
    """Texts of 40 sequences that share only late, frequent ones, or texts of very unlike length, give no hits; near copies do."""
    import pyarrow as pa

    def rows(*r):
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("bucket", "key", "cid", "born", "n", "at", "ask"), zip(*r), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))})

    late = rows(*[(0, k, 1, 0, 40, at, False) for k, at in ((1, 20), (2, 21))], *[(0, k, 2, 5, 40, at, True) for k, at in ((1, 20), (2, 21))])
    assert H.bucket_hits(10, None)(late).num_rows == 0
    unlike = rows((0, 1, 1, 0, 90, 0, False), (0, 1, 2, 5, 40, 0, True))
    assert H.bucket_hits(10, None)(unlike).num_rows == 0
    early = rows(*[(0, k, 1, 0, 40, k, False) for k in range(4)], *[(0, k, 2, 5, 40, k, True) for k in range(4)])
    assert H.bucket_hits(10, None)(early).to_pylist() == [{"q": 2, "h": 1, "need": 4}] * 4
