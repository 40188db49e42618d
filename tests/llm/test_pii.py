import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomstore.llm import pii
from loomstore.llm.pii import find
from loomstore.llm.pii_corpus import openings


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "name": "Interview with Clara Stenholt about the cache. The queue of Belora was audited.",
        "email": "Write to clara.stenholt@example.org if the cache is merged.",
        "hidden": "contact: ana-lund [at] belora [dot] example",
        "phone": "Left a voicemail at (312) 555-0187 about the lazy agent.",
        "id": "On file: passport X12345678; the index was audited.",
        "address": "Ship the slow badge to 14 Belora Lane, Marwick. The queue is idle.",
        "plain": "The package belora_cache@2.3.11 was patched. Build 912-33-4411 passed and ticket 4312-9981 was merged.",
        "plain2": "Connect with postgres://svc:hidden@db-11.internal.invalid:5432/belora_cache before the release.",
        "ru": "Позвать на встречу: Тамара Веренова, тема журнал.",
        "empty": "", "null": None, "long": "The slow queue of Belora was audited. " * 4000 + "call +1 312 555 0142 when the queue is idle",
    }
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in texts.items()] + [("name", texts["name"], "x", "y"), (None, "tel 0301 123456", "", "")], "id string, content string, kinds string, redacted string")
    return {r.id: r for r in find(df).collect()}


def test_kinds(found):
    assert {k: r.kinds for k, r in found.items()} == {
        "name": ["name"], "email": ["email"], "hidden": ["email"], "phone": ["phone"], "id": ["idnum"], "address": ["address"], "ru": ["name"], "long": ["phone"],
    }


def test_placeholders_leave_the_rest(found):
    assert found["name"].redacted == "Interview with [NAME] about the cache. The queue of Belora was audited."
    assert found["phone"].redacted == "Left a voicemail at [PHONE] about the lazy agent."
    assert found["email"].redacted == "Write to [EMAIL] if the cache is merged."


def test_held_out_accuracy():
    """Labels of generated text that the weights have not seen: what the fit has learned, not how it does on other text."""
    m = pii.fitted()
    parts, gold, sizes = pii._training_set(300, 4242, m.words)
    ends = np.cumsum(sizes)
    u = pii.Reader(m).unary(parts, sizes)
    got = pii.infer(u, sizes, pii.skip_edges(parts, list(ends - sizes), list(ends)), m)[0].argmax(axis=1)
    assert (got == gold).mean() > 0.99
    for k in range(1, pii.K):
        assert ((got == k) & (gold == k)).sum() / (gold == k).sum() > 0.9


def test_frames_are_not_the_tables():
    """How many openings of two words or more of the frames stand word for word in the memories: everyday phrases only."""
    text = "\n".join(x for x in pq.read_table("/root/testdata/sf0.01/memories.parquet", columns=["content"])["content"].to_pylist() if x).lower()
    all_of = openings()
    found = [o for o in all_of if o.lower() in text]
    assert len(all_of) > 150 and len(found) <= 0.03 * len(all_of), found


def test_skip_edges_carry_a_label():
    """A repeated or similar word takes the label of its clear occurrence."""
    m = pii.Model({})
    m.skip = np.float32(2.5)
    parts = ["Stenholt", "x", "Stenholts"]
    u = np.zeros((3, pii.K), dtype=np.float32)
    u[:, 0] = [0.3, 4.0, 0.0]
    u[2, 1] = 6.0
    edges = pii.skip_edges(parts, [0], [3])
    assert edges.tolist() == [[0], [2]]
    assert pii.infer(u, np.array([3]), np.empty((2, 0), dtype=np.int64), m)[0].argmax(axis=1)[0] == 0
    assert pii.infer(u, np.array([3]), edges, m)[0].argmax(axis=1)[0] == 1


def test_messages_settle_on_the_exact_marginals():
    """One edge that closes no loop: message passing gives the sums over all labellings."""
    from itertools import product

    rng = np.random.default_rng(3)
    m = pii.Model({})
    m.skip, m.step = np.float32(1.3), np.zeros((pii.K, pii.K), dtype=np.float32)
    u = rng.normal(size=(3, pii.K)).astype(np.float32)
    got = pii.infer(u, np.array([3]), np.array([[0], [2]]), m)[0]
    want = np.zeros((3, pii.K))
    for y in product(range(pii.K), repeat=3):
        w = np.exp(sum(u[i, k] for i, k in enumerate(y)) + m.skip * (y[0] == y[2]))
        for i, k in enumerate(y):
            want[i, k] += w
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_batches_are_cut_by_characters():
    b = pa.RecordBatch.from_pydict({"content": ["a" * 5, "b" * 50, None, "c" * 4, "d" * 4, ""]})
    assert [x.num_rows for x in pii.by_size(b, "content", 10)] == [1, 1, 4] and sum(x.num_rows for x in pii.by_size(b, "content", 1)) == 6


def test_tokens_join_to_the_text():
    t = "  Ab-12\n(x)  "
    assert "".join(pii.tokens(t)) == t


def test_empty_table(spark):
    assert find(spark.createDataFrame([], "id string, content string")).count() == 0
