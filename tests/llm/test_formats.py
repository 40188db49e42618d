import json
import random

import pytest

from loomstore.llm.formats import canonical_contents, content_copies, content_groups
from loomstore.llm.survivors import survivors, truth
from loomstore.llm.texts import canonical, fields, letters, words
from tests.conftest import rows

DDL = "id string, namespace string, content string, user_id string, importance int, metadata string, updated_at timestamp_ntz, raw string, canon string, ns string"


def memory(i, content, ns="a", user="u", importance=3, metadata="{}", updated="2025-01-01 00:00:00"):
    from datetime import datetime

    return (i, ns, content, user, importance, metadata, datetime.fromisoformat(updated) if updated else None, "x", "y", "z")


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Some Text, here.", "some\ttext HERE!!", True),
        ("café", "café", True),
        ("café", "cafe", False),
        ('{"a": 1, "b": "x y"}', '{"b":"X-Y","a":"1"}', True),
        ('{"a": 1, "b": 2}', '{"a": 2, "b": 1}', False),
        ("service: x-1; port: 22; mode: on", "mode: on | service: X 1 | port: 22", True),
        ("service: x; port: 22; mode: on", '{"port": 22, "mode": "on", "service": "x"}', True),
        ("service: x; port: 22; mode: on", "service: x; port: 2; mode: on2", False),
        ("service: x\nport: 22\nmode: on", "service x port 22 mode on", False),
        ("", "  ...  ", True),
        ('{"a": 0.50}', '{"a": 0.5}', False),
    ],
)
def test_same_content(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_prose_is_no_record():
    assert fields("Note: a thing happened; then: another; so: it ended. And more") is None or len(fields("Note: a; Then: b; So: c")) == 3
    assert fields("Say: this.\nSay: that.\nSay: more.") is None  # a key used again
    assert fields('{"a": 1') is None and fields("[1, 2]") is None


def test_words_and_letters():
    assert words("Ünder_score 12-b") == ["ünder", "score", "12", "b"]
    assert letters("A-b C!") == "abc"


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    base = [f"text number {i} of the Set" for i in range(20)] + [json.dumps({"k": i, "v": "x"}) for i in range(10)]
    data = []
    for n in range(300):
        t = rng.choice(base)
        if t[0] == "{":
            d = json.loads(t)
            t = rng.choice([t, json.dumps({k: d[k] for k in reversed(d)}), json.dumps(d, indent=1)])
        else:
            t = rng.choice([t, t.upper(), t.replace(" ", "  "), t + "!"])
        data.append(memory(f"{n:04d}", t, rng.choice(["a", "b", None])))
    data += data[:20]  # delivered twice
    got = {(r.id, r.first_id, r.n_copies) for r in content_groups(spark.createDataFrame(data, DDL)).collect()}
    by = {}
    for r in set(data):
        by.setdefault((r[1] or "default", canonical(r[2])), set()).add(r[0])
    want = {(i, min(v), len(v)) for v in by.values() if len(v) > 1 for i in v}
    assert got == want


def test_hot_group_nulls_empty_and_long(spark):
    long = "word " * 60_000
    data = [memory(f"h{i}", "same  text" if i % 2 else "Same text!") for i in range(400)]
    data += [memory("n", None), (None, "a", "same text", None, None, None, None, None, None, None), memory("l1", long), memory("l2", long.upper()), memory("e1", ""), memory("e2", "??")]
    df = spark.createDataFrame(data, DDL)
    got = {r.id: (r.first_id, r.n_copies) for r in content_groups(df).collect()}
    assert len([i for i in got if i.startswith("h")]) == 400 and got["h5"] == ("h0", 400)
    assert got["l2"] == ("l1", 2) and got["e2"] == ("e1", 2) and "n" not in got
    assert sum(r.n_rows for r in content_copies(df).collect()) == len(data) - 1
    assert canonical_contents(df.limit(0)).count() == 0 and content_groups(df.limit(0)).count() == 0


def test_survivors(spark):
    data = [
        memory("a1", "one", importance=3, metadata='{"k": "v"}', updated="2025-01-01 00:00:00"),
        memory("a2", "ONE", importance=4, metadata='{"k": "v", "l": 1}', updated="2025-01-03 00:00:00"),  # leaves no choice
        memory("b1", "two", importance=5, metadata='{"k": "v"}', updated="2025-01-01 00:00:00"),
        memory("b2", "TWO", importance=4, metadata='{"k": "v"}', updated="2025-01-03 00:00:00"),
        memory("c1", "three", importance=9, metadata="{broken", updated="2025-01-01 00:00:00"),
        memory("c2", "Three", importance=1, metadata="{}", updated="2025-01-02 00:00:00"),  # others' fields don't count
        memory("d1", "four", importance=2, metadata=None, updated="2025-01-01 00:00:00"),
        memory("d2", "four!", importance=2, metadata="{}", updated="2025-01-01 00:00:00"),  # a tie in time
        memory("e1", "five", importance=None, metadata='{"k": ""}', updated=None),
        memory("e2", "five.", importance=3, metadata='{"k": null}', updated="2025-01-01 00:00:00"),
        memory("f1", "alone"),
    ]
    df = spark.createDataFrame(data + data[:2], DDL)
    out = {r.first_id: r for r in survivors(content_groups(df), df).collect()}
    assert {(k, r.best_id) for k, r in out.items() if r.clear} == {("a1", "a2"), ("c1", "c2"), ("e1", "e2")}
    assert set(out) == {"a1", "b1", "c1", "d1", "e1"}
    assert out["a1"].importance in (3, 4) and json.loads(out["a1"].metadata) == {"k": "v", "l": 1}
    assert survivors(content_groups(df.limit(0)), df).count() == 0


def test_truth_follows_the_reliable_source(spark):
    data = []
    for g in range(12):
        for k, (user, value) in enumerate([("good", "right"), ("fine", "right"), ("bad", "wrong")]):
            data.append(memory(f"{g}-{k}", f"content {g}", user=user, metadata=json.dumps({"v": value}), updated=f"2025-01-0{k + 1} 00:00:00"))
    # one against one: the reliable source wins, though the other is later
    data += [memory("x-0", "last", user="good", metadata='{"v": "right"}', updated="2025-01-01 00:00:00"), memory("x-1", "last", user="bad", metadata='{"v": "wrong"}', updated="2025-01-01 00:00:00")]
    df = spark.createDataFrame(data, DDL)
    out = {r.first_id: json.loads(r.metadata)["v"] for r in survivors(content_groups(df), df).collect()}
    assert set(out.values()) == {"right"}


def test_truth_runs_until_it_settles(spark):
    # a chain: each source disagrees with the next one, and only the first has support of its own
    votes = [("g0", f"n{k}", f"help{k}", "$v", "a") for k in range(4)] + [("g0", "n9", "s0", "$v", "a")]
    for k in range(10):
        votes += [(f"c{k}-{j}", f"x{k}-{j}", f"s{k}", "$v", "a") for j in range(6)] + [(f"c{k}-{j}", f"y{k}-{j}", f"s{k + 1}", "$v", "b") for j in range(6)]
    members = spark.createDataFrame([(g, i, s, None, None, {f[1:]: v}) for g, i, s, f, v in votes], "first_id string, id string, source_name string, updated_at timestamp_ntz, importance int, fields map<string,string>")
    want = dict.fromkeys({v[2] for v in votes}, 0.5)
    for _ in range(5000):
        support, total, share = {}, {}, {}
        for g, _, s, f, v in votes:
            support[g, f, v] = support.get((g, f, v), 0) + want[s]
            total[g, f] = total.get((g, f), 0) + want[s]
        for g, _, s, f, v in votes:
            share.setdefault(s, []).append(support[g, f, v] / total[g, f])
        want = {s: (sum(x) + 1) / (len(x) + 2) for s, x in share.items()}
    _, trust = truth(members)
    got = {r.source_name: r.reliability for r in trust.collect()}
    assert set(got) == set(want) and max(abs(got[s] - want[s]) for s in want) < 5e-3
    with pytest.raises(RuntimeError, match="still move"):
        truth(members, most=2)
