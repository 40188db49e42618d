import random

from loomstore.operators import hierarchy as H
from loomstore.operators import orphans as O
from tests.conftest import rows


def brute(links):
    up = dict(links)
    nodes = set(up) | set(up.values())
    out = {}
    for n in nodes:
        at, seen = n, [n]
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        out[n] = ("", -1, []) if at in up else (at, len(seen) - 1, seen[::-1])
    return out


def check(spark, links):
    df = spark.createDataFrame(links, "child string, parent string")
    want = brute(links)
    got = {r.node_id: (r.root_id, r.node_depth, list(r.path)) for r in H.hierarchy(df, with_path=True).collect()}
    assert got == want
    assert {r.node_id: (r.root_id, r.node_depth) for r in H.hierarchy(df).collect()} == {k: v[:2] for k, v in want.items()}


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    links = []
    for i in range(1, 300):
        links.append((f"n{i}", f"n{rng.randrange(max(0, i - 4), i)}"))
    links += [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("below", "l2"), ("deeper", "below"), ("self", "self"), ("under", "self")]
    check(spark, links)


def test_long_chain_and_splitterless_loops(spark):
    links = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(700)]
    for size in (2, 3, 5, 9, 40):
        links += [(f"r{size}-{i}", f"r{size}-{(i + 1) % size}") for i in range(size)]
    check(spark, links)


def test_no_links_and_nulls(spark):
    assert H.hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0
    df = spark.createDataFrame([("a", None), (None, "b"), ("x", "y")], "child string, parent string")
    assert rows(H.hierarchy(df)) == [("x", "y", 1), ("y", "y", 0)]


def test_containment_links_spelling(spark):
    ids = ["a" * 8, "b" * 8, "c" * 8, "d" * 8]
    m = spark.createDataFrame([(i, 1) for i in ids + ids[:1]] + [(None, 1)], "id string, node int")
    r = spark.createDataFrame(
        [("AAAAAAAA", "bbbbbbbb", " Contains "), ("bbbbbbbb", "aaaaaaaa", "CONTAINED-BY"), ("cccccccc", "bbbbbbbb", "contained_by"), ("dddddddd", None, "contains"), ("dddddddd", "zz", "contains"), ("aaaaaaaa", "dddddddd", "calls"), (None, "dddddddd", "contains")],
        "source_id string, target_id string, link_type string",
    )
    assert rows(H.containment_links(r, m)) == [("bbbbbbbb", "aaaaaaaa"), ("cccccccc", "bbbbbbbb")]
    t = H.hierarchy(H.containment_links(r, m), with_path=True)
    assert rows(H.descendants(t)) == [("aaaaaaaa", "bbbbbbbb", 1), ("aaaaaaaa", "cccccccc", 2), ("bbbbbbbb", "cccccccc", 1)]
    assert rows(H.descendant_counts(t)) == [("aaaaaaaa", 2), ("bbbbbbbb", 1), ("cccccccc", 0)]


MEM = "id string, metadata string, is_archived boolean, created_at timestamp_ntz, since int"
REL = "id string, source_id string, target_id string, target_name string, created_at timestamp_ntz, kind int"


def t(day):
    from datetime import datetime

    return datetime(2025, 1, day) if day else None


def test_orphans(spark):
    m = spark.createDataFrame(
        [("a", '{"entity_name": " Foo "}', False, t(5), 0), ("a", '{"entity_name": " Foo "}', False, t(5), 0), ("b", "{broken entity_name", True, t(1), 0), ("c", '{"entity_name": null}', None, t(2), 0), ("d", None, False, None, 0)], MEM
    )
    r = spark.createDataFrame(
        [("R1", "A", "c", "x", t(6), 1), ("r1", "A", "c", "x", t(6), 1), ("r2", "a", None, "FOO", t(4), 1), ("r3", "c", "b", None, t(9), 1), ("r4", "zz", None, "foo", t(9), 1), ("r5", None, "d", None, t(9), 1), ("r6", "c", None, None, None, 1)], REL
    )
    got = rows(O.orphan_references(r, m), "relation_id", "ref_field")
    assert got == [("r2", "source_id"), ("r2", "target_name"), ("r3", "target_id"), ("r4", "source_id"), ("r5", "source_id"), ("r5", "target_id"), ("r6", "source_id")]
    assert rows(O.orphan_counts(O.orphan_references(r, m)).where("month IS NULL")) == [("relations", "source_id", None, 1)]
    assert O.orphan_references(r.limit(0), m).count() == 0
    assert O.orphan_references(r, m.limit(0)).count() == 11


def test_state_resolves_and_reopens(spark):
    refs = spark.createDataFrame([("r1", "source_id", "id", "p", t(5)), ("r2", "source_id", "id", "q", t(5))], "relation_id string, ref_field string, kind string, ref_key string, told_at timestamp_ntz")
    one = O.advance(O.OrphanState.empty(spark), new_refs=refs)
    assert rows(one.refs.where("orphan"), "relation_id") == [("r1",), ("r2",)]
    two = O.advance(one, arrived=spark.createDataFrame([("id", "p", "p", t(4)), ("id", "q", "q", t(6))], O.PARENT))
    assert rows(two.refs.where("orphan"), "relation_id") == [("r2",)]  # q came too late
    again = O.advance(one, arrived=spark.createDataFrame([("id", "p", "p", t(4)), ("id", "q", "q", t(6))], O.PARENT))
    assert rows(again.refs) == rows(two.refs)  # a batch can be run again from the state before it
    three = O.advance(two, new_refs=refs, deleted=spark.createDataFrame([("p",)], "parent_id string"))
    assert rows(three.refs.where("orphan"), "relation_id") == [("r1",), ("r2",)] and three.refs.count() == 2
