"""Calls of the store on small tables, and the rules they keep."""

import json
from datetime import datetime

import pytest

from loomstore import schema as S
from loomstore.api import MemoryStore
from loomstore.functions import columns as C
from loomstore.functions.embed import embed
from loomstore.operators import dedup, graph, hashes, ledger, links, metrics, reads, search, writes
from tests.conftest import rows
from pyspark.sql import functions as F

NOW = datetime(2026, 1, 1)
ENTRY = "ord long, user_id string, content string, metadata string, namespace string, importance int"
BASE = "The resolver keeps every retry of the night in one bounded queue and reports them to the owner"


def memory(i, content, user="u", ns="default", metadata="{}", archived=False, importance=3, day=1):
    import hashlib

    return (i, user, content, metadata, ns, None, hashlib.sha256(content.encode()).hexdigest() if content is not None else None, None, None, 1, archived, importance, datetime(2025, 1, day), datetime(2025, 1, day))


def uid(n):
    return f"0000000{n}-0000-4000-8000-000000000000"


@pytest.fixture(scope="module")
def store(spark):
    m = [
        memory(uid(1), BASE, metadata=json.dumps({"entity_name": "Resolver", "links": [{"type": "calls", "target": uid(2), "description": "x"}, {"type": "solves", "target": "a-name"}, {"type": "solves", "target": uid(9)}, {"target": uid(2)}]})),
        memory(uid(2), "a fact about the user", ns="user_facts", day=2), memory(uid(3), "old and gone", archived=True, day=3), memory(uid(4), "something else entirely", importance=None, day=4),
    ]
    memories = spark.createDataFrame(m + m[:1], S.MEMORIES)
    relations = spark.createDataFrame(
        [("e1", uid(1), uid(2), None, "calls", None, 1.0, "{}", datetime(2025, 2, 1)), ("e2", uid(2), uid(4), None, "Calls ", None, 1.0, "{}", datetime(2025, 2, 2)), ("e3", uid(4), uid(1), None, "solves", None, 1.0, S.SYNCED, datetime(2025, 2, 3)), ("e4", uid(1), None, "nowhere", "references", None, 1.0, "{}", datetime(2025, 2, 4))],
        S.RELATIONS,
    )
    names = spark.createDataFrame([("n1", "default", "Default", None, NOW, NOW), ("n2", "user_facts", "User Facts", "", NOW, NOW)], S.NAMESPACES)
    h = spark.createDataFrame([], S.HASHES).drop("id")
    v = embed(reads.once(reads.active(memories).select("id", "content", "user_id", "namespace", "importance"))).drop("content")
    return MemoryStore(memories, relations, names, h, v, NOW)


def test_reads(store):
    assert store.get(uid(3)).count() == 1
    with pytest.raises(KeyError):
        store.get("none")
    page, total = store.list(limit=2)
    assert [r.id for r in page.collect()] == [uid(4), uid(2)] and total == 3
    assert store.list(offset=50)[1] == 0  # an empty page has no total
    assert store.recent(since=datetime(2025, 1, 2)).count() == 2
    assert rows(store.list_namespaces()) == [("default", "Default", ""), ("user_facts", "User Facts", "")]


def test_search(store, spark):
    hits = store.search("the resolver keeps every retry", threshold=0.4).collect()
    assert hits[0].id == uid(1)
    assert store.search("resolver", user_id="other", threshold=0.0).count() == 0
    text = MemoryStore(store.memories, store.relations, store.namespaces, store.hashes)
    assert [r.id for r in text.search("FACT user").collect()] == [uid(2)]
    assert text.search("...").count() == 0
    with pytest.raises(ValueError):
        store.search("  ")


def test_batch_search_agrees_with_single(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(str(i), [float(x) for x in rng.standard_normal(8)], "u", "n", 1) for i in range(60)] + [("null", None, "u", "n", 1), ("zero", [0.0] * 8, "u", "n", 1), ("short", [1.0], "u", "n", 1)], "id string, embedding array<double>, user_id string, namespace string, importance int")
    q = pts.where("id IN ('3', '14')").withColumnRenamed("id", "query_id")
    got = rows(search.top_k_batch(pts, q, 4))
    for r in q.collect():
        one = search.top_k(pts, list(r.embedding), 4, None).collect()
        assert [(r.query_id, x.id, x.score) for x in sorted(one, key=lambda x: x.id)] == sorted(g for g in got if g[0] == r.query_id)
    lsh = set(rows(search.top_k_lsh(pts, q, 60, 0.7)))
    exact = set(rows(search.top_k_batch(pts, q, 60, 0.7)))
    assert lsh <= exact and len(lsh) >= 0.9 * len(exact)
    assert search.top_k_batch(pts, q.limit(0), 4).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_lsh_recall_of_the_registered_query(spark, sf):
    from loomstore.plans import analysis

    d = f"/root/testdata/{sf}"
    found = set(rows(analysis.knn_batch_lsh(spark, d)))
    e = analysis.read_table(spark, d, "embeddings").select(analysis.F.col("vec_id").alias("id"), "embedding")
    true = set(rows(search.top_k_batch(e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10, 0.3)))
    others = {x for x in true if x[0] != x[1]}
    print(sf, "recall", len(found & true), len(true), "without the query itself", len(found & others), len(others))
    assert len(found & true) >= 0.9 * len(true) and len(found & others) >= 0.9 * len(others)


def test_every_embedding_takes_part(spark):
    from loomstore.plans import analysis

    d = "/root/testdata/sf0.1"
    n = analysis.read_table(spark, d, "embeddings").count()
    assert analysis.vectors(spark, d).select("embedding").distinct().count() == n
    assert analysis.vectors(spark, d).select("id").distinct().count() == analysis.reads.active(analysis.memories(spark, d)).select("id").distinct().count()


def test_decisions(store, spark):
    entries = [
        (1, "u", BASE, None, "default", None), (2, "u", "a fact about the user", None, "user_facts", None), (3, "u", BASE + " now", None, "default", None), (4, "other", BASE + " now", None, "default", None),
        (5, "u", BASE + " now", '{"entity_name": " other "}', "default", None), (6, "u", BASE + " now", '{"entity_name": "RESOLVER "}', None, None), (7, "u", "", None, "default", None), (8, "u", None, None, "default", None), (9, "u", "old and gone", None, "default", None),
    ]
    out = {r.ord: (r.action, r.existing_id) for r in dedup.decisions(spark.createDataFrame(entries, ENTRY), store.memories).collect()}
    assert out == {1: ("skip", uid(1)), 2: ("update", uid(2)), 3: ("skip", uid(1)), 4: ("insert", None), 5: ("insert", None), 6: ("skip", uid(1)), 7: ("insert", None), 9: ("skip", uid(3))}
    live = dedup.decisions(spark.createDataFrame(entries[-1:], ENTRY), store.memories, include_archived=False).first()
    assert live.action == "insert"
    assert {r.action for r in dedup.decisions(spark.createDataFrame(entries, ENTRY), store.memories, enabled=False).collect()} == {"insert"}
    assert dedup.decisions(spark.createDataFrame([], ENTRY), store.memories).count() == 0


def test_thresholds_are_inclusive_and_by_namespace(spark):
    ns = spark.createDataFrame([("default",), ("user_facts",), ("dialogue_insights",), ("unheard_of",), (None,)], "ns string")
    assert rows(ns.select("ns", C.threshold(F.col("ns")).alias("t"))) == [("default", 0.95), ("dialogue_insights", 0.85), ("unheard_of", 0.95), ("user_facts", 0.9), (None, 0.95)]


def test_ingest_is_idempotent(store, spark):
    entries = spark.createDataFrame([(1, "u", "fresh text number one", '{"links": [{"type": "calls", "target": "%s"}]}' % uid(1), "new_space", 0), (2, "u", "fresh text number one", None, "new_space", 0), (3, "u", "a fact about the user", '{"k": "v"}', "user_facts", None)], ENTRY)
    new, results = store.ingest(entries, apply_updates=True)
    assert rows(results, "ord", "action", "namespace") == [(1, "insert", "new_space"), (2, "skip", "new_space"), (3, "update", "user_facts")]
    made = new.memories.where("content = 'fresh text number one'").collect()
    assert rows(results, "ord", "id") == [(1, made[0].id), (2, made[0].id), (3, uid(2))]
    assert len(made) == 1 and made[0].importance == 3 and made[0].namespace_id is not None
    assert new.namespaces.where("uid = 'new_space'").first().name == "New Space"
    assert new.relations.where(F.col("source_id") == made[0].id).count() == 1
    assert json.loads(new.memories.where(F.col("id") == uid(2)).first().metadata) == {"k": "v"}
    again, results = new.ingest(entries)
    assert rows(results, "action") == [("skip",), ("skip",), ("update",)]
    with pytest.raises(ValueError):
        store.store("  ", "u")


def test_update_delete_archive_forget(store):
    after = store.update(uid(2), content="changed").get(uid(2)).first()
    assert after.content == "changed" and after.updated_at == NOW and after.content_hash == store.get(uid(2)).first().content_hash
    with pytest.raises(KeyError):
        store.update("none")
    less, found = store.delete(uid(2))
    assert found and rows(less.relations, "id", "target_id") == [("e1", None), ("e3", uid(1)), ("e4", None)] and less.vectors.where(F.col("id") == uid(2)).count() == 0
    assert store.delete("none")[1] is False
    assert store.archive(uid(3))[1] is False and store.archive(uid(4))[1] is True
    left, n = store.forget("u", "default")
    assert n == 2 and rows(reads.active(left.memories), "id") == [(uid(2),)]


def test_insert_refuses_live_repeats(store):
    with pytest.raises(ValueError):
        writes.insert_memories(store.memories, store.memories.where(F.col("id") == uid(2)), NOW)
    old = store.memories.where(F.col("id") == uid(3))
    assert writes.insert_memories(store.memories, old, NOW).count() == store.memories.count() + 1  # only the archived one has it


def test_metadata_merge(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}', '{"b": 3, "d": null}'), (None, '{"x": "y"}'), ("{}", None)], "old string, new string")
    got = [json.loads(r[0]) for r in df.select(F.to_json(C.merge_metadata(F.col("old"), F.col("new")), {"ignoreNullFields": "false"})).collect()]
    assert got == [{"a": 1, "b": 3, "d": None}, {"x": "y"}, {}]


def test_links_from_metadata(store):
    made = rows(links.link_rows(store.memories, store.memories, NOW), "target_id", "target_name", "link_type")
    assert made == [(uid(2), None, "calls"), (None, "a-name", "solves")]
    once = links.backfill(store.relations, store.memories, NOW)
    assert once.count() == 5  # the call is there already, the name is added
    assert links.backfill(once, store.memories, NOW).count() == 6  # links to names never conflict
    ids = store.memories.sparkSession.createDataFrame([(uid(4),)], "id string")
    assert rows(links.delete_synced(store.relations, ids), "id") == [("e1",), ("e2",), ("e4",)]


def test_link_by_name(store):
    new, made = store.link("Resolver", uid(4), "informs", weight=2.0)
    assert made and new.relations.where("link_type = 'informs'").first().source_id == uid(1)
    assert store.link("Resolver", "nobody")[1] is False
    with pytest.raises(ValueError):
        store.link("Resolver", uid(4), "no_such_type")
    assert store.unlink(uid(1), uid(2), "calls")[1] is True and store.unlink(uid(1), uid(2), "solves")[1] is False


def test_graph(store):
    r = reads.clean_relations(store.relations)
    assert rows(graph.walk(r, uid(1), 5)) == [(uid(1), 0), (uid(2), 1), (uid(4), 2)]
    assert rows(graph.reachable(r, uid(1), 50)) == rows(graph.walk(r, uid(1), 5))
    assert rows(graph.reachable(r, uid(1), 5, ["solves"])) == [(uid(1), 0)]
    nodes, edges = store.traverse(uid(1), 3)
    assert rows(nodes, "id") == [(uid(1),), (uid(2),), (uid(4),)] and rows(edges, "id") == [("e1",), ("e2",), ("e3",)]
    with pytest.raises(KeyError):
        store.traverse("none")
    s = store.graph_stats().first()
    assert (s.total_granules, s.total_relations, s.linked_granules, s.orphans, s.avg_connections) == (3, 4, 3, 0, 2.67)
    assert json.loads(s.by_link_type) == {"calls": 2, "references": 1, "solves": 1}
    empty = graph.stats_json(store.memories.limit(0), r.limit(0)).first()
    assert (empty.total_granules, empty.avg_connections, empty.by_namespace) == (0, 0.0, "{}")
    assert rows(store.get_relations(uid(1)), "id", "direction") == [("e1", "outgoing"), ("e3", "incoming"), ("e4", "outgoing")]


def test_hashes(store, spark):
    ddl = "source_type string, source_id string, content_hash string, size_bytes long, metadata string, ord int"
    good = [("file", "a", "a" * 64, 1, '{"project_id": "p"}', 1), ("file", "a", "b" * 64, 2, None, 2), ("session", "s", "c" * 64, 3, None, 3)]
    bad = [("folder", "a", "a" * 64, 1, None, 4), ("file", "a", "xyz", 1, None, 5), ("file", " ", "a" * 64, 1, None, 6), ("file", "b", "a" * 64, 1, "x" * 70_000, 7)]
    one, refused = store.hash_upsert(spark.createDataFrame(good + bad, ddl))
    assert rows(refused, "problem") == [("blank",), ("content_hash",), ("metadata",), ("source_type",)]
    assert one.hash_get("file", "a").first().content_hash == "b" * 64
    from dataclasses import replace

    later = replace(one, now=datetime(2026, 2, 2))
    two, _ = later.hash_upsert(spark.createDataFrame([("file", "a", "b" * 64, 9, None, 1), ("session", "s", "d" * 64, 3, None, 1)], ddl))
    assert rows(two.hashes, "source_id", "size_bytes", "updated_at") == [("a", 9, NOW), ("s", 3, datetime(2026, 2, 2))]
    assert two.hash_list(limit=9999).count() == 2 and two.hash_delete("file", "a")[0].hashes.count() == 1 and two.hash_delete("file", "zz")[1] is False


def test_ledger(store, spark):
    empty = spark.createDataFrame([], "memory_id string, status string, error_msg string, migrated_at timestamp_ntz")
    assert ledger.status(empty).first().pct_complete == 100.0
    full = ledger.mark(ledger.seed(empty, store.memories), spark.createDataFrame([(uid(1),)], "memory_id string"), "migrated", NOW)
    s = ledger.status(full).first()
    assert (s.total, s.pending, s.migrated, s.pct_complete) == (3, 2, 1, 33.33)
    assert rows(ledger.pending(full, store.memories), "id") == [(uid(2),), (uid(4),)]
    assert ledger.reconcile(store.memories, full, store.vectors).first().verdict == "MISMATCH"
    assert json.loads(ledger.points(store.memories, store.vectors).where(F.col("id") == uid(4)).first().payload)["importance"] == 3
    assert ledger.progress(0, 0, 0) == {"rate": 0.0, "pct": 0.0, "eta": 0.0}
    with pytest.raises(ValueError):
        ledger.mark(full, spark.createDataFrame([], "memory_id string"), "lost", NOW)


def test_metrics(spark):
    log = spark.createDataFrame([(datetime(2025, 1, 1, 0, 0, s), "a", float(s)) for s in range(0, 60, 5)], "ts timestamp_ntz, series string, value double")
    h = metrics.histogram(log, [10, 30], ["series"])
    assert rows(h, "n") == [(12,), (3,), (7,)]
    assert metrics.histogram_quantile(h, 0.5, ["series"]).first()["quantile"] == pytest.approx(25.0)
    assert metrics.histogram_quantile(h, 0.99, ["series"]).first()["quantile"] == 30.0
    rate = metrics.rate(log, ["series"], 60, 30).orderBy("at").collect()
    assert sum(r.increase for r in rate) == 24
    states = spark.createDataFrame([(i * 30, f) for i, f in enumerate([True, True, True, False, True, True])], "at long, firing boolean")
    assert [r.alert for r in metrics.holds(states, [], 60).orderBy("at").collect()] == [False, False, True, False, False, False]
    snaps = spark.createDataFrame([("a", datetime(2025, 1, 1), 10), ("b", datetime(2025, 1, 1), 5), ("a", datetime(2025, 1, 1, 2), 30)], "namespace string, at timestamp_ntz, n long")
    assert rows(metrics.growth(snaps), "namespace", "per_hour") == [("a", 10.0), ("b", 0.0)]


def test_arrays_and_cache(spark, store):
    assert rows(reads.from_arrays(spark, a=["x", "y"], b=[1]), "a", "b", "ord") == [("x", 1, 0), ("y", None, 1)]
    key = "embedding:" + __import__("hashlib").sha256(b"old and gone").hexdigest()
    cache = spark.createDataFrame([(key, [1.0], datetime(2027, 1, 1))], "key string, embedding array<float>, expires_at timestamp_ntz")
    hits = {r.content: r.hit for r in search.embed_missing(store.memories, cache, NOW).collect()}
    assert hits["old and gone"] is True and sum(hits.values()) == 1
    late = search.embed_missing(store.memories, cache, datetime(2028, 1, 1))
    assert late.where("hit").count() == 0


def test_upsert_is_idempotent(store):
    first = writes.upsert_memories(store.memories, store.memories.limit(0).withColumn("ord", F.lit(0)), NOW)
    assert {r.action for r in first.collect()} == {"kept"}
    change = store.memories.where(F.col("id") == uid(2)).withColumns({"ord": F.lit(1), "importance": F.lit(5)})
    a = writes.upsert_memories(reads.once(store.memories), change, NOW)
    b = writes.upsert_memories(a.drop("action"), change, NOW)
    assert rows(a) == rows(b)
