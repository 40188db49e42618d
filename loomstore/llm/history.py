"""New entries against all history: exact and near copies by suffix arrays over words.

Every text is a class of its namespace: its words joined by blanks, with a 64-bit id, so copies of one text count
once.  The suffixes of a class are the starts of its three-word sequences; a suffix is compared by the 64-bit
fingerprint of its leading three words and the namespace.  Suffixes are dealt to buckets by fingerprint; in each
bucket the history is one sorted array (the base segment), and every new batch is looked up by binary search in the
segments so far, then becomes an immutable segment itself; segments of like size are merged, so that there are
logarithmically many.  The hits are summed to a coverage per pair of texts, and pairs with enough of it are
compared exactly.

Not every suffix has to be stored.  A shared sketch of fixed size holds how frequent each fingerprint is, and gives
all texts one order, rare first.  Two texts that share half of all their distinct sequences share at least half of
either's; so if each keeps its first  n - ceil(n / 2) + m  suffixes in that order, the pair has at least m (or all
its common ones, if fewer) among the kept.  This loses no pair, whatever the sketch says; m > 1 only thins out chance
candidates.  A pair of x and y sequences must even share  t = ceil((x + y) / 3), so a match counts for it only among the
first  x - t + m  of the one and  y - t + m  of the other, and not at all if t is more than x or y: this loses no pair
either, and what is frequent, and would give most chance matches, stands last.  Inside a bucket 32 bits of the fingerprint are kept: what they confuse is thinned out by m and by the
exact comparison.  A fingerprint more frequent than ``HOT`` is split over several buckets by the history's class id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.llm.formats import NO_NAMESPACE
from loomstore.llm.texts import words
from loomstore.sources.tables import drop_scratch, scratch

#: Words of one compared sequence.
SHINGLE = 3
#: Counters of the frequency sketch (a power of two); its size does not depend on the data.
SKETCH = 1 << 18
SLICES = 16
#: Kept suffixes that a pair must share at least.
MATCHES = 4
#: Occurrences beyond which a fingerprint is split over buckets.
HOT = 50_000
#: Suffixes of one fingerprint that a text is compared with at first; only texts that stay without a partner see the rest.
MOST = 1000
#: Suffixes that a bucket compares at a time; what cannot be part of a pair is dropped before the next.
HITS = 2_000_000
#: Suffixes aimed at per bucket.
BUCKET_ROWS = 400_000

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_seen: dict[str, int] = {}


def class_id(ns: str, joined: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{ns}\x00{joined}".encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def _numbers(parts: list[str]) -> np.ndarray:
    """A stable 64-bit number per word, from a table of the words met so far in this process."""
    if len(_seen) > 1_000_000:
        _seen.clear()
    get = _seen.get
    out = [get(w) for w in parts]
    for i, n in enumerate(out):
        if n is None:
            w = parts[i]
            out[i] = _seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(out, dtype=np.uint64)


def fingerprints(ns: list[str], joined: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint) of every distinct three-word sequence, sorted by text number."""
    parts, sizes = [], np.empty(len(joined), dtype=np.int64)
    for i, t in enumerate(joined):
        w = t.split(" ")
        sizes[i] = len(w)
        parts += w
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _numbers(parts)
    text = np.repeat(np.arange(len(joined)), sizes)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    f = h[:n] * _MUL[0] + np.left_shift(h[1 : n + 1], np.uint64(1)) * _MUL[1] + (h[2 : n + 2] ^ _MUL[2]) * _MUL[2]
    whole = text[:n] == text[SHINGLE - 1 :]
    text, f = text[:n][whole], f[whole]
    salt = np.array([xxhash.xxh64_intdigest(x) for x in ns], dtype=np.uint64)
    f = f + salt[text]
    f ^= f >> np.uint64(32)
    f *= _MUL[0]
    f ^= f >> np.uint64(29)
    order = np.lexsort((f, text))
    text, f = text[order], f[order]
    keep = np.ones(len(f), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (f[1:] != f[:-1])
    return text[keep], f[keep]


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ns, joined = b.column("ns").to_pylist(), [" ".join(words(t)) for t in b.column("content").to_pylist()]
        ids = pa.array([class_id(n, t) for n, t in zip(ns, joined)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("ns"), ids, pa.array(joined, pa.string()), b.column("input_id")], names=["ns", "cid", "words", "input_id"])


def text_rows(records: DataFrame, input_id=None) -> DataFrame:
    """(ns, cid, words, input_id) of each record with a content; a null namespace reads as ``default``."""
    rows = records.where(F.col("content").isNotNull()).select(
        F.coalesce("namespace", F.lit(NO_NAMESPACE)).alias("ns"), "content", (F.lit(None) if input_id is None else input_id).cast("long").alias("input_id")
    )
    return rows.mapInArrow(_class_batches, "ns string, cid long, words string, input_id long")


def classes(rows: DataFrame) -> DataFrame:
    """(cid, ns, words, born): one row per distinct text; ``born`` is the smallest input id, 0 for history."""
    return rows.groupBy("cid").agg(F.first("ns").alias("ns"), F.first("words").alias("words"), F.min(F.coalesce("input_id", F.lit(0))).alias("born"))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, dtype=np.int64)
    for b in batches:
        _, f = fingerprints(b.column("ns").to_pylist(), b.column("words").to_pylist())
        counts += np.bincount((f & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    parts = [p.tobytes() for p in counts.reshape(SLICES, -1)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(c, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])


def frequency_sketch(texts: DataFrame) -> np.ndarray:
    """How often fingerprints occur over all ``texts`` (ns, words), by their low bits: ``SKETCH`` counters, 2 MB."""
    schema = "slice int, counts binary"
    parts = texts.select("ns", "words").mapInArrow(_sketch_batches, schema).repartition(SLICES, "slice").mapInArrow(_sketch_sum, schema)
    out = np.zeros((SLICES, SKETCH // SLICES), dtype=np.int64)
    for r in parts.collect():
        out[r["slice"]] += np.frombuffer(r["counts"], dtype=np.int64)
    return out.reshape(-1)


def _suffix_batches(sketch, buckets: int, new: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for b in batches:
            cid, born = b.column("cid").to_numpy(), b.column("born").to_numpy()
            text, f = fingerprints(b.column("ns").to_pylist(), b.column("words").to_pylist())
            freq = counts[(f & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.lexsort((f, freq, text))
            text, f, freq = text[order], f[order], freq[order]
            n = np.bincount(text, minlength=len(cid))
            at = np.arange(len(f)) - (np.cumsum(n) - n)[text]
            half = (n + 1) // 2
            kept = at < (n - half + np.minimum(MATCHES, half))[text]
            text, f, freq, at = text[kept], f[kept], freq[kept], at[kept]
            parts = 1 + freq // HOT
            rows = [(text, f, (cid[text].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64), np.zeros(len(f), dtype=bool), at)]
            if new:
                which = np.repeat(np.arange(len(f)), parts)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                rows.append((text[which], f[which], turn, np.ones(len(which), dtype=bool), at[which]))
            for t, k, salt, ask, p in rows:
                bucket = ((k >> np.uint64(20)) + salt.astype(np.uint64) * _MUL[1]) % np.uint64(buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.astype(np.int32)), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), pa.array(cid[t]), pa.array(born[t]), pa.array(n[t].astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(ask)],
                    names=["bucket", "key", "cid", "born", "n", "at", "ask"],
                )

    return run


SUFFIX = "bucket int, key int, cid long, born long, n int, at int, ask boolean"


def suffixes(texts: DataFrame, sketch, buckets: int, new: bool) -> DataFrame:
    """The kept suffixes of each class; with ``new`` also the questions that its class asks of every split of a key."""
    return texts.select("ns", "words", "cid", "born").mapInArrow(_suffix_batches(sketch, buckets, new), SUFFIX)


def _merged(a: tuple, b: tuple) -> tuple:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


def bucket_hits(batch_rows: int, most: int | None):
    """For one bucket: batches in the order of arrival, each looked up in the segments before it and in itself.

    An interval of more than ``most`` suffixes gives the ``most`` with the smallest class ids, the same for every
    fingerprint of a group of near copies, and a row (q, q, -1) that says so.  Hits that the lengths of the two texts
    and the places of the suffix in their order rule out are dropped before they leave the bucket.
    """

    def run(table: pa.Table) -> pa.Table:
        key, cid, born = (table.column(c).to_numpy() for c in ("key", "cid", "born"))
        size, place, ask = table.column("n").to_numpy(), table.column("at").to_numpy(), table.column("ask").to_numpy(zero_copy_only=False)
        stored = np.flatnonzero(~ask)
        base = stored[born[stored] == 0]
        base = base[np.lexsort((cid[base], key[base]))]
        segments = [(key[base], base)] if len(base) else []
        fresh, asked = stored[born[stored] > 0], np.flatnonzero(ask)
        fresh, asked = fresh[np.argsort(born[fresh], kind="stable")], asked[np.argsort(born[asked], kind="stable")]
        out_q, out_h, out_n, cut = [], [], [], []
        a = s = 0
        while a < len(asked):
            last = born[asked[min(a + batch_rows, len(asked)) - 1]]
            a2, s2 = np.searchsorted(born[asked], last, "right"), np.searchsorted(born[fresh], last, "right")
            q, own = asked[a:a2], fresh[s:s2]
            own = own[np.lexsort((cid[own], key[own]))]
            for keys, rows in [*segments, (key[own], own)]:
                lo, hi = np.searchsorted(keys, key[q], "left"), np.searchsorted(keys, key[q], "right")
                n = hi - lo
                if most is not None and (n > most).any():
                    cut.append(q[n > most])
                    n = np.minimum(n, most)
                done, first = np.cumsum(n), 0
                while first < len(q):
                    # as many questions as give HITS suffixes, and one at least
                    to = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + HITS, "right")))
                    some = n[first:to]
                    which = np.repeat(np.arange(first, to), some)
                    at = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some) + lo[which]
                    h, qq = rows[at], q[which]
                    both = (size[h] + size[qq] + 2) // 3
                    need = np.minimum(MATCHES, both)
                    use = (born[h] < born[qq]) & (both <= np.minimum(size[h], size[qq])) & (place[h] < size[h] - both + need) & (place[qq] < size[qq] - both + need)
                    out_q.append(qq[use])
                    out_h.append(h[use])
                    out_n.append(need[use])
                    first = to
            if len(own):
                segments.append((key[own], own))
            while len(segments) > 2 and len(segments[-1][0]) * 2 > len(segments[-2][0]):
                last_segment = segments.pop()
                segments.append(_merged(segments.pop(), last_segment))
            a, s = a2, s2
        q = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
        h = np.concatenate(out_h) if out_h else np.empty(0, np.int64)
        need = np.concatenate(out_n) if out_n else np.empty(0, np.int32)
        more = np.unique(cid[np.concatenate(cut)]) if cut else np.empty(0, np.int64)
        return pa.table({"q": np.concatenate([cid[q], more]), "h": np.concatenate([cid[h], more]), "need": np.concatenate([need, np.full(len(more), -1)]).astype(np.int32)})

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made: dict[str, set] = {}

        def grams(t: str) -> set:
            g = made.get(t)
            if g is None:
                w = t.split(" ")
                g = made[t] = set(zip(w, w[1:], w[2:]))
            return g

        near = []
        for a, c in zip(b.column("q_words").to_pylist(), b.column("h_words").to_pylist()):
            x, y = grams(a), grams(c)
            both = len(x & y)
            near.append(both > 0 and 2 * both >= len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("h")], names=["q", "h"]).filter(pa.array(near, pa.bool_()))


def _written(df: DataFrame, name: str) -> DataFrame:
    """:func:`scratch`, after which the shuffle files that ``df`` was made from are removed: they would be kept to the end."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return scratch(df, name)
    finally:
        conf.set(key, before)


@dataclass
class History:
    """Everything accepted so far: its classes, the shared frequency sketch, and its stored suffixes.

    ``check`` reads stored suffixes and class ids only; no history text is tokenised again.  ``accept`` adds a batch.
    """

    classes: DataFrame
    sketch: np.ndarray
    buckets: int
    suffixes: DataFrame

    @classmethod
    def open(cls, records: DataFrame, store: bool = True) -> "History":
        """Index ``records`` (content, namespace); ``store`` writes the suffixes for use by several checks."""
        spark = records.sparkSession
        own = _written(classes(text_rows(records)), "classes")
        sketch = frequency_sketch(own)
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(sketch.sum()) // BUCKET_ROWS)
        s = suffixes(own, spark.sparkContext.broadcast(sketch), buckets, new=False)
        return cls(own, sketch, buckets, scratch(s, "suffixes") if store else s)

    def known(self, batch: DataFrame, batch_rows: int = 50_000) -> DataFrame:
        """(input_id): rows of ``batch`` (input_id, content, namespace) that history or an earlier row has.

        Equal words in equal order are the same; near means that of all distinct three-word sequences of the two at
        least half are in both.  Texts of fewer than three words are only ever the same.  Null contents are never known.
        """
        spark = batch.sparkSession
        rows = text_rows(batch, F.col("input_id"))
        own = _written(classes(rows), "batch")
        new = _written(own.join(self.classes.select("cid"), "cid", "left_anti"), "new")
        sketch = spark.sparkContext.broadcast(self.sketch)
        texts = self.classes.select("cid", "words").unionByName(new.select("cid", "words"))

        def compared(asking: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
            """(near_cid of texts with a near partner, q of those that were not compared with all), written."""
            stored = self.suffixes.unionByName(suffixes(new, sketch, self.buckets, new=False))
            asked = suffixes(asking, sketch, self.buckets, new=True).where("ask")
            hits = stored.unionByName(asked).groupBy("bucket").applyInArrow(bucket_hits(batch_rows, most), "q long, h long, need int")
            pairs = _written(hits.groupBy("q", "h").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need OR need < 0").select("q", "h", "need"), "pairs")
            near = (
                pairs.where("need >= 0").join(new.select(F.col("cid").alias("q"), F.col("words").alias("q_words")), "q")
                .join(texts.select(F.col("cid").alias("h"), F.col("words").alias("h_words")), "h")
                .select("q", "h", "q_words", "h_words")
                .mapInArrow(_compare, "q long, h long")
                .groupBy(F.col("q").alias("near_cid")).agg(F.lit(True).alias("near"))
            )
            near = _written(near, "near")
            rest = _written(pairs.where("need < 0").select("q").distinct().join(near, F.col("q") == F.col("near_cid"), "left_anti"), "rest")
            drop_scratch(pairs)
            return near, rest

        near, rest = compared(new, MOST)
        if not rest.isEmpty():
            asking = new.join(rest.select(F.col("q").alias("cid")), "cid", "left_semi")
            near = near.unionByName(compared(asking, None)[0])
        alone = new.select(F.col("cid").alias("new_cid"), "born").join(near, F.col("new_cid") == F.col("near_cid"), "left")
        ids = rows.select("cid", "input_id").join(alone, F.col("cid") == F.col("new_cid"), "left")
        return ids.where(F.col("new_cid").isNull() | F.col("near").isNotNull() | (F.col("input_id") > F.col("born"))).select("input_id").distinct()

    def accept(self, batch: DataFrame) -> "History":
        """History with ``batch`` added as one more immutable segment; nothing stored is written again."""
        spark = batch.sparkSession
        own = _written(classes(text_rows(batch)).join(self.classes.select("cid"), "cid", "left_anti"), "classes")
        s = scratch(suffixes(own, spark.sparkContext.broadcast(self.sketch), self.buckets, new=False), "suffixes")
        return History(self.classes.unionByName(own), self.sketch, self.buckets, self.suffixes.unionByName(s))
