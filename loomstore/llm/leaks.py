"""Held-out items leaking into documents: rare n-gram seeds, then Smith-Waterman alignment of words.

The items' word 4-grams, stock lines left out, are the seeds.  A document is scanned once for seeds; a document and
an item become candidates only where enough different seeds lie close to one diagonal: a passage of twenty words with
three edits keeps five of its seeds at least, so no passage is lost.  The stretch of the document around the seeds is
then aligned with the item's words by Smith-Waterman, with a layer per number of edits, so that every local alignment
is seen and not the best alone: a run of ``EXACT`` equal words, or a passage of ``PASSAGE`` words with at most one edit
in ten, counts wherever it lies.

Stock lines, the frequent part of the items, give no seeds; what is left is rare, and no seed is dropped for standing
in many documents, as that would lose passages: a single frequent seed says little, so several are needed.  The items are the stated query set; they go to the executors in blocks of bounded size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.llm.texts import words

SEED = 4
#: Consecutive equal words, or words of a passage with at most one edit in ``RATE``, that make a leak.
EXACT, PASSAGE, RATE = 12, 20, 10
#: A line that stands in more items than this is a stock line.
STOCK = 5
#: Different seeds that a candidate needs near one diagonal, and how far from it they may lie.
HITS, DRIFT = 5, 6
#: Items of one block that is sent to the executors, by characters.
BLOCK_CHARS = 8_000_000

_seen: dict[str, int] = {}


def _numbers(parts: list[str]) -> np.ndarray:
    if len(_seen) > 1_000_000:
        _seen.clear()
    get = _seen.get
    out = [get(w) for w in parts]
    for i, n in enumerate(out):
        if n is None:
            out[i] = _seen[parts[i]] = xxhash.xxh64_intdigest(parts[i].encode("utf-8", "surrogatepass"))
    return np.array(out, dtype=np.uint64)


def grams(numbers: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``SEED`` words."""
    n = len(numbers) - SEED + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        out = (out ^ numbers[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


@dataclass
class Items:
    """Seeds of a block of items, sorted, with the passage and place of each; a passage has an item and its words."""

    seeds: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    item: list[int]
    text: list[np.ndarray]


def stock_lines(texts: list[str]) -> set[tuple[str, ...]]:
    """The lines (as words) that stand in more than ``STOCK`` of ``texts``."""
    n: Counter = Counter()
    for t in texts:
        n.update({tuple(words(x)) for x in t.split("\n")} - {()})
    return {x for x, c in n.items() if c > STOCK}


def prepare(rows: list[tuple[int, str]], stock: set[tuple[str, ...]]) -> Items:
    item, text, seeds, passage, place = [], [], [], [], []
    for i, t in rows:
        runs: list[list[str]] = [[]]
        for line in t.split("\n"):
            w = words(line)
            if tuple(w) in stock:
                runs.append([])
            else:
                runs[-1] += w
        for run in runs:
            if len(run) >= EXACT:
                numbers = _numbers(run)
                g = grams(numbers)
                seeds.append(g)
                passage.append(np.full(len(g), len(item)))
                place.append(np.arange(len(g)))
                item.append(i)
                text.append(numbers)
    if not item:
        return Items(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), [], [])
    s = np.concatenate(seeds)
    order = np.argsort(s, kind="stable")
    return Items(s[order], np.concatenate(passage)[order], np.concatenate(place)[order], item, text)


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, bool]]:
    """Smith-Waterman (equal +1, edit -1) of two word sequences: the best local alignment as (words of b used, is edit).

    The plain form with its path; leaks are looked for by :func:`longest_passage`, which sees every alignment.
    """
    a, b = a.tolist(), b.tolist()
    width = len(b) + 1
    above = [0] * width
    moves = []
    best, best_at = 0, (0, 0)
    for i, x in enumerate(a, 1):
        row, move = [0] * width, bytearray(width)
        left = 0
        for j, y in enumerate(b, 1):
            if x == y:
                v, m = above[j - 1] + 1, 1
            else:
                v, m = above[j - 1] - 1, 2
            if above[j] - 1 > v:
                v, m = above[j] - 1, 3
            if left - 1 > v:
                v, m = left - 1, 4
            if v <= 0:
                v, m = 0, 0
            row[j] = left = v
            move[j] = m
            if v > best:
                best, best_at = v, (i, j)
        moves.append(move)
        above = row
    out = []
    i, j = best_at
    while i and j and (m := moves[i - 1][j]):
        out.append((0 if m == 3 else 1, m != 1))
        i, j = i - (m != 4), j - (m != 3)
    return out[::-1]


def passage_length(ops: list[tuple[int, bool]], exact: int = EXACT, least: int = PASSAGE, rate: int = RATE) -> tuple[int, int]:
    """(words, edits) of the longest run or passage that makes a leak, or (0, 0)."""
    best = (0, 0)
    for i in range(len(ops)):
        if ops[i][1]:
            continue
        used = edits = 0
        for j in range(i, len(ops)):
            used += ops[j][0]
            edits += ops[j][1]
            if not ops[j][1] and used > best[0] and ((not edits and used >= exact) or (used >= least and edits * rate <= used)):
                best = (used, edits)
    return best


def longest_passage(a: np.ndarray, b: np.ndarray, exact: int = EXACT, least: int = PASSAGE, rate: int = RATE) -> tuple[int, int]:
    """(words of b, edits) of the longest passage of ``b`` in ``a`` that makes a leak, over all local alignments, or (0, 0).

    Smith-Waterman's recurrence, where a cell has for each number of edits the most words of ``b`` that an alignment
    ending there uses; more edits than one in ``rate`` of all of ``b`` can't make a leak.  Cells of one antidiagonal
    depend on the two before it only, so each is computed at once.
    """
    n, m = len(a), len(b)
    layers = m // rate + 1
    none = -(1 << 20)
    top = np.zeros(layers, dtype=np.int32)
    older, old = np.full((layers, m + 1), none, dtype=np.int32), np.full((layers, m + 1), none, dtype=np.int32)
    for t in range(2, n + m + 1):
        lo, hi = max(1, t - n), min(m, t - 1)
        equal = a[t - hi - 1 : t - lo][::-1] == b[lo - 1 : hi]
        before = older[:, lo - 1 : hi]
        own = np.where(equal, before + 1, none)
        own[0] = np.where(equal, np.maximum(before[0], 0) + 1, none)
        np.maximum(top, own.max(axis=1), out=top)  # a passage ends with equal words
        np.maximum(own[1:], before[:-1] + 1, out=own[1:])
        np.maximum(own[1:], old[:-1, lo : hi + 1], out=own[1:])
        np.maximum(own[1:], old[:-1, lo - 1 : hi] + 1, out=own[1:])
        older, old = old, np.full((layers, m + 1), none, dtype=np.int32)
        old[:, lo : hi + 1] = own
    best = (0, 0)
    for edits, used in enumerate(top.tolist()):
        if used > best[0] and ((not edits and used >= exact) or (used >= least and edits * rate <= used)):
            best = (used, edits)
    return best


def candidates(numbers: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(passage, from, to): stretches of a document (as word numbers) where enough seeds of a passage lie close together."""
    g = grams(numbers)
    if not len(g):
        return
    lo, hi = np.searchsorted(items.seeds, g, "left"), np.searchsorted(items.seeds, g, "right")
    n = hi - lo
    if not n.any():
        return
    at = np.repeat(np.arange(len(g)), n)
    row = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    passage, place = items.passage[row], items.place[row]
    few = np.bincount(passage, minlength=len(items.item))
    keep = few[passage] >= HITS
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, x, y in zip(passage[keep].tolist(), at[keep].tolist(), place[keep].tolist()):
        groups[p].append((x, y))
    for p, hits in groups.items():
        size = len(items.text[p])
        hits.sort(key=lambda h: (h[0] - h[1], h[0]))
        start = 0
        near: list[tuple[int, int]] = []
        for end in range(len(hits) + 1):
            if end == len(hits) or hits[end][0] - hits[end][1] - (hits[end - 1][0] - hits[end - 1][1] if end else 0) > DRIFT and end:
                block = hits[start:end]
                if len({y for _, y in block}) >= HITS:
                    near.append((min(x for x, _ in block), max(x for x, _ in block)))
                start = end
        for x, y in sorted(near):
            yield p, max(0, x - size), min(len(numbers), y + size + SEED)


def _leak_batches(items_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of.value
        for b in batches:
            out: dict[tuple[int, int], tuple[int, int]] = {}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                numbers = _numbers(words(text))
                for p, x, y in candidates(numbers, items):
                    key = (doc, items.item[p])
                    found = longest_passage(numbers[x:y], items.text[p])
                    if found[0] > out.get(key, (0, 0))[0]:
                        out[key] = found
            rows = [(d, i, w, e) for (d, i), (w, e) in out.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "n_words", "n_edits"]
            )

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits): documents (doc_id, text) that hold a passage of an item (item_id, text).

    ``n_words`` is the longest passage found.  Letter case, punctuation and layout do not count; words are not joined
    over a stock line.  Items of fewer than ``EXACT`` words outside of stock lines cannot leak.  Null texts and ids
    take no part; repeated rows give one row; no items give no rows.  Whole documents are scanned.
    """
    spark = documents.sparkSession
    lines = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    rows = [(r["item_id"], r["text"]) for r in lines.orderBy("item_id").toLocalIterator()]
    stock = stock_lines([t for _, t in rows])
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    blocks, size = [[]], 0
    for r in rows:
        if size > BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r[1])
    out = None
    for block in blocks:
        part = texts.mapInArrow(_leak_batches(spark.sparkContext.broadcast(prepare(block, stock))), "doc_id long, item_id long, n_words int, n_edits int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_edits")).alias("x")).select("doc_id", "item_id", "x.n_words", "x.n_edits")
