"""Documents into containers of fixed capacity: bounded-space online best-fit.

Sizes are tokens of a public tokenizer.  Items arrive in the order of their ids; a fixed number of containers is
open, found by a bitset over free space: the lowest set bit at or above an item's size is the container it fits best.
Where none fits a new one opens, and where too many are open the fullest closes.  An item larger than the capacity is
cut into full pieces at character boundaries; only its last piece is packed with others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.sources.tables import scratch

#: Vocabulary of the public tokenizer that sizes are measured in.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Containers that are open at once.
OPEN = 128
#: Containers that one lane should fill at least; each lane leaves up to ``OPEN`` that could be fuller.
LANE_CONTAINERS = 4000
#: Different capacities that one call takes, at most.
MAX_WINDOWS = 1000

SIZED = "window_name string, capacity int, doc_id long, piece_no int, char_from long, char_to long, n_tokens int"


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(enc, text: str, tokens: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(from, to, tokens) of a text's pieces: one if it fits, else full pieces cut where a token starts a character."""
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    _, starts = enc.decode_with_offsets(tokens)
    lengths = [len(enc.decode_single_token_bytes(t)) for t in tokens]
    # a token begins a character where the bytes before it are whole characters
    data = text.encode("utf-8", "surrogatepass")
    begins, at = [], 0
    for n in lengths:
        begins.append(at >= len(data) or data[at] & 0xC0 != 0x80)
        at += n
    out, a = [], 0
    while a < len(tokens):
        b = min(a + capacity, len(tokens))
        while b < len(tokens) and b > a + 1 and not begins[b]:
            b -= 1
        out.append((starts[a], starts[b] if b < len(tokens) else len(text), b - a))
        a = b
    return out


def _sizes(windows: list[tuple[str, int]], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = []
                texts = b.column("text").to_pylist()
                for doc, text, got in zip(b.column("doc_id").to_pylist(), texts, enc.encode_ordinary_batch(texts, num_threads=1)):
                    for name, capacity in windows:
                        rows += [(name, capacity, doc, k, *p) for k, p in enumerate(pieces(enc, text, got, capacity))]
                types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in SIZED.split(", ")])

    return run


def best_fit(sizes: list[int], capacity: int, open_bins: int = OPEN) -> list[int]:
    """The container of each item, numbered in the order of opening."""
    bits = 0
    free: dict[int, list[int]] = {}
    out = []
    opened = now_open = 0

    def put(n: int, space: int) -> None:
        nonlocal bits
        free.setdefault(space, []).append(n)
        bits |= 1 << space

    def take(space: int) -> int:
        nonlocal bits
        n = free[space].pop()
        if not free[space]:
            del free[space]
            bits &= ~(1 << space)
        return n

    for size in sizes:
        if size >= capacity:
            out.append(opened)
            opened += 1
            continue
        fits = bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            n = take(space)
        else:
            if now_open == open_bins:
                take((bits & -bits).bit_length() - 1)
                now_open -= 1
            n, space = opened, capacity
            opened += 1
            now_open += 1
        out.append(n)
        if space - size:
            put(n, space - size)
        else:
            now_open -= 1
    return out


def _pack_lane(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
    lane = table.column("lane")[0].as_py()
    got = best_fit(table.column("n_tokens").to_pylist(), table.column("capacity")[0].as_py()) if table.num_rows else []
    return table.drop_columns(["lane"]).append_column("container_no", pa.array([lane * 1_000_000_000 + n for n in got], pa.int64()))


def pack(documents: DataFrame, windows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document, or piece of one that is too long, and window: its container and its share of the text.

    ``documents`` needs doc_id and text, ``windows`` window_name and capacity_tokens.  Null ids, texts and capacities
    and capacities below 1 take no part; an empty text has size 0 and goes where it fits; repeated rows of one id
    count once; no rows or windows give no rows.  Containers are numbered per window; ``char_from`` and ``char_to``
    are the piece's characters.  Lanes are chosen by a hash of the id, so many that each still fills thousands of
    containers.
    """
    sizes = [
        (r["window_name"], r["capacity_tokens"])
        for r in windows.where(F.col("capacity_tokens") >= 1).select("window_name", "capacity_tokens").distinct().orderBy("capacity_tokens", "window_name").limit(MAX_WINDOWS + 1).collect()
    ]
    if len(sizes) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.first("text").alias("text"))
    sized = scratch(texts.mapInArrow(_sizes(sizes, tokenizer), SIZED), "sized")
    lanes = sized.groupBy("window_name", "capacity").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n_tokens") / (F.col("capacity") * F.lit(float(LANE_CONTAINERS))))).alias("lanes")
    )
    laned = (
        sized.join(F.broadcast(lanes), ["window_name", "capacity"])
        .withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.col("lanes")).cast("long"))
        .drop("lanes")
        .select(*[c.split()[0] for c in SIZED.split(", ")], "lane")
    )
    return laned.groupBy("window_name", "lane").applyInArrow(_pack_lane, SIZED + ", container_no long")


def fill(packed: DataFrame) -> DataFrame:
    """(window_name, capacity, n_containers, n_items, n_tokens, share_used) of a packing."""
    return (
        packed.groupBy("window_name", "capacity", "container_no").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
        .groupBy("window_name", "capacity")
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"))
        .withColumn("share_used", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4))
    )
