"""Garbled text from a wrong character encoding: found and put right by a hidden Markov model over characters.

One state is clean text; every other stands for a pair of encodings, the one a text was written in and the one it was
read as (or the same mistake made twice).  A character is emitted given the one before it, ASCII by its kind.  The
clean state is fitted on all documents, which are counted where they lie; a pair's state on the same text sent through
the pair's mistake.  Text in ASCII looks alike in all states, so only characters beyond ASCII and their direct neighbours are
scored; Viterbi runs over these for all documents of a batch at once.  A labelled span goes through the inverse of
its pair; what was lost (U+FFFD, bytes without a character) stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.sources.tables import drop_scratch, scratch

#: Natural logarithms of entering and of leaving a garbled state (per scored character; a gap of ASCII in between costs less to stay over).
ENTER, LEAVE = -6.0, -2.0
#: Weight, in characters, of a character's own frequency in its frequency after another, per round of fitting: strict only
#: once rare but proper neighbours have been taken back.
SMOOTH = (0.7, 0.7, 0.5)
#: Texts that counts are scaled down to where there are more: a neighbour never seen then costs the same however many were counted.
LIKE = 6000
#: Of one garbled state turning into another without clean text between.
SWITCH = -20.0
#: Character places that one run of Viterbi holds at a time, but for a single longer text.
CELLS = 250_000
#: Characters that are labelled at a time, but for a single longer text.
CHARS = 300_000
#: (written in, read as, times).
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp866", 1), ("utf-8", "mac_roman", 1),
    ("utf-8", "cp1250", 1), ("utf-8", "koi8-r", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "cp1254", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2),
    ("cp1251", "cp1252", 1), ("cp1251", "latin-1", 1), ("koi8-r", "cp1251", 1), ("cp1251", "koi8-r", 1), ("cp866", "cp1251", 1), ("cp1251", "cp866", 1), ("koi8-r", "cp1252", 1), ("cp866", "cp1252", 1),
    ("cp1252", "cp1251", 1), ("cp1252", "mac_roman", 1), ("mac_roman", "cp1252", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "utf-8", 1),
)
STATES = 1 + len(PAIRS)
LOST = "�"
# ASCII neighbours by kind, and characters that no fitted text showed by kind
_KINDS = ("edge", "blank", "lower", "upper", "digit", "sign")
_RARE = ("latin", "cyrillic", "greek", "control", "box", "symbol", "other")


@lru_cache(maxsize=None)
def table(name: str) -> tuple[dict[str, int], list[str]]:
    """Bytes of a one-byte encoding and back; bytes without a character stand for the control of their number."""
    chars = []
    for i in range(256):
        try:
            chars.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(i))
    return {c: i for i, c in reversed(list(enumerate(chars)))}, chars


def read_as(data: bytes, name: str) -> str:
    if name == "utf-8":
        return data.decode("utf-8", "replace")
    chars = table(name)[1]
    return "".join([chars[b] for b in data])


def garble(text: str, written: str, read: str, times: int) -> str:
    """The mistake of a pair; characters that the first encoding lacks are left out."""
    for _ in range(times):
        if written == "utf-8":
            data = text.encode("utf-8", "ignore")
        else:
            t = table(written)[0]
            data = bytes([t[c] for c in text if c in t])
        text = read_as(data, read)
    return text


def restore(text: str, written: str, read: str, times: int) -> str:
    """The inverse of :func:`garble` as far as it goes: runs that are no bytes of the pair stay as they are."""
    for _ in range(times):
        if read == "utf-8":
            return text
        back = table(read)[0]
        out, run = [], bytearray()

        def flush() -> None:
            if run:
                if written == "utf-8":
                    out.append(_decode_utf8(bytes(run), read))
                else:
                    out.append(read_as(bytes(run), written))
                run.clear()

        for c in text:
            if c in back:
                run.append(back[c])
            else:
                flush()
                out.append(c)
        flush()
        text = "".join(out)
    return text


def _decode_utf8(data: bytes, read: str) -> str:
    """UTF-8 decoding in which broken sequences keep the characters they were read as."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode("utf-8"))
            out.append(read_as(data[at + e.start : at + max(e.end, e.start + 1)], read))
            at += max(e.end, e.start + 1)
    return "".join(out)


def _kind(c: str) -> int:
    if c.isalpha():
        return 2 if c.islower() else 3
    return 4 if c.isdigit() else 1 if c.isspace() else 5


def _rare(c: str) -> str:
    o = ord(c)
    if 0x7F <= o < 0xA0:
        return "control"
    if 0x2500 <= o < 0x25A0:
        return "box"
    name = unicodedata.name(c, "")
    for word in ("LATIN", "CYRILLIC", "GREEK"):
        if name.startswith(word):
            return word.lower()
    return "symbol" if unicodedata.category(c)[0] in "SPZ" else "other"


_ASCII = [_kind(chr(i)) for i in range(128)]


_ASCII_NUMBERS = np.array(_ASCII, dtype=np.int32)


class Model:
    """Logarithms of bigram probabilities (states, before, character) over a table of symbols.

    A pair never counted depends on its two symbols alone, so only counted pairs are held one by one.
    """

    def __init__(self, symbols: list[str], one: np.ndarray, norm: np.ndarray, pairs: np.ndarray, score: np.ndarray):
        self.symbols = {c: len(_KINDS) + len(_RARE) + i for i, c in enumerate(symbols)}
        self.size = len(_KINDS) + len(_RARE) + len(symbols)
        self.one, self.norm, self.pairs, self.score = one, norm, pairs, score
        self.table: np.ndarray | None = None

    def encode(self, text: str) -> np.ndarray:
        """Symbol numbers of characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if self.table is None:
            self.table = np.full(0x110000, -1, dtype=np.int32)
            self.table[:128] = _ASCII_NUMBERS
            self.table[[ord(c) for c in self.symbols]] = list(self.symbols.values())
        out = self.table[codes]
        for o in np.unique(codes[out < 0]).tolist():
            self.table[o] = len(_KINDS) + _RARE.index(_rare(chr(o)))
        return self.table[codes]

    def rows(self, before: np.ndarray, char: np.ndarray) -> np.ndarray:
        """(pairs, states): the logarithm of each character after the one before it, less that of the clean state."""
        u, back = np.unique(before.astype(np.int64) * self.size + char, return_inverse=True)
        out = self.one[u % self.size] - self.norm[u // self.size]
        i = np.minimum(np.searchsorted(self.pairs, u), len(self.pairs) - 1)
        known = self.pairs[i] == u
        out[known] = self.score[i[known]]
        return (out - out[:, :1])[back]


_SNIPPET = re.compile(r"(?:^|[\x00-\x7f])[^\x00-\x7f]+(?:$|(?=[\x00-\x7f]))")


def snippets(texts: list[str]) -> Counter:
    """Runs of characters beyond ASCII with the character before and after (none at the ends of a text), counted."""
    out: Counter = Counter()
    for t in texts:
        for m in _SNIPPET.finditer(t):
            out[t[m.start() : m.end() + 1], m.start() == 0 and t[0] > "\x7f", m.end() == len(t)] += 1
    return out


#: Counts of bigrams: (state, before, character, n); characters by code point, ASCII and edges by kind.
_BIGRAMS = "state int, a int, b int, n long, bad long"
_SNIPPETS = "kind int, snippet string, first boolean, last boolean, n long, bad long"


def _tally(judge_of, everything: bool):
    """Snippets and kinds of ASCII characters of all texts (``n``, if ``everything``) and of those judged garbled (``bad``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of()
        for whole in batches:
            texts = whole.column("text").to_pylist()
            bad = [t for t, f in zip(texts, judge(texts)) if f]
            some, other = snippets(texts) if everything else Counter(), snippets(bad)
            kinds, bad_kinds = _kinds(texts) if everything else np.zeros(len(_KINDS), np.int64), _kinds(bad)
            keys = list({**some, **other})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(keys) + list(range(len(_KINDS))), pa.int32()), pa.array([k[0] for k in keys] + [None] * len(_KINDS), pa.string()), pa.array([k[1] for k in keys] + [None] * len(_KINDS), pa.bool_()), pa.array([k[2] for k in keys] + [None] * len(_KINDS), pa.bool_()),
                    pa.array([some[k] for k in keys] + kinds.tolist(), pa.int64()), pa.array([other[k] for k in keys] + bad_kinds.tolist(), pa.int64()),
                ],
                names=["kind", "snippet", "first", "last", "n", "bad"],
            )

    return run


def _kinds(texts: list[str]) -> np.ndarray:
    """How often each kind of ASCII stands anywhere, with two edges a text."""
    data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.bincount(_ASCII_NUMBERS[data[data < 128]], minlength=len(_KINDS)).astype(np.int64)
    out[0] += 2 * len(texts)
    return out


def _bigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of distinct snippets as they are and sent through each mistake."""
    for whole in batches:
        out: dict[tuple[int, int, int], list[int]] = {}
        for t, first, last, n, bad in zip(*(whole.column(c).to_pylist() for c in ("snippet", "first", "last", "n", "bad"))):
            for state in range(STATES):
                ids = [_ASCII[o] if (o := ord(c)) < 128 else o for c in (garble(t, *PAIRS[state - 1]) if state else t)]
                ids = [0] * first + ids + [0] * last
                for a, b in zip(ids, ids[1:]):
                    if a >= 128 or b >= 128:
                        c = out.setdefault((state, a, b), [0, 0])
                        c[0] += n
                        c[1] += bad
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([out[k][i] for k in keys], pa.int64()) for i in range(2)], names=["state", "a", "b", "n", "bad"])


def _counted(rows: DataFrame, judge_of, everything: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams (state, a, b, n, bad) and kinds of ASCII (n, bad) of all ``rows`` (text); what comes to the driver grows with the alphabet only."""
    parts = rows.select("text").mapInArrow(_tally(judge_of, everything), _SNIPPETS).groupBy("kind", "snippet", "first", "last").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    table = scratch(parts, "snippets")
    pairs = table.where("kind IS NULL").mapInArrow(_bigram_batches, _BIGRAMS).groupBy("state", "a", "b").agg(F.sum("n"), F.sum("bad")).collect()
    kinds = np.zeros((len(_KINDS), 2), dtype=np.int64)
    for k, n, bad in table.where("kind IS NOT NULL").select("kind", "n", "bad").collect():
        kinds[k] = n, bad
    drop_scratch(table)
    return np.array([tuple(r) for r in pairs], dtype=np.int64).reshape(-1, 5), kinds


def _model(pairs: np.ndarray, kinds: np.ndarray, smooth: float, scale: float) -> Model:
    """The model of counted bigrams (state, a, b, n) of clean texts and their kinds of ASCII: smoothed with the characters' own frequency."""
    kinds, weights = kinds * scale, pairs[:, 3] * scale
    own = pairs[pairs[:, 0] == 0]
    beyond = {chr(c) for c in np.unique(own[:, 1:3]).tolist() if c >= 128}
    wrong = {c for w, r, n in PAIRS for x in beyond for c in garble(x, w, r, n)}
    symbols = sorted({c for c in wrong if c > "\x7f"} | beyond | {LOST})
    base = len(_KINDS) + len(_RARE)
    size = base + len(symbols)
    number = {ord(c): base + i for i, c in enumerate(symbols)}
    codes, back = np.unique(pairs[:, 1:3], return_inverse=True)
    ids = np.array([c if c < 128 else number[c] if c in number else len(_KINDS) + _RARE.index(_rare(chr(c))) for c in codes.tolist()], dtype=np.int64)[back].reshape(-1, 2)
    code, place = np.unique(ids[:, 0] * size + ids[:, 1], return_inverse=True)
    one, norm, score = np.empty((size, STATES), np.float32), np.empty((size, STATES), np.float32), np.empty((max(len(code), 1), STATES), np.float32)
    for state in range(STATES):
        mine = pairs[:, 0] == state
        count = np.bincount(place[mine], weights=weights[mine], minlength=len(code))
        total = np.bincount(code // size, weights=count, minlength=size)
        total[: len(_KINDS)] = np.maximum(total[: len(_KINDS)], kinds)
        freq = np.bincount(code % size, weights=count, minlength=size) + 0.01
        freq /= freq.sum()
        n = total + smooth + 1e-7 * size
        one[:, state], norm[:, state] = np.log(smooth * freq + 1e-7), np.log(n)
        score[: len(code), state] = np.log((count + smooth * freq[code % size] + 1e-7) / n[code // size])
    return Model(symbols, one, norm, code if len(code) else np.array([-1]), score)


_GARBLED = re.compile("[\u0080-\u009f" + LOST + "]")


#: Blocks of the characters that garbled text is expected to come from: Latin, Greek, Cyrillic, punctuation and symbols, pictures.
_USUAL = ((0x80, 0x180), (0x370, 0x400), (0x400, 0x460), (0x2000, 0x2300), (0x1F300, 0x1FA00))


@lru_cache(maxsize=100_000)
def _longer_in_utf8(run: str) -> bool:
    for name in ("cp1252", "latin-1", "cp1251", "cp437", "cp866", "mac_roman", "cp1250"):
        back = table(name)[0]
        if all(c in back for c in run):
            try:
                read = bytes(back[c] for c in run).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(read) < len(run) and all(any(a <= ord(c) < b for a, b in _USUAL) for c in read):
                return True
    return False


def looks_garbled(text: str) -> bool:
    """Whether some run of characters beyond ASCII would be longer text in UTF-8: only to keep such texts out of the first clean fit."""
    return bool(_GARBLED.search(text)) or any(_longer_in_utf8(run) for run in re.findall(r"[^\x00-\x7f]{2,}", text))


def fit(rows: DataFrame) -> Model:
    """Clean and garbled states from all of mostly clean ``rows`` (text).

    The first clean fit leaves out what might be garbled; later ones take back every text that the model so far
    calls clean, so that rare but proper neighbours of characters are learned.  Counts of texts add up, so those of
    clean texts are those of all less those of garbled ones, and each round counts the garbled ones only.
    """
    pairs, kinds = _counted(rows, lambda: lambda texts: [looks_garbled(t) for t in texts], True)
    every, bad = pairs[:, [0, 1, 2, 3]], pairs[:, [0, 1, 2, 4]]
    total, bad_kinds = kinds[:, 0], kinds[:, 1]
    for smooth in SMOOTH:
        left = {tuple(r[:3]): r[3] for r in every.tolist()}
        for *k, n in bad.tolist():
            left[tuple(k)] -= n
        clean = np.array([(*k, n) for k, n in left.items() if n], dtype=np.int64).reshape(-1, 4)
        model = _model(clean, total - bad_kinds, smooth, min(1.0, 2 * LIKE / max(int(total[0]), 1)))
        if smooth == SMOOTH[-1]:
            break
        sent = rows.sparkSession.sparkContext.broadcast(model)
        pairs, kinds = _counted(rows, lambda sent=sent: lambda texts: label(sent.value, texts), False)
        bad, bad_kinds = pairs[:, [0, 1, 2, 4]], kinds[:, 1]
        sent.unpersist()
    return model


def _scored(model: Model, texts: list[str], some: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(text, places of its characters beyond ASCII, their scores) of the texts that may have a garbled run.

    A garbled run costs ENTER and LEAVE, so where no state gains as much over any stretch the clean path is the best one.
    """
    base = len(_KINDS)
    ids = model.encode("\0".join(["", *(texts[i] for i in some), ""]))
    edges = np.cumsum([0, *(len(texts[i]) + 1 for i in some)])
    ids[edges] = 0
    at = np.flatnonzero(ids >= base)
    s = model.rows(ids[at - 1], ids[at])
    last = ids[at + 1] < base
    s[last] += model.rows(ids[at[last]], ids[at[last] + 1])
    cuts = np.searchsorted(at, edges)
    gain = np.add.reduceat(np.maximum(s, 0).max(axis=1), cuts[:-1])
    cost, jobs = -ENTER - LEAVE - 0.01, []
    for k in np.flatnonzero(gain > cost).tolist():
        own = s[cuts[k] : cuts[k + 1]]
        up = np.concatenate([np.zeros((1, STATES)), np.cumsum(own, axis=0, dtype=np.float64)])
        if (up - np.minimum.accumulate(up, axis=0)).max() > cost:
            jobs.append((some[k], at[cuts[k] : cuts[k + 1]] - edges[k], own))
    return jobs


def label(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans (start, end, state) that Viterbi gives to a garbled state."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    jobs = []
    some = [i for i, t in enumerate(texts) if not t.isascii()]
    while some:
        sizes = np.cumsum([len(texts[i]) + 1 for i in some])
        k = max(1, int(np.searchsorted(sizes, CHARS, "right")))
        jobs += _scored(model, texts, some[:k])
        some = some[k:]
    jobs.sort(key=lambda j: len(j[1]))
    step = np.full((STATES, STATES), SWITCH, dtype=np.float32)
    step[0, 0] = 0.0
    step[0, 1:] = ENTER
    step[1:, 0] = LEAVE
    step[np.arange(1, STATES), np.arange(1, STATES)] = 0.0
    a = 0
    while a < len(jobs):
        b = a + 1
        while b < len(jobs) and len(jobs[b][1]) <= 1.2 * len(jobs[a][1]) + 8 and b - a < 128 and (b - a) * len(jobs[b][1]) < CELLS:
            b += 1
        group = jobs[a:b]
        size = len(group[-1][1])
        n = len(group)
        e = np.zeros((n, size, STATES), dtype=np.float32)
        for k, (_, at, s) in enumerate(group):
            e[k, : len(at)] = s
        back = np.zeros((n, size, STATES), dtype=np.int8)
        v = e[:, 0] + step[0]
        for x in range(1, size):
            w = v[:, :, None] + step[None]
            back[:, x] = w.argmax(axis=1)
            v = w.max(axis=1) + e[:, x]
        v = v + step[:, 0][None]
        state = v.argmax(axis=1)
        path = np.zeros((n, size), dtype=np.int8)
        for x in range(size - 1, -1, -1):
            path[:, x] = state
            state = np.take_along_axis(back[:, x], state[:, None], axis=1)[:, 0]
        for k, (i, at, s) in enumerate(group):
            p = path[k, : len(at)]
            if not p.any():
                continue
            cuts = np.flatnonzero(np.diff(p)) + 1
            for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(p)]):
                if p[x]:
                    out[i].append(snug(texts[i], int(at[x]) - 1, int(at[y - 1]), int(p[x])))
        a = b
    return out


def snug(text: str, a: int, b: int, s: int) -> tuple[int, int, int]:
    """The span with its ends moved out over characters that belong to one broken UTF-8 sequence with them."""
    written, read, times = PAIRS[s - 1]
    if written != "utf-8":
        return a, b, s
    back = table(read)[0]

    def whole(x: int, y: int) -> bool:
        try:
            bytes(back[c] for c in text[x:y]).decode("utf-8")
            return True
        except (KeyError, UnicodeDecodeError):
            return False

    head = a
    while head < b and text[head] > "\x7f":
        head += 1
    if not whole(a, head):
        for x in range(a - 1, max(a - 4 * times, 0) - 1, -1):
            if text[x] < "\x80":
                break
            if whole(x, head):
                a = x
                break
    tail = b
    while tail > a and text[tail - 1] > "\x7f":
        tail -= 1
    if not whole(tail, b):
        for y in range(b + 1, min(b + 4 * times, len(text)) + 1):
            if text[y - 1] < "\x80":
                break
            if whole(tail, y):
                b = y
                break
    return a, b, s


def repair(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with the inverse of each span's pair applied to it."""
    out, last = [], 0
    for a, b, s in found:
        a = max(a, last)
        out += [text[last:a], restore(text[a:b], *PAIRS[s - 1])]
        last = b
    return "".join(out) + text[last:]


def _repair_batches(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column("text").to_pylist()
                ids, repaired, names = [], [], []
                found = label(model, texts)
                hit = [i for i, f in enumerate(found) if f]
                keys = b.column("doc_id").to_pylist() if hit else []
                for i in hit:
                    ids.append(keys[i])
                    repaired.append(repair(texts[i], found[i]))
                    names.append(sorted({f"{w} read as {r}" + " twice" * (n == 2) for w, r, n in (PAIRS[s - 1] for _, _, s in found[i])}))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(repaired, pa.string())], names=["doc_id", "pairs", "restored"])

    return run


def garbled(documents: DataFrame) -> DataFrame:
    """(doc_id, pairs, restored) of every document (doc_id, text) with at least one garbled run; one row per id.

    ``pairs`` names the mistakes found, ``restored`` is the whole text with them undone as far as it can be.  Null
    texts and ids give no row; whole texts are read; repeated rows of one id give one row.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    model = spark.sparkContext.broadcast(fit(rows))
    found = rows.mapInArrow(_repair_batches(model), "doc_id long, pairs array<string>, restored string")
    return found.groupBy("doc_id").agg(F.first("pairs").alias("pairs"), F.first("restored").alias("restored"))
