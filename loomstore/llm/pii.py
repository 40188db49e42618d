"""Personal information in free text, by a skip-chain conditional random field.

Tokens are letter runs, digit runs and single signs.  The chain has a label per token (none, name, email, phone,
idnum, address) with features of the token and its neighbours; skip edges tie repeated or similar capitalised words
of one text, however far apart, by a potential for equal labels.  Inference is loopy: exact forward-backward sweeps
along the chain alternate with messages over the skip edges until no message moves by more than ``TOLERANCE``.  The
weights, the one of the skip edges included, are fitted by gradient ascent with these messages in place, on generated
text (:mod:`loomstore.llm.pii_corpus`), once per process of the driver; ``TRAIN_DOCUMENTS`` bounds it.  Whether a word
is common or only ever a proper noun is read off the vocabularies of public tokenizers.  A found span must pass a
plain check of its kind.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.llm.pii_corpus import Words, documents
from loomstore.llm.texts import nfc

LABELS = ("", "name", "email", "phone", "idnum", "address")
K = len(LABELS)
#: Vocabularies of public tokenizers, read on the driver.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Generated documents that the weights are fitted on, rounds of fitting, and rounds before the skip edges take part.
TRAIN_DOCUMENTS, TRAIN_ROUNDS, CHAIN_ROUNDS = 8000, 6, 4
#: Messages have settled once none moves by more than this (in logarithms); from ``DAMPED`` rounds on they are halved
#: with the one before, which settles what swings.  What moves after ``MOST_LOOPS`` rounds keeps its last messages.
TOLERANCE, DAMPED, MOST_LOOPS = 0.01, 5, 100
#: Token places that one sweep holds at a time, and characters that are labelled at a time, but for a single longer text.
CELLS, CHARS = 400_000, 2_000_000
# accents may stand decomposed
_TOKEN = re.compile("\\s*(?:(?:[^\\W\\d_][\u0300-\u036f]*)+|\\d+|[^\\w\\s]|_)|\\s+")
_REACH = 4
_PAIRS = ((-1, 0), (0, 1), (-2, -1), (1, 2), (-2, 0), (0, 2), (-3, -2), (2, 3))
_SIGNS = "@.,:;-+()[]{}/<>=_'’\"#&*°º"


@lru_cache(maxsize=4)
def vocabulary(paths: tuple[str, ...] = VOCABULARIES) -> Words:
    """The whole words of byte-level vocabularies (lines of a base64 token and its rank), common ones by rank."""
    common: dict[str, None] = {}
    proper: dict[str, None] = {}
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                try:
                    t = base64.b64decode(line.split()[0]).decode()
                except UnicodeDecodeError:
                    continue
                if re.fullmatch(r" [^\W\d_]{2,}", t):
                    (common if t[1:].islower() else proper if t[1:].istitle() else {})[t[1:]] = None
    return Words(tuple(common), tuple(t for t in proper if t.lower() not in common))


def tokens(text: str) -> list[str]:
    """``text`` cut into tokens; blanks stay at the front of the token that follows, so the pieces join to ``text``."""
    return _TOKEN.findall(text)


class Reading:
    """Classes and features of single tokens."""

    def __init__(self, words: Words):
        self.common, self.proper = frozenset(words.common), frozenset(t.lower() for t in words.proper)

    def cls(self, token: str) -> int:
        """A coarse class of a token: length of digits, shape of letters and whether it is a common word, the sign itself."""
        t = token.strip()
        glued = 1 if t == token else 0
        t = nfc(t)
        if not t:
            return 0
        if t.isdigit():
            return 1 + 2 * min(len(t), 13) + glued
        if t[0].isalpha():
            shape = 0 if len(t) == 1 and t.isupper() else 1 if t.isupper() else 2 if t.istitle() else 3 if t.islower() else 4
            return 30 + 2 * (shape + 5 * (t.lower() in self.common)) + glued
        at = _SIGNS.find(t)
        return 52 + 2 * (at + 1) + glued

    def features(self, token: str) -> list[str]:
        """What single tokens are known by, besides their class; only features met several times in fitting have weights."""
        t = nfc(token.strip())
        low = t.lower()
        if not t or not t[0].isalpha():
            return [f"w={low}"] if len(low) < 3 else []
        out = [f"w={low}", f"s3={low[-3:]}", f"s4={low[-4:]}", f"p2={low[:2]}", f"len={min(len(t), 12)}"]
        if low in self.proper:
            out.append("proper")
        if "\n" in token:
            out.append("line")
        return out


CLASSES = 54 + 2 * len(_SIGNS)
_SHAPES = str.maketrans("0123456789", "9999999999")


def chunk_shape(chunk: str) -> str:
    """How a run without blanks is built: digits as 9, letters as A or a, its sign marks as they are."""
    t = chunk.strip().rstrip(".,;:!?\"").translate(_SHAPES)
    return re.sub("[^\\W\\d_]", lambda m: "A" if m[0].isupper() else "a", t)[:24]


def chunk_features(parts: list[str], starts: np.ndarray, loose: np.ndarray, digit: np.ndarray, number) -> np.ndarray:
    """(tokens, 3) feature numbers of the run of unbroken tokens around each token: its shape, alone and with the run before and after.

    Only runs with a digit have any; ``loose`` tokens begin with a blank; ``number`` maps a feature to its number or 0.
    """
    out = np.zeros((len(parts), 3), dtype=np.int32)
    if not len(parts):
        return out
    first = loose.copy()
    first[starts[starts < len(parts)]] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(parts))
    which = np.flatnonzero(np.add.reduceat(digit.astype(np.int64), begin))
    shapes = {int(c): chunk_shape("".join(parts[begin[c] : end[c]])) for c in which}
    for c, s in shapes.items():
        out[begin[c] : end[c]] = number("c=" + s), number("b=" + shapes.get(c - 1, "") + "|" + s), number("a=" + s + "|" + shapes.get(c + 1, ""))
    return out


class Model:
    """Weights: per feature and offset, per class and offset, per pair of classes, per shape of unbroken runs (number 0 is none), transitions, and the skip weight."""

    def __init__(self, names: dict[str, int], words: Words = Words((), ()), chunks: dict[str, int] | None = None):
        self.names = names
        self.words = words
        self.chunks = chunks or {}
        self.chunk = np.zeros((len(self.chunks) + 1, K), dtype=np.float32)
        self.word = np.zeros((2 * _REACH + 1, len(names) + 1, K), dtype=np.float32)
        self.cls = np.zeros((2 * _REACH + 1, CLASSES + 1, K), dtype=np.float32)
        self.pair = np.zeros((len(_PAIRS), (CLASSES + 1) ** 2, K), dtype=np.float32)
        self.step = np.zeros((K, K), dtype=np.float32)
        self.skip = np.float32(0.5)


class Reader:
    """Token strings to rows of summed feature weights, remembered from batch to batch."""

    def __init__(self, model: Model):
        self.m = model
        self.reading = Reading(model.words)
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.classes = np.zeros(1024, dtype=np.int32)
        self.loose, self.digit = np.zeros(1024, dtype=bool), np.zeros(1024, dtype=bool)
        self.table = np.zeros((2 * _REACH + 1, 1024, K), dtype=np.float32)

    def numbers(self, parts: list[str]) -> np.ndarray:
        if len(self.rows) > 400_000:
            self._reset()
        get = self.rows.get
        out = [get(p) for p in parts]
        fresh: list[tuple] = []
        for i, n in enumerate(out):
            if n is None:
                p = parts[i]
                n = get(p)
                if n is None:
                    n = self.rows[p] = len(self.rows)
                    fresh.append((n, [self.m.names[f] for f in self.reading.features(p) if f in self.m.names], self.reading.cls(p), p[0].isspace(), p[-1].isdigit()))
                out[i] = n
        if fresh:
            while len(self.rows) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
                self.classes, self.loose, self.digit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.classes, self.loose, self.digit))
            for n, ids, c, loose, digit in fresh:
                self.loose[n], self.digit[n] = loose, digit
                self.classes[n] = c
                self.table[:, n] = self.m.cls[:, c] + (self.m.word[:, ids].sum(axis=1) if ids else 0)
        return np.array(out, dtype=np.int64)

    def unary(self, parts: list[str], sizes: np.ndarray) -> np.ndarray:
        """Scores (tokens, labels) of texts laid end to end; neighbours beyond a text's ends count as nothing."""
        n, ids = len(parts), self.numbers(parts)
        first = np.cumsum(sizes) - sizes
        starts, ends = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        u = np.zeros((n, K), dtype=np.float32)
        at = np.arange(n)
        cls = self.classes[ids]
        for o in range(-_REACH, _REACH + 1):
            j = at + o
            inside = (j >= starts) & (j < ends)
            u[inside] += self.table[o + _REACH][ids[j[inside]]]
        for k, (a, b) in enumerate(_PAIRS):
            u += self.m.pair[k][pair_ids(cls, at, starts, ends, a, b)]
        around = chunk_features(parts, first, self.loose[ids], self.digit[ids], lambda f: self.m.chunks.get(f, 0))
        own = np.flatnonzero(around.any(axis=1))
        u[own] += self.m.chunk[around[own]].sum(axis=1)
        return u


def pair_ids(cls: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    def side(o: int) -> np.ndarray:
        j = at + o
        inside = (j >= starts) & (j < ends)
        return np.where(inside, cls[np.clip(j, 0, max(len(cls) - 1, 0))], CLASSES)

    return side(a).astype(np.int64) * (CLASSES + 1) + side(b)


def _sweep(u: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on (texts, positions, labels) scores: marginals, and the two passes for pair marginals."""
    n, size, _ = u.shape
    e = np.exp(u - u.max(axis=2, keepdims=True))
    t = np.exp(step)
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    fwd[:, 0] = a
    for i in range(1, size):
        a = (a @ t) * e[:, i]
        a /= a.sum(axis=1, keepdims=True)
        fwd[:, i] = a
    b = np.ones((n, K), dtype=u.dtype)
    bwd[:, size - 1] = b
    for i in range(size - 2, -1, -1):
        b = (e[:, i + 1] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        b[i + 1 >= lengths] = 1.0
        bwd[:, i] = b
    m = fwd * bwd
    m /= m.sum(axis=2, keepdims=True)
    return m, fwd, e * bwd


def skip_key(token: str) -> str:
    """What similar words share: the first six letters in lower case, so that endings don't matter."""
    return token.strip().lower()[:6]


def skip_edges(parts: list[str], starts: list[int], ends: list[int]) -> np.ndarray:
    """(2, edges): consecutive occurrences of one or of similar capitalised words of three letters or more, in any text."""
    left, right = [], []
    for s, e in zip(starts, ends):
        last: dict[str, int] = {}
        for i in range(s, e):
            t = parts[i].strip()
            if len(t) > 2 and t[0].isupper():
                key = skip_key(t)
                if key in last:
                    left.append(last[key])
                    right.append(i)
                last[key] = i
    return np.array([left, right], dtype=np.int64).reshape(2, -1)


def infer(u: np.ndarray, sizes: np.ndarray, edges: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, what the skip edges add to the scores) of all tokens, by message passing until it has settled.

    Texts whose messages have settled are left alone while others go on.
    """
    starts = np.cumsum(sizes) - sizes
    out, added = np.zeros_like(u), np.zeros_like(u)
    text = np.repeat(np.arange(len(sizes)), sizes)

    def chain(which: np.ndarray) -> None:
        which = which[sizes[which] > 0]
        which = which[np.argsort(sizes[which], kind="stable")]
        at = 0
        while at < len(which):
            longest = sizes[which[at]]
            end = at + 1
            while end < len(which) and sizes[which[end]] <= longest * 1.15 + 4 and end - at < 512 and (end - at) * sizes[which[end]] < CELLS:
                end += 1
            g = which[at:end]
            size = int(sizes[g].max())
            pos = np.arange(size)
            inside = pos[None, :] < sizes[g][:, None]
            flat = (starts[g][:, None] + pos)[inside]
            pad = np.zeros((len(g), size, K), dtype=np.float32)
            pad[inside] = u[flat] + added[flat]
            m, _, _ = _sweep(pad, model.step, sizes[g])
            out[flat] = m[inside]
            at = end

    chain(np.arange(len(sizes)))
    a, b = edges
    gain = np.expm1(model.skip)
    to_a, to_b = np.zeros((len(a), K), dtype=np.float32), np.zeros((len(a), K), dtype=np.float32)
    live = np.arange(len(a))
    for turn in range(MOST_LOOPS):
        if not len(live):
            break
        x, y = a[live], b[live]
        ca, cb = np.maximum(out[x], 1e-12) * np.exp(-to_a[live]), np.maximum(out[y], 1e-12) * np.exp(-to_b[live])
        new_b, new_a = np.log1p(gain * ca / ca.sum(axis=1, keepdims=True)), np.log1p(gain * cb / cb.sum(axis=1, keepdims=True))
        if turn >= DAMPED:
            new_b, new_a = (new_b + to_b[live]) / 2, (new_a + to_a[live]) / 2
        moved = np.maximum(np.abs(new_b - to_b[live]).max(axis=1), np.abs(new_a - to_a[live]).max(axis=1))
        np.add.at(added, y, new_b - to_b[live])
        np.add.at(added, x, new_a - to_a[live])
        to_b[live], to_a[live] = new_b, new_a
        going = np.unique(text[x[moved > TOLERANCE]])
        chain(going)
        live = live[np.isin(text[x], going)]
    return out, added


def _training_set(n: int, seed: int, words: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
    parts, labels, sizes = [], [], []
    for doc in documents(n, seed, words):
        text = "".join(t for t, _ in doc)
        kinds = np.zeros(len(text), dtype=np.int8)
        at = 0
        for t, k in doc:
            if k:
                kinds[at : at + len(t)] = LABELS.index(k)
            at += len(t)
        got = tokens(text)
        at = 0
        for t in got:
            at += len(t)
            labels.append(kinds[at - 1])
        parts += got
        sizes.append(len(got))
    return parts, np.array(labels, dtype=np.int64), np.array(sizes, dtype=np.int64)


class Uses:
    """Which rows use which weights, sorted once by weight, so that gradients are sums over slices."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray):
        order = np.argsort(raw, kind="stable")
        self.raw, self.rows = raw, rows[order]
        self.used, self.first = np.unique(raw[order], return_index=True)

    def sums(self, grad: np.ndarray) -> np.ndarray:
        return np.add.reduceat(grad[self.rows], self.first, axis=0) if len(self.first) else np.zeros((0, K), dtype=grad.dtype)


def fit(n: int = TRAIN_DOCUMENTS, rounds: int = TRAIN_ROUNDS, seed: int = 7, rate: float = 0.25, paths: tuple[str, ...] = VOCABULARIES) -> Model:
    """Weights from ``n`` generated documents: adaptive gradient steps on the likelihood of small groups of texts.

    After ``CHAIN_ROUNDS`` rounds the settled messages of the skip edges are part of every text's scores, so that all
    weights are fitted in their company.
    """
    words = vocabulary(paths)
    reading = Reading(words)
    parts, gold, sizes = _training_set(n, seed, words)
    vocabulary_of: dict[str, list[str]] = {p: reading.features(p) for p in set(parts)}
    counts: dict[str, int] = {}
    for p in parts:
        for f in vocabulary_of[p]:
            counts[f] = counts.get(f, 0) + 1
    known = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c > 4))}
    seen: dict[str, int] = {}

    def count(f: str) -> int:
        seen[f] = seen.get(f, 0) + 1
        return 0

    loose, digit = np.array([p[0].isspace() for p in parts]), np.array([p[-1].isdigit() for p in parts])
    chunk_features(parts, np.cumsum(sizes) - sizes, loose, digit, count)
    shapes = {f: i + 1 for i, f in enumerate(sorted(f for f, c in seen.items() if c > 2))}
    around = chunk_features(parts, np.cumsum(sizes) - sizes, loose, digit, lambda f: shapes.get(f, 0))
    model = Model(known, words, shapes)
    none = len(known)
    width = 8
    rows = {p: ([known[f] for f in fs if f in known] + [none] * width)[:width] for p, fs in vocabulary_of.items()}
    feats = np.array([rows[p] for p in parts], dtype=np.int64)
    cls = np.array([reading.cls(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = [np.full_like(x, 1e-4) for x in (model.word, model.cls, model.pair, model.step, model.chunk)]
    order = np.argsort(sizes, kind="stable")
    groups = [order[i : i + 96] for i in range(0, len(order), 96)]
    rng = np.random.default_rng(seed)
    skip_sum = 1e-4

    def laid_out(g: np.ndarray) -> tuple:
        """What a group of texts needs in every round."""
        sz = sizes[g]
        flat = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in g])
        s0 = np.repeat(np.cumsum(sz) - sz, sz)
        e0 = s0 + np.repeat(sz, sz)
        at = np.arange(len(flat))
        inside = [np.flatnonzero((at + o >= s0) & (at + o < e0)) for o in range(-_REACH, _REACH + 1)]
        own = feats[flat]
        rows, cols = np.nonzero(own != none)
        words = Uses(own[rows, cols], rows)
        pairs = [Uses(pair_ids(cls[flat], at, s0, e0, a, b), at) for a, b in _PAIRS]
        rows, cols = np.nonzero(around[flat])
        return sz, flat, s0, at, inside, own, words, Uses(cls[flat], at), pairs, Uses(around[flat][rows, cols], rows)

    made = [laid_out(g) for g in groups]
    weights = (model.word, model.cls, model.pair, model.step, model.chunk)
    mean, taken, done = [np.zeros_like(w) for w in weights], 0, 0
    for turn in range(rounds):
        for gi in rng.permutation(len(groups)):
            g = groups[gi]
            sz, flat, s0, at, insides, own, words_used, classes_used, pairs_used, chunks_used = made[gi]
            u = model.chunk[around[flat]].sum(axis=1)
            for o, inside in enumerate(insides):
                src = inside + (o - _REACH)
                u[inside] += model.cls[o][cls[flat[src]]] + model.word[o][own[src]].sum(axis=1)
            for k, pu in enumerate(pairs_used):
                u += model.pair[k][pu.raw]
            edges = np.empty((2, 0), dtype=np.int64)
            if turn >= CHAIN_ROUNDS:
                edges = skip_edges([parts[i] for i in flat], list(np.cumsum(sz) - sz), list(np.cumsum(sz)))
                if edges.shape[1]:
                    p, added = infer(u, sz, edges, model)
                    u = u + added
            size = int(sz.max())
            inside2 = np.arange(size)[None, :] < sz[:, None]
            pad = np.zeros((len(g), size, K), dtype=np.float32)
            pad[inside2] = u
            m, fwd, bwd = _sweep(pad, model.step, sz)
            marg = m[inside2]
            y = gold[flat]
            grad = -marg
            grad[at, y] += 1.0
            # expected and seen transitions
            t = np.exp(model.step)
            both = np.flatnonzero(inside2[:, 1:].reshape(-1))
            fa, bb = fwd[:, :-1].reshape(-1, K)[both], bwd[:, 1:].reshape(-1, K)[both]
            joint = fa[:, :, None] * t[None] * bb[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            gs = -joint.sum(axis=0)
            same = at[1:][s0[1:] == s0[:-1]]
            np.add.at(gs, (y[same - 1], y[same]), 1.0)
            scale = 1.0 / len(g)

            def ascend(i: int, w: np.ndarray, gw: np.ndarray, touched) -> None:
                gw = gw * scale
                sums[i][touched] += gw * gw
                w[touched] += rate * gw / np.sqrt(sums[i][touched])

            ascend(3, model.step, gs, np.s_[:, :])
            for o, inside in enumerate(insides):
                moved = np.zeros_like(grad)
                moved[inside + (o - _REACH)] = grad[inside]
                ascend(1, model.cls, classes_used.sums(moved), (o, classes_used.used))
                ascend(0, model.word, words_used.sums(moved), (o, words_used.used))
            ascend(4, model.chunk, chunks_used.sums(grad), chunks_used.used)
            for k, pu in enumerate(pairs_used):
                ascend(2, model.pair, pu.sums(grad), (k, pu.used))
            if edges.shape[1]:
                a, b = edges
                agree = (p[a] * p[b]).sum(axis=1)
                odds = np.exp(model.skip) * agree / np.maximum(1.0 - agree, 1e-6)
                gk = float(((y[a] == y[b]) - odds / (1 + odds)).sum()) * scale
                skip_sum += gk * gk
                model.skip = np.float32(np.clip(model.skip + 0.1 * gk / np.sqrt(skip_sum), 0.0, 3.0))
            done += 1
            if turn >= CHAIN_ROUNDS and done % 8 == 0:  # the mean of the later weights swings less than the last ones
                taken += 1
                for x, w in zip(mean, weights):
                    x += w
    if taken:
        for x, w in zip(mean, weights):
            w[...] = x / taken
    return model


_fitted: dict[tuple, Model] = {}


def fitted(n: int = TRAIN_DOCUMENTS, rounds: int = TRAIN_ROUNDS, paths: tuple[str, ...] = VOCABULARIES) -> Model:
    key = (n, rounds, paths)
    if key not in _fitted:
        _fitted[key] = fit(n, rounds, paths=paths)
    return _fitted[key]


_MAILBOX = re.compile(r"[\w.+-]+\s*(?:@|[\[({<]\s*at\s*[\])}>]|\sat\s)\s*[\w-]+(?:\s*(?:\.|[\[({<]\s*dot\s*[\])}>]|\sdot\s)\s*[\w-]+)+", re.I)


def plausible(kind: str, span: str) -> bool:
    """A plain check of a found span: enough digits, a whole mailbox, two words of a name."""
    digits = sum(c.isdigit() for c in span)
    if kind == "name":
        parts = re.findall(r"[^\W\d_]{2,}", span)
        return len(parts) >= 2 and not digits and "_" not in span
    if kind == "email":
        return _MAILBOX.search(span) is not None
    if kind == "phone":
        return digits >= 7
    if kind == "idnum":
        return digits >= 6
    return digits >= 1 and re.search(r"[^\W\d_]{3,}", span) is not None


#: Signs that end a sentence rather than a span.
_TRAILING = frozenset([",", ";", ".", ":", "!", "", "\""])


def spans(parts: list[str], labels: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(first token, token after the last, kind) of each plausible run of one label."""
    i = 0
    while i < len(parts):
        k = labels[i]
        if not k:
            i += 1
            continue
        j = i + 1
        while j < len(parts) and labels[j] == k:
            j += 1
        end = j
        while end > i + 1 and parts[end - 1].strip() in _TRAILING:
            end -= 1
        if plausible(LABELS[k], "".join(parts[i:end]).strip()):
            yield i, end, LABELS[k]
        i = j


def by_size(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` characters of ``column``; a longer text is a slice of its own."""
    size = np.nan_to_num(np.asarray(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    at, total = 0, 0.0
    for i, n in enumerate(size):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0.0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _label_batches(reader_of, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of()
        for whole in batches:
            for b in by_size(whole, "content", CHARS):
                texts = b.column("content").to_pylist()
                pieces = [tokens(t) for t in texts]
                sizes = np.array([len(p) for p in pieces], dtype=np.int64)
                parts = [t for p in pieces for t in p]
                ends = np.cumsum(sizes)
                starts = ends - sizes
                if parts:
                    u = reader.unary(parts, sizes)
                    caps = _linked(parts, sizes, starts, ends, u)
                    labels = infer(u, sizes, caps, reader.m)[0].argmax(axis=1)
                else:
                    labels = np.empty(0, dtype=np.int64)
                hit = np.flatnonzero(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=labels > 0, minlength=len(sizes)))
                ids_out, kinds, texts_out = [], [], []
                names = b.column("id").to_pylist() if len(hit) else []
                for d in hit:
                    own = pieces[d]
                    found = list(spans(own, labels[starts[d] : ends[d]]))
                    if not found:
                        continue
                    ids_out.append(names[d])
                    kinds.append(sorted({k for _, _, k in found}))
                    if redact:
                        out, last = [], 0
                        for i, j, k in found:
                            lead = own[i][: len(own[i]) - len(own[i].lstrip())]
                            out += own[last:i] + [lead, f"[{k.upper()}]"]
                            last = j
                        texts_out.append("".join(out + own[last:]))
                columns = [pa.array(ids_out, pa.string()), pa.array(kinds, pa.list_(pa.string()))]
                if redact:
                    columns.append(pa.array(texts_out, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "kinds", "redacted"][: len(columns)])

    return run


def _linked(parts: list[str], sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Skip edges of the texts in which some token may be more than nothing: elsewhere they change no label."""
    lead = (u[:, 1:].max(axis=1) - u[:, 0]) > -4.0
    texts = np.unique(np.repeat(np.arange(len(sizes)), sizes)[lead])
    return skip_edges(parts, list(starts[texts]), list(ends[texts]))


_readers: dict[int, Reader] = {}


def find(records: DataFrame, redact: bool = True, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """(id, kinds[, redacted]) of every record (id, content) that holds personal information; one row per distinct record.

    ``kinds`` is sorted; ``redacted`` is the content with ``[NAME]``, ``[EMAIL]``, ``[PHONE]``, ``[IDNUM]``, ``[ADDRESS]``
    in place of the spans and every other character kept.  Null contents and records without any give no row; whole
    texts are read, however long.  Rows repeated under one id give one row.
    """
    spark = records.sparkSession
    model = spark.sparkContext.broadcast(fitted(paths=vocabularies))

    def reader_of() -> Reader:
        key = id(model.value)
        if key not in _readers:
            _readers.clear()
            _readers[key] = Reader(model.value)
        return _readers[key]

    schema = "id string, kinds array<string>" + (", redacted string" if redact else "")
    found = (
        records.where(F.col("content").isNotNull() & F.col("id").isNotNull()).select("id", "content").mapInArrow(_label_batches(reader_of, redact), schema)
    )
    first = [F.first("redacted").alias("redacted")] if redact else []
    return found.groupBy("id").agg(F.first("kinds").alias("kinds"), *first)
