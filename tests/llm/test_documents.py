import random

from loomstore.llm import encodings, leaks, packing
from loomstore.llm.texts import words


def test_best_fit_keeps_capacity():
    rng = random.Random(2)
    sizes = [rng.randint(0, 120) for _ in range(3000)]
    got = packing.best_fit(sizes, 100, 32)
    room = {}
    for s, n in zip(sizes, got):
        room.setdefault(n, []).append(s)
    assert all(sum(v) <= 100 or len(v) == 1 for v in room.values())
    fitting = [v for v in room.values() if sum(v) <= 100]
    assert sum(map(sum, fitting)) / (100 * len(fitting)) > 0.9
    assert packing.best_fit([], 10) == [] and packing.best_fit([10, 10], 10) == [0, 1]


def test_pieces_rebuild_the_text(spark):
    enc = packing.encoder(packing.TOKENIZER)
    for text in ("héllo wörld " * 50, "🙂" * 40, "plain", ""):
        got = packing.pieces(enc, text, enc.encode_ordinary(text), 16)
        assert "".join(text[a:b] for a, b, _ in got) == text and all(n <= 16 for *_, n in got)


def test_pack(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 90)))) for i in range(400)] + [(1000, "word " * 3000), (1001, ""), (1002, None), (None, "x")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in docs] + [(1, docs[1][1], "q", 1)], "doc_id long, text string, lane string, container_no int")
    win = spark.createDataFrame([("s", 64), ("l", 512), ("bad", None), ("zero", 0)], "window_name string, capacity_tokens int")
    out = packing.pack(df, win).collect()
    enc = packing.encoder(packing.TOKENIZER)
    for name, capacity in (("s", 64), ("l", 512)):
        own = [r for r in out if r.window_name == name]
        assert {r.doc_id for r in own} == {i for i, t in docs if i is not None and t is not None}
        filled = {}
        for r in own:
            filled[r.container_no] = filled.get(r.container_no, 0) + r.n_tokens
        assert max(filled.values()) <= capacity
        assert sum(filled.values()) == sum(len(enc.encode_ordinary(t)) for i, t in docs if t and i is not None)
        whole = [r for r in own if r.doc_id != 1000]
        assert len({r.doc_id for r in whole if r.n_tokens <= capacity}) == len([r for r in whole if r.piece_no == 0])
    assert {r.window_name for r in out} == {"s", "l"}
    assert packing.pack(df.limit(0), win).count() == 0
    assert min(r.share_used for r in packing.fill(packing.pack(df, win)).collect()) > 0.5


ITEMS = [
    (1, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey\nthis stock line stands in very many of the items word for word here"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen\nthis stock line stands in very many of the items word for word here"),
] + [(10 + i, f"own words number {i} a b c d e f\nthis stock line stands in very many of the items word for word here") for i in range(6)]


def test_leaks(spark):
    a = ITEMS[0][1].split("\n")[0].split()
    edited = a[:8] + ["other"] + a[9:16] + a[17:]  # one replaced, one left out
    docs = [
        (1, "before " + " ".join(a[3:15]).upper() + "! after"),  # exactly twelve
        (2, "before " + " ".join(a[3:14]) + " after"),  # eleven only
        (3, "x " + ", ".join(edited) + " y"),
        (4, "this stock line stands in very many of the items word for word here"),
        (5, " ".join(w if k % 4 else "zzz" for k, w in enumerate(a))),  # every fourth replaced
        (6, "one two three four five six -- seven eight **nine** ten eleven\n\ntwelve " + " ".join(a[:12])),
        (7, None), (8, ""), (9, "filler " * 30_000 + " ".join(a)), (None, " ".join(a)),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs + docs[:1]], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (None, "x"), (99, None), ITEMS[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_edits) for r in leaks.leaks(df, items).collect()}
    assert set(got) == {(1, 1), (3, 1), (6, 1), (6, 2), (9, 1)}
    assert got[(1, 1)] == (12, 0) and got[(3, 1)][1] == 2
    assert leaks.leaks(df.limit(0), items).count() == 0 and leaks.leaks(df, items.limit(0)).count() == 0


def test_alignment_by_hand():
    import numpy as np

    ops = leaks.align(np.array([9, 1, 2, 3, 5, 6]), np.array([1, 2, 3, 4, 5, 6, 7]))
    assert ops == [(1, False), (1, False), (1, False), (1, True), (1, False), (1, False)]
    assert leaks.passage_length([(1, False)] * 12) == (12, 0) and leaks.passage_length([(1, False)] * 11) == (0, 0)


def test_every_local_alignment_counts(spark):
    item = [f"w{k}" for k in range(60)]
    loose = [f"x{k}" if k % 6 == 5 else w for k, w in enumerate(item[:40])]  # the best alignment, but no leak
    apart = [f"y{k}" for k in range(30)]
    edited = item[36:46] + ["z"] + item[47:60]  # 24 words, one replaced
    docs = [(1, loose + apart + item[44:57]), (2, item[44:57] + apart + loose), (3, loose + apart + edited), (4, item[20:33] + apart + edited), (5, loose + apart + item[44:55])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_edits) for r in leaks.leaks(df, items).collect()}
    assert got == {1: (13, 0), 2: (13, 0), 3: (24, 1), 4: (24, 1)}


def test_longest_passage_against_every_start():
    import random

    import numpy as np

    def slow(a, b):
        best = (0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                front = {(i, j): 0}  # least edits of the alignments from this start, by (words of a, of b) used up to
                for x in range(i, len(a) + 1):
                    for y in range(j, len(b) + 1):
                        e = min([front[p] + c for p, c in (((x - 1, y), 1), ((x, y - 1), 1), ((x - 1, y - 1), int(x <= i or y <= j or a[x - 1] != b[y - 1]))) if p in front], default=front.get((x, y)))
                        front[(x, y)] = e
                        used = y - j
                        if x > i and y > j and a[i] == b[j] and a[x - 1] == b[y - 1] and ((e == 0 and used >= 5) or (used >= 7 and e * 4 <= used)):
                            best = max(best, (used, -e))
        return best[0], -best[1]

    r = random.Random(4)
    seen = set()
    for _ in range(40):
        b = [r.randrange(5) for _ in range(14)]
        a = [r.randrange(5) for _ in range(4)] + [w for w in b[r.randrange(5):] if r.random() > 0.15] + [r.randrange(5) for _ in range(4)]
        want = slow(a, b)
        seen.add(want)
        assert leaks.longest_passage(np.array(a), np.array(b), 5, 7, 4) == want
    assert len(seen) > 4


CLEAN = ["Le café fermé près de la forêt où l’élève dînait déjà.", "Größe und Länge für die schöne Prüfung müssen übereinstimmen.", "El niño comió más piñas en la montaña según el periódico.", "Команда решила: индекс будет временный, порог заменили позже.", "Plain text without anything.", "A “quoted” word — and a dash… 5 € more ©"]


def corpus():
    rng = random.Random(8)
    return [(i, " ".join(rng.sample(CLEAN, 3))) for i in range(300)]


def test_garbled_documents_are_found_and_restored(spark):
    good = corpus()
    bad, want = [], {}
    for k, pair in enumerate([p for p in encodings.PAIRS if p[:2] in {("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437")} and p[2] == 1]):
        text = CLEAN[0] + " " + CLEAN[1]
        bad.append((1000 + k, "Some words. " + encodings.garble(text, *pair) + " Café."))
        want[1000 + k] = "Some words. " + text + " Café."
    bad.append((1100, encodings.garble(CLEAN[3], "koi8-r", "cp1251", 1)))
    bad.append((1101, "caf� ferm�"))
    rows = good + bad + [(1200, None), (1201, ""), (None, "cafÃ©"), bad[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pairs string")
    got = {r.doc_id: r.restored for r in encodings.garbled(df).collect()}
    assert set(got) == {i for i, _ in bad}
    assert sum(got[i] == t for i, t in want.items()) >= len(want) - 1
    assert got[1100][1:] == CLEAN[3][1:] or got[1100] == CLEAN[3]
    assert got[1101] == "caf� ferm�"
    assert encodings.garbled(df.limit(0)).count() == 0


def test_garble_round_trip():
    for pair in encodings.PAIRS:
        if pair[0] == "utf-8":
            for t in CLEAN:
                assert encodings.restore(encodings.garble(t, *pair), *pair) == t
    assert words("x") == ["x"]


def test_model_counts_every_document(spark):
    """The fit is that of plain counts over all texts, at any length and number, and texts of one kind only don't change it."""
    texts = [t for _, t in corpus()] + ["plain " * 2000 + "naïve façade"] + ["Größe " + encodings.garble(CLEAN[1], "utf-8", "cp1252", 1)]
    one = encodings.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    twenty = encodings.fit(spark.createDataFrame([(t,) for t in texts * 30], "text string").repartition(7))
    assert one.symbols == twenty.symbols and "ï" in one.symbols  # beyond the first 3000 characters
    assert [bool(f) for f in encodings.label(one, texts)] == [bool(f) for f in encodings.label(twenty, texts)] == [False] * 301 + [True]
