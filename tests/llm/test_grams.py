import re

import numpy as np

from triagelake.llm import _grams as G


def test_words_and_runs():
    h = next(G.word_hashes(["Ab_c, d-é 1"], G._Hashes()))
    assert len(h) == 5 and len(G.runs(h)) == 3 and len(G.runs(h[:2])) == 0
    assert (G.runs(h) != G.runs(h, 1)).all()
    assert [len(x) for x in G.word_hashes([None, "", "__"], G._Hashes())] == [0, 0, 0]


def test_ascii_words_are_those_of_the_pattern():
    texts = ["A_b c-9", "x\x1cy\x00z\x7f", "", "  ", "caf\u00e9 _ 1", "".join(map(chr, range(128)))]
    assert [G.words_of(t) for t in texts] == [G.WORD.findall(t.lower()) for t in texts]


def test_chunks_are_cut_alike_wherever_they_stand():
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    a = next(G.word_hashes([text], G._Hashes()))
    b = next(G.word_hashes(["some other words first " + text + " and last"], G._Hashes()))
    for cut in (1, 2, 8):
        ca, na = G.chunks(a, cut)
        cb, _ = G.chunks(b, cut)
        assert na.sum() == 398 and (na == 1).all() == (cut == 1)
        assert na[np.isin(ca, cb)].sum() > 398 - 5 * cut
        assert [len(x) for x in G.chunks(a[:3], cut)] == [1, 1] and len(G.chunks(a[:2], cut)[0]) == 0
    # a passage of any length that has no cut is one chunk
    same = next(G.word_hashes(["x " * 200_000], G._Hashes()))
    g, n = G.chunks(same, 2 if int(G.windows(same[:3])[0]) % 2 else 3)
    assert len(g) == len(n) and n.sum() <= 199_998


def test_blocks_round_trip():
    b = G.Blocks(4)
    rng = np.random.default_rng(1)
    sent = {}
    for doc in (5, 9, -7):
        g = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
        sent[doc] = g
        b.add((3, doc), 50 + doc, 1, g, np.full(len(g), 70_000), np.full(len(g), 2, np.uint8))
    b.add((3, 5), 55, 1, sent[5], np.full(len(sent[5]), 70_000))  # a copy
    b.add((4, 5), 55, 1, sent[9])  # the low half alone is equal
    frame = b.flush()
    n = 0
    for blob in frame["blob"]:
        x = G.Incidences([blob, blob])
        assert set(x.lo) <= {5, 9, -7} and (x.kind == 1).all()
        assert all(x.n[i] == (50 + x.lo[i] if x.hi[i] == 3 else 55) for i in range(len(x.lo)))
        own = x.hi[x.d] == 3
        assert (x.w[own] == 70_000).all() and (x.side[own] == 2).all() and (x.w[~own] == 1).all()
        n += len(x.g)
    assert n == sum(map(len, sent.values())) + len(sent[9])
    assert len(G.Blocks(4).flush()) == 0


def test_more_blocks_than_sixteen_bits_hold():
    n = 4_000_000
    b = G.Blocks(n)
    g = np.unique(np.random.default_rng(2).integers(0, 2**64, 300_000, dtype=np.uint64))
    b.add((0, 1), len(g), 0, g)
    used = b.flush()["block"]
    assert used.between(0, n - 1).all() and used.nunique() > 250_000 and used.max() > 0.99 * n


def test_sketch_grows_with_the_texts(spark):
    df = spark.createDataFrame([("x" * 600,)], "v string")
    assert G.sketch_bits(df) == G.SKETCH_BITS == G.sketch_bits(df.limit(0))
    s = G.Sketch(24)
    g = np.arange(1 << 20, dtype=np.uint64) * np.uint64(7)
    s.add(g), s.add(g[:10])
    rows = [(p, slot, c) for p, slot, c in s.rows() for slot in (0, 1)]
    counts = G.merged_sketch(spark.createDataFrame(rows, "part int, slot int, counts binary"), 24)
    assert (G.levels(g[:10], counts) == int(8 * np.log2(5))).all() and (G.levels(g[10:], counts) == int(8 * np.log2(3))).all()


def test_pieces_of_a_hot_run_meet_every_pair_once():
    docs = list(range(-40, 60))
    for s in (1, 2, 5):
        inc = [(g, side, d) for d in docs for g, side in zip(*[np.repeat(0, 1) if x is None else x for x in G.split_square(np.array([9], np.uint64), np.array([s]), d)])]
        met = [(a[2], b[2]) for i, a in enumerate(inc) for b in inc[i + 1 :] if a[0] == b[0] and a[2] != b[2] and (a[1] == b[1] == 0 or a[1] != b[1])]
        assert len(met) == len(docs) * (len(docs) - 1) // 2 == len({tuple(sorted(m)) for m in met})
        one = np.array([1])
        left = [(int(g[0]), d) for d in docs for g in [G.split_cross(np.array([9], np.uint64), one, np.array([s]), d, False)[0]]]
        right = [int(g) for g in G.split_cross(np.array([9], np.uint64), one, np.array([s]), 5, True)[0]]
        assert len(right) == s and all(right.count(g) == 1 for g, _ in left)


def test_seen_is_bounded(monkeypatch):
    monkeypatch.setattr(G, "SEEN", 3)
    seen = G.Seen()
    assert [seen.first(k) for k in (1, 1, 2, 3, 4, 1)] == [True, False, True, True, True, True] and len(seen) <= 3


def brute_sets(texts, least=20):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", t.lower()) if t else []
        if len(w) >= least:
            out[i] = set(zip(w, w[1:], w[2:]))
    return out


def test_pair_counts_hand_on_frames(monkeypatch):
    monkeypatch.setattr(G, "PAIRS", 10)
    blocks = G.Blocks(1)
    for lo in (30, 20, 10):
        blocks.add((0, lo), 5, 0, np.array([1], np.uint64))
    x = G.Incidences(list(blocks.flush()["blob"]))
    assert list(x.lo) == [10, 20, 30]
    c = G.PairCounts(x, lambda a, b: np.full(len(a), 2), ordered=False)
    frames = [f for k in range(5) for f in c.add(np.array([2, 2, 1]), np.array([1, 0, 0]))] + [c.frame()]
    assert len(frames) == 2
    total = {}
    for f in frames:
        for r in f.itertuples():
            assert r.a_lo < r.b_lo and r.least == 2
            total[(r.a_lo, r.b_lo)] = total.get((r.a_lo, r.b_lo), 0) + r.o
    assert total == {(20, 30): 5, (10, 30): 5, (10, 20): 5}
