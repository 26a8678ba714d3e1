"""Near duplicates and split overlap against brute force."""

import random

from tests.llm.test_grams import brute_sets
from triagelake.llm import _grams as G
from triagelake.llm import near_duplicates as N
from triagelake.llm import split_overlap as O

WORDS = [f"w{i}" for i in range(300)]
HEAD = " ".join(f"head{i}" for i in range(12))


def corpus(seed, n=60):
    """Texts with copies, edits, moved parts, a shared header, and a group of
    copies that holds a third of all rows."""
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(15, 90))] for _ in range(n // 3)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        v = list(w)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(len(v))] = rng.choice(WORDS)
        texts.append(HEAD + " " + " ".join(v) if rng.random() < 0.5 else " ".join(v))
        cut = rng.randrange(len(w))
        texts.append(" ".join(w[cut:] + w[:cut]).upper())
    texts += [texts[0]] * (len(texts) // 2)
    texts += [None, "", "short text", " ".join(["same"] * 40), "x " * 5000 + "y"]
    return texts


def near_truth(rows, t=0.6):
    sets = brute_sets(rows)
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def test_near_duplicates_equal_brute_force(spark):
    rows = list(enumerate(corpus(1)))
    other = [None] * 10 + corpus(2)
    df = spark.createDataFrame([(i, t, other[i] if i < len(other) else None, 7, "x") for i, t in rows], "row_id long, text string, semantic string, id int, hi string").repartition(5)
    members, links = N.near_duplicates(df, "row_id", ["text", "semantic"])
    got = {tuple(r) for r in N.pairs(members, links).collect()}
    want = near_truth(rows) | near_truth([(i, other[i] if i < len(other) else None) for i, _ in rows])
    assert got == want and len(want) > 50
    classes = N.classes(members, links).collect()
    assert len(classes) == members.count()
    assert max(r.class_rows for r in classes) > 20  # copies are one class


def test_no_link_is_lost_across_many_seeds(spark):
    for seed in range(3, 6):
        rows = list(enumerate(corpus(seed, 36)))
        df = spark.createDataFrame(rows, "row_id long, text string")
        for t in (0.6, 0.8):
            got = {tuple(r) for r in N.pairs(*N.near_duplicates(df, "row_id", ["text"], threshold=t)).collect()}
            assert got == near_truth(rows, t)


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "few words")]):
        m, l = N.near_duplicates(spark.createDataFrame(rows, "row_id long, text string"), "row_id", ["text"])
        assert N.pairs(m, l).count() == 0 and N.classes(m, l).count() == 0


def overlap_truth(rows):
    sets = brute_sets([(i, t) for i, _, t, _ in rows])
    key = lambda s: s and s.lower().replace("\\", "/")
    out = set()
    for i, si, _, ki in rows:
        for j, sj, _, kj in rows:
            if si == "train" and sj in ("dev", "test"):
                if ki and key(ki) == key(kj) or i in sets and j in sets and len(sets[i] & sets[j]) >= 0.75 * len(sets[j]) - 1e-12:
                    out.add((min(i, j), max(i, j)))
    return out


def test_split_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    texts = corpus(7, 75)
    rows = []
    for i, t in enumerate(texts):
        if t and rng.random() < 0.3:  # a part of a longer text
            t = " ".join(rng.choice(WORDS) for _ in range(60)) + " " + t
        rows.append((i, rng.choice(["train", "train", "dev", "test", None]), t, rng.choice([None, f"A/b{i % 40}.lsp", f"a\\B{i % 40}.LSP"])))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id long, split string, text string, sample string, words string").repartition(4)
    want = overlap_truth(rows)
    assert {tuple(r) for r in O.found_pairs(df).collect()} == want and len(want) > 50
    report = O.report(df.drop("words")).collect()
    assert sum(r.records for r in report) == sum(r[1] in ("dev", "test") for r in rows)
    hit = {j for a, b in want for j in (a, b) if rows[j][1] != "train"}
    assert sum(r.overlaps for r in report) == len(hit)


def test_split_overlap_of_nothing(spark):
    s = "row_id long, split string, text string, sample string"
    assert O.found_pairs(spark.createDataFrame([], s)).count() == 0
    assert O.found_pairs(spark.createDataFrame([(1, None, None, None), (2, "train", None, None)], s)).count() == 0
    assert O.report(spark.createDataFrame([], s)).count() == 0


def test_scattered_edits_are_found(spark):
    """One word in twelve is changed, which spoils most chunks for the least
    loss of runs."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        n = rng.choice([30, 60, 120, 240])
        w = [f"v{rng.randrange(5000)}" for _ in range(n)]
        v = [f"edit{i}x{k}" if i % 12 == k % 12 else x for i, x in enumerate(w)]
        rows += [(2 * k, "train", " ".join(["pre", *v, "post"]), None), (2 * k + 1, "test", " ".join(w), None)]
    want = overlap_truth(rows)
    got = {tuple(r) for r in O.found_pairs(spark.createDataFrame(rows, "row_id long, split string, text string, sample string")).collect()}
    assert got <= want and len(want) > 30 and len(want - got) <= 1


def test_equal_ids_are_one_record(spark):
    rows = list(enumerate(corpus(9, 30)))
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert {tuple(r) for r in N.pairs(*N.near_duplicates(df, "row_id", ["text"])).collect()} == near_truth(rows)


def test_copies_of_repeated_passages_are_found(spark):
    rng = random.Random(3)
    texts = [" ".join([f"p{k}q{rng.randrange(9999)}" for _ in range(a)] * b) for k, (a, b) in enumerate([(8, 13), (12, 17), (60, 20), (5, 200)])]
    texts += ["x " * 200 + "y", "z " * 90 + "y", " ".join(["same"] * 40)]
    rows = [(2 * k + s, ("train", "test")[s], t, None) for k, t in enumerate(texts) for s in (0, 1)]
    # a copy that is repeated more often has the same runs
    rows += [(100, "dev", texts[2] + " " + texts[2], None)]
    want = overlap_truth(rows)
    got = {tuple(r) for r in O.found_pairs(spark.createDataFrame(rows, "row_id long, split string, text string, sample string")).collect()}
    assert got == want and len(want) == len(texts) + 1


def test_no_overlap_is_lost_however_edited(spark):
    """Words are inserted or changed at distances that spoil most chunks."""
    rng = random.Random(13)
    rows = []
    for k in range(600):
        n, every = rng.choice([20, 30, 60]), rng.choice([8, 9, 10, 12])
        w = [f"v{rng.randrange(5000)}" for _ in range(n)]
        v = []
        for i, x in enumerate(w):
            if i % every == k % every:
                v += [f"edit{i}x{k}", x] if k % 3 else [f"edit{i}x{k}"]
            else:
                v.append(x)
        rows += [(2 * k, "train", " ".join(["pre", *v, "post"]), None), (2 * k + 1, "test", " ".join(w), None)]
    want = overlap_truth(rows)
    got = {tuple(r) for r in O.found_pairs(spark.createDataFrame(rows, "row_id long, split string, text string, sample string")).collect()}
    assert got == want and len(want) > 150


def test_hot_runs_are_split_and_lose_nothing(spark, monkeypatch):
    """Pieces of a few texts; workers are forked anew with the new bound."""
    from pyspark import cloudpickle

    monkeypatch.setattr(G, "HOT", 4)
    monkeypatch.setattr(G, "FAN", 3)
    cloudpickle.register_pickle_by_value(G)
    try:
        rng = random.Random(21)
        head = [f"h{i}" for i in range(30)]
        rows = [(i, " ".join(head + [rng.choice(WORDS) for _ in range(rng.randint(4, 14))])) for i in range(80)]
        df = spark.createDataFrame(rows, "row_id long, text string")
        want = near_truth(rows)
        assert {tuple(r) for r in N.pairs(*N.near_duplicates(df, "row_id", ["text"])).collect()} == want and len(want) > 1000
        both = [(i, ("train", "test")[i % 2], t, None) for i, t in rows]
        df = spark.createDataFrame(both, "row_id long, split string, text string, sample string")
        assert {tuple(r) for r in O.found_pairs(df).collect()} == overlap_truth(both)
    finally:
        cloudpickle.unregister_pickle_by_value(G)


def test_larger_chunks_find_copies_and_parts(spark):
    rng = random.Random(8)
    long = [[f"c{rng.randrange(9000)}" for _ in range(300)] for _ in range(20)]
    rows = [(2 * k, "train", " ".join(["pre", *w, "post"]), None) for k, w in enumerate(long)]
    rows += [(2 * k + 1, "dev", " ".join(w[50:250]), None) for k, w in enumerate(long)]
    df = spark.createDataFrame(rows, "row_id long, split string, text string, sample string")
    want = overlap_truth(rows)
    for cut in (1, 4):
        assert {tuple(r) for r in O.found_pairs(df, cut=cut).collect()} == want and len(want) == 20


def test_classes_across_splits(spark):
    t = " ".join(f"k{i}" for i in range(40))
    rows = [(1, "train", t, None), (2, "train", t, "S"), (3, "dev", t, None), (4, "test", t + " more", "s"), (5, "dev", "w " * 30, None)]
    df = spark.createDataFrame(rows, "row_id long, split string, text string, sample string")
    got = {r.row_id: (r.side, r.class_id, r.class_rows, r.links) for r in O.classes(*O.split_overlap(df)).collect()}
    assert got == {1: ("train", 1, 2, 2), 2: ("train", 1, 2, 2), 3: ("evaluation", 3, 1, 1), 4: ("evaluation", 4, 1, 1), 5: ("evaluation", 5, 1, 0)}
