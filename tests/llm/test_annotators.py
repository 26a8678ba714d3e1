import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triagelake.llm import annotators as A

S = "sha256 string, engine string, category string, result string, scanned_at timestamp, label_id long"


def rate(spark, rows):
    df = spark.createDataFrame(rows, "item string, who string, label string, t int")
    return A.consensus(df, F.col("item"), F.col("who"), F.col("label"), F.col("t"))


def test_reliable_annotators_outvote_a_copying_crowd(spark):
    rows = []
    for i in range(60):
        truth = f"l{i % 4}"
        wrong = f"l{(i + 1) % 4}"
        for who in ("a", "b", "c", "d"):
            if (i, who) != (7, "d") and not (i >= 50 and who in "cd"):
                rows.append((str(i), who, truth, 0))
        for who in ("x", "y", "z"):
            rows.append((str(i), who, wrong if i % 2 else truth, 0))
    c = rate(spark, rows)
    got = {r.item: r.label for r in c.result.collect()}
    assert got == {str(i): f"l{i % 4}" for i in range(60)}  # two against three at the end
    who = {r.annotator: r.reliability for r in c.annotators.collect()}
    assert who["a"] > 0.85 > 0.6 > who["x"]


def test_rounds_equal_a_plain_version(spark):
    rows = [(str(i), w, f"l{(i * k) % 3}", 0) for i in range(30) for k, w in enumerate("abcde", 1) if (i + k) % 4]
    votes = {}
    for i, w, l, _ in rows:
        votes.setdefault(i, {})[w] = l
    w = dict.fromkeys("abcde", 1.0)
    acc = dict.fromkeys("abcde", 0.5)

    def winner(v, skip=None):
        s = Counter()
        for e, l in v.items():
            if e != skip:
                s[l] += w[e]
        return min(s, key=lambda l: (-round(s[l], 10), l))

    for _ in range(A.MAX_ROUNDS):
        h, n = Counter(), Counter()
        for v in votes.values():
            if len(v) >= 3:
                for e in v:
                    n[e] += 1
                    h[e] += winner(v, e) == v[e]
        new = {e: (h[e] + 5) / (n[e] + 10) for e in w}
        moved = max(abs(new[e] - acc[e]) for e in w)
        acc = new
        w = {e: max(math.log(a / (1 - a)), 1e-3 * a) for e, a in acc.items()}
        if moved < A.TOLERANCE:
            break
    c = rate(spark, rows)
    for r in c.annotators.collect():
        assert abs(r.reliability - acc[r.annotator]) < 1e-9
    assert {r.item: r.label for r in c.result.collect()} == {i: winner(v) for i, v in votes.items()}


def test_items_with_two_votes_are_judged(spark):
    rows = [(str(i), w, "x" if w == "a" or i < 6 else "y", 0) for i in range(8) for w in "ab"]
    who = {r.annotator: (r.judged_votes, round(r.reliability, 6)) for r in rate(spark, rows).annotators.collect()}
    assert who == {"a": (8, round(11 / 18, 6)), "b": (8, round(11 / 18, 6))}


def test_alpha_of_a_published_example(spark):
    # two coders, ten units, nominal data
    a = [0, 1, 0, 0, 0, 0, 0, 0, 1, 0]
    b = [1, 1, 1, 0, 0, 1, 0, 0, 0, 0]
    rows = [(str(i), w, str(v), 0) for w, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)] + [("alone", "a", "1", 0)]
    got = A.alpha(rate(spark, rows).items).first()
    assert got["items"] == 10 and got.ratings == 20 and abs(got.alpha - 0.095) < 1e-3


def test_latest_rating_nulls_and_ties(spark):
    rows = [("i", "a", "x", 0), ("i", "a", "y", 5), ("i", "b", "y", 0), ("t", "a", "q", 0), ("t", "b", "p", 0), (None, "a", "x", 0), ("n", None, "x", 0), ("n", "a", None, 0), ("one", "a", "z", 0)]
    got = {r.item: r for r in rate(spark, rows).result.collect()}
    assert got["i"].label == "y" and got["i"].voters == 2 and got["i"].agreement == 1.0
    assert got["t"].label == "p" and "n" not in got
    assert got["one"].label == "z" and got["one"].agreement is None
    empty = rate(spark, [])
    assert empty.result.count() == 0 and empty.annotators.count() == 0 and A.alpha(empty.items).count() == 0


def test_family_words_and_misnamed_records(spark):
    names = ["Trojan.ALisp.Rajipopid.d", "a variant of Lisp/Fomafimen.G", "HEUR:Trojan.Script.Sovosifag.gen", "Gen:Heur.1607", "Unsafe", None, "makokeked", "Trojan/Kikekejor.cz", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(A.family_of(F.col("n"))).collect()]
    assert got == ["rajipopid", "fomafimen", "sovosifag", None, None, None, "makokeked", "kikekejor", None]
    labels = [("AB ", e, "malicious", f"Trojan/{f}.aa", None, i) for i, (e, f) in enumerate([("E1", "goodname"), ("e2 ", "goodname"), ("E3", "badname")])]
    labels += [("cd", "E1", "malicious", "Trojan/goodname.a", None, 9), ("cd", "e1 ", "malicious", "Trojan/goodname.b", None, 10)]
    stats = [(1, "ab", " GoodName "), (2, "AB", "badname"), (3, "cd", "badname"), (4, None, "x"), (5, "ab", None)]
    df = spark.createDataFrame(labels, S)
    assert [r.stat_id for r in A.misnamed(df, spark.createDataFrame(stats, "stat_id long, sha256 string, family string")).collect()] == [2]


def test_short_words_and_other_scripts(spark):
    names = ["Trojan.Gen", "Worm.Zed", "Virus/木马", "ALS.Bursted.b", "Trojan.ab", "Троян.Дятел"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(A.family_of(F.col("n"))).collect()]
    assert got == [None, "zed", "木马", "bursted", None, "троян"]


def test_rounds_that_do_not_settle_say_so(spark):
    rows = [(f"i{i}", f"a{k}", "x" if (i * k) % 5 else "y", 0) for i in range(30) for k in range(5)]
    df = spark.createDataFrame(rows, "item string, who string, label string, t int")
    args = (df, F.col("item"), F.col("who"), F.col("label"), F.col("t"))
    with pytest.warns(UserWarning, match="still move"):
        assert not A.consensus(*args, max_rounds=1).settled
    assert A.consensus(*args).settled
