"""Percentiles, grouped splits, tokenisation and mixtures."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import grouped_split as S
from triagelake.llm import mixture as M
from triagelake.llm import percentiles as P
from triagelake.llm import tokenise as K

EVALS = "eval_id long, ingest_ts int, eval_ts timestamp, input_type string, total_ms double, parse_ms double, ir_ms double"


def evals(n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["lsp", "LSP", "lsp", "fas", "", None])
        v = [rng.choice([None, float("nan"), -1.0, 0.0, float("inf"), rng.lognormvariate(2, 2), 5.0, 5.0]) for _ in range(3)]
        t = datetime.datetime(2025, 1, 1 + i % 9)
        rows.append((i, 0, t, kind, *v))
        if i % 17 == 0:
            rows.append((i, 1, t, kind, 1e9, 1e9, 1e9))  # delivered again
    return rows


def values_of(rows):
    out = {}
    for i, o, _, kind, *v in rows:
        if o == 0 and kind:
            for m, x in zip(("total_ms", "parse_ms", "ir_ms"), v):
                if x is not None and math.isfinite(x) and x > 0:
                    out.setdefault((kind.lower(), m), []).append(x)
    return {k: sorted(v) for k, v in out.items()}


def test_multi_select_is_exact(spark):
    rows = evals()
    want = values_of(rows)
    df = spark.createDataFrame(rows, EVALS).repartition(7)
    got = P.percentiles(P.eval_runs(df)).collect()
    assert len(got) == len(want) * len(P.QUANTILES)
    for r in got:
        v = want[(r.grp, r.metric)]
        assert r.n == len(v) and r.value == v[max(math.ceil(r.q * len(v) - 1e-9), 1) - 1]


def test_days_combine_within_the_bound(spark):
    rows = evals(6000, 2)
    want = values_of(rows)
    partials = P.day_partials(spark.createDataFrame(rows, EVALS), points=32)
    assert partials.count() == 9 * len(want)
    assert max(len(np.frombuffer(r.vals, np.float64)) for r in partials.collect()) <= 32
    for r in P.from_partials(partials, points=32).collect():
        v = np.array(want[(r.grp, r.metric)])
        lo, hi = np.searchsorted(v, r.value, "left"), np.searchsorted(v, r.value, "right")
        off = max(lo - r.q * len(v), r.q * len(v) - hi, 0) / len(v)
        assert off <= r.rank_error + 1 / len(v)


def test_rows_without_a_key_are_no_repeats(spark):
    rows = [(None if i % 2 else (1 << 60) + i // 4, i, i, "lsp", float(i + 1), 1.0, 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "eval_id long, ing long, ts long, input_type string, total_ms double, parse_ms double, ir_ms double")
    df = df.selectExpr("eval_id", "timestamp_seconds(ing) as ingest_ts", "timestamp_seconds(ts) as eval_ts", "input_type", "total_ms", "parse_ms", "ir_ms").repartition(3)
    got = {(r.metric, r.q): r.n for r in P.percentiles(P.eval_runs(df), quantiles=(0.5,)).collect()}
    assert got[("total_ms", 0.5)] == 300


def test_thin_keeps_the_weight():
    v, w = np.sort(np.random.default_rng(1).random(1000)), np.ones(1000, np.int64)
    tv, tw = P.thin(v, w, 10)
    assert len(tv) == 10 and tw.sum() == 1000 and np.abs(np.searchsorted(v, tv) - (np.cumsum(tw) - 50)).max() <= 1


def test_no_measurements(spark):
    for rows in ([], [(1, 0, None, "lsp", None, -1.0, 0.0)], [(1, 0, None, None, 1.0, 1.0, 1.0)]):
        df = spark.createDataFrame(rows, EVALS)
        assert P.percentiles(P.eval_runs(df)).count() == 0 and P.day_partials(df).count() == 0


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, c, f in rows:
        for k in (("c", c and c.strip().lower()), ("f", f and f.strip().lower())):
            if k[1]:
                parent[find(("r", i))] = find(k)
    groups = {}
    for i, *_ in rows:
        groups.setdefault(find(("r", i)), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


STAT = "stat_id long, family string, sha256 string, label string"


def stat_rows(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        family = rng.choice([None, "", "Big", " big ", f"f{rng.randrange(60)}", f"F{rng.randrange(60)}"])
        sha = rng.choice([None, f"h{rng.randrange(500)}", f"H{rng.randrange(500)}"])
        rows.append((i * 3 + 1, family, sha, rng.choice(["M", "B", "B", None])))
    rng.shuffle(rows)
    return rows


def test_groups_equal_union_find(spark):
    rows = stat_rows()
    df = spark.createDataFrame(rows, STAT).selectExpr("*", "1 as id", "2 as root")
    want = components([r[:3] for r in rows])
    got = {r.id: r.group_id for r in S.stat_groups(df).collect()}
    assert got == want
    assert {r.stat_id for r in S.found(df).collect()} == {i for i in want if list(want.values()).count(want[i]) > 1}


def test_a_long_chain_is_one_group(spark):
    rows = [(i, f"f{i // 2}", f"h{(i + 1) // 2}", "M") for i in range(200)]
    assert S.stat_groups(spark.createDataFrame(rows, STAT)).select("group_id").distinct().count() == 1


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, f"f{i // 4}" if i % 3 else None, f"h{i}", "M" if i % 5 else "B") for i in range(3000)]
    df = spark.createDataFrame(rows, STAT)
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, target_share double")
    out = S.stat_splits(df, targets).collect()
    assert len(out) == 3000
    by_group = {}
    for r in out:
        assert by_group.setdefault(r.group_id, r.split) == r.split
    for label in ("M", "B"):
        n = [r.split for r in out if r.label == label]
        assert abs(n.count("train") / len(n) - 0.7) < 0.02
    report = S.split_report(S.stat_splits(df, targets), targets).collect()
    assert sum(r.records for r in report if r.label == "(all)") == 3000


def test_driver_rows_are_bounded_with_many_labels(spark):
    rows = [(i, f"f{i // 3}", None, f"l{i % 90}") for i in range(900)]
    df = spark.createDataFrame(rows, "stat_id long, family string, sha256 string, label string")
    t = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double")
    got = S.stat_splits(df, t).collect()
    assert len(got) == 900 and len({(r.group_id, r.split) for r in got}) == 300
    more = df.withColumn("label", F.concat("label", F.col("stat_id").cast("string")))
    with pytest.raises(ValueError):
        S.stat_splits(more, t)


def test_splits_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0), ("b", None)], "split string, target_share double")
    assert S.stat_splits(spark.createDataFrame([], STAT), targets).count() == 0
    out = S.stat_splits(spark.createDataFrame([(1, None, None, None)], STAT), targets).collect()
    assert [(r.split, r.label) for r in out] == [("a", None)]
    with pytest.raises(ValueError):
        S.assign(S.stat_groups(spark.createDataFrame([], STAT)).withColumn("label", F.lit("x")), {"a": 0.0})


def long_texts():
    rng = random.Random(4)
    yield from ("", "plain words here", "a" * 3000, " " * 900 + "x", "\n\n\nend", "it's <|endoftext|> text", "日本語" * 500, "x　　y " * 200)
    for _ in range(40):
        yield "".join(rng.choice(["ab", "c", " ", "  ", "\n", "é", "漢", "12", "'s", "--", "\x85", "\x1c"]) for _ in range(rng.randint(1, 600)))
    for _ in range(20):
        yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyzß") for _ in range(rng.randint(200, 1500)))


def test_tree_concatenation_equals_the_encoding_of_the_whole(spark):
    enc = K.encoding()
    texts = [*long_texts(), None, None]
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")  # ids twice
    got = K.encode(df, "text", ["doc_id"], leaf=24, piece=90).collect()
    want = sorted((i // 2, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert K.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_give_the_text_again():
    for t in long_texts():
        assert "".join(p for _, p in K.cut(t, 16, 64)) == t


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 8 + ["mid", "small"]), "w " * rng.randint(1, 30)) for i in range(3000)]
    docs += [(9001, None, "w w"), (9002, "other", "w"), (9003, "big", None), (9004, "big", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as h", "2 as n_tokens")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("missing", 0.4, 2), (None, 0.1, 1), ("none", None, None)], "source string, target_share double, max_repeats int")
    counts = M.staged_counts(df)
    planned = M.plan(counts, targets)
    drawn = M.draw(counts, planned).collect()
    assert {r.source for r in drawn} == {"big", "mid", "small"}
    limit = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.repeats <= limit[r.source] for r in drawn) and len({r.doc_id for r in drawn}) == len(drawn)
    total = sum(r.n_tokens * r.repeats for r in drawn)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(sum(r.n_tokens * r.repeats for r in drawn if r.source == s) / total - share) < 0.01
    report = {r.source: r for r in M.report(counts, planned).collect()}
    assert report["missing"].actual_share == 0 and abs(report["mid"].actual_share - 0.3) < 0.01
    # a smaller draw is part of a larger one
    half = {r.doc_id: r.repeats for r in M.draw(counts, M.plan(counts, targets, total / 2)).collect()}
    whole = {r.doc_id: r.repeats for r in drawn}
    assert all(whole.get(d, 0) >= n for d, n in half.items())
    assert abs(sum(next(x.n_tokens for x in drawn if x.doc_id == d) * n for d, n in half.items()) - total / 2) < 100


def test_buckets_shrink_with_the_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "DRIVER_ROWS", 64)
    counts = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 20) as source", "cast(id % 7 + 1 as int) as n_tokens", "shiftrightunsigned(xxhash64(id), 4) as h")
    targets = spark.createDataFrame([(f"s{k}", 1.0 + k % 3, 1) for k in range(20)], "source string, target_share double, max_repeats int")
    for r in M.report(counts, M.plan(counts, targets)).collect():
        assert abs(r.actual_share - r.scaled_share) < 2e-3


def test_mixture_of_nothing(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    counts = M.staged_counts(spark.createDataFrame([], "doc_id long, source string, text string"))
    assert M.draw(counts, M.plan(counts, t)).count() == 0 and M.report(counts, M.plan(counts, t)).first().actual_share == 0
