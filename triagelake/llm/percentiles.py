"""Percentiles of very large numeric columns (problem 5).

Method: distributed multi-select.  Values are kept as sorted runs.  Every
task proposes, for each open target (group, metric, quantile), the local
median of the values not yet ruled out; the weighted median of the proposals
is the next pivot; counting below, at and above the pivot rules a range out
or ends the search.  Counts and the proposals for both outcomes come from one
pass, and the ruled-out ranges are dropped from storage every few rounds.
The result is an element of the data, with no rank error.

For results that must be combined later, runs of a day are thinned to at most
``POINTS`` weighted values.  Thinning moves no rank by more than
``weight / POINTS``, thinning twice adds up, and the same multi-select works
on weighted values, so percentiles over any set of days come with a bound.

Defined results: null, NaN, infinite and non-positive values are no
measurements (-1 stands for "not measured", 0 for a stage that did not run);
null and blank groups are left out; repeated rows (same key) count once, with
the earliest delivery.  Ties are no matter.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.session import staged

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
POINTS = 512
FINER, SLOTS = 4, 16
RUN = 1_000_000
RUN_TYPE = "day date, grp string, metric string, n bigint, vals binary, wts binary"
MAX_TARGETS = 100_000
SHRINK_EVERY = 5


def _emit(held: dict, limit: int) -> pd.DataFrame:
    """Sorted runs of what is held; ``limit`` 0 keeps every value."""
    out = []
    for (day, grp, metric), parts in held.items():
        v = np.sort(np.concatenate(parts))
        v, w = thin(v, np.ones(len(v), np.int64), limit) if limit else (v, None)
        out.append((day, grp, metric, len(v) if w is None else int(w.sum()), v.tobytes(), None if w is None else w.tobytes()))
    return pd.DataFrame(out, columns=["day", "grp", "metric", "n", "vals", "wts"])


def thin(v: np.ndarray, w: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` values standing for equal weights: each is the
    middle of its stretch, so no rank moves by more than half a stretch."""
    if len(v) <= points:
        return v, w
    cum = np.cumsum(w)
    ends = np.unique(np.ceil(cum[-1] * np.arange(1, points + 1) / points).astype(np.int64))
    starts = np.concatenate(([0], ends[:-1]))
    at = np.searchsorted(cum, (starts + ends + 1) // 2)
    return v[at], ends - starts


def runs(df: DataFrame, key: str, order: str, ts: str, group: Column, metrics: list[str], by_day: bool = False, limit: int = 0) -> DataFrame:
    """Sorted runs of the valid values per group and metric (and day).

    Rows of the same key meet in one task, the earliest delivery first; the
    groups, however large, stay spread over all tasks.  Rows without a key
    are no repeats of each other and are spread as well.
    """
    day = F.to_date(F.col(ts)) if by_day else F.lit(None).cast("date")
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), day.alias("day"), group.alias("grp"), *[F.col(m).cast("double").alias(m) for m in metrics])
    none, k = F.col("k").isNull(), F.coalesce("k", F.lit("0").cast(dict(rows.dtypes)["k"]))
    spread = F.when(none, F.xxhash64("o", "grp", *metrics)).otherwise(F.xxhash64("k"))
    rows = rows.select(k.alias("k"), "o", "day", "grp", *metrics, none.alias("none"), spread.alias("s"))
    rows = rows.repartition("s").drop("s").sortWithinPartitions("none", "k", "o")

    def build(it):
        last, held, size = None, {}, 0
        for pdf in it:
            k = pdf["k"].to_numpy()
            fresh = np.r_[last is None or k[0] != last, k[1:] != k[:-1]] | pdf["none"].to_numpy(bool) if len(k) else np.zeros(0, bool)
            if len(k):
                last = k[-1]
            pdf = pdf[fresh & pdf["grp"].notna().to_numpy()]
            for (d, g), part in pdf.groupby(["day", "grp"], dropna=False, sort=False):
                d = None if pd.isna(d) else d
                for m in metrics:
                    v = part[m].to_numpy(dtype=np.float64)
                    v = v[np.isfinite(v) & (v > 0)]
                    if len(v):
                        held.setdefault((d, g, m), []).append(v)
                        size += len(v)
            if size > RUN:
                yield _emit(held, limit)
                held, size = {}, 0
        yield _emit(held, limit)

    return rows.mapInPandas(build, RUN_TYPE)


def merged(partials: DataFrame, points: int = POINTS) -> DataFrame:
    """Partial results of the same day, group and metric put together: one
    row each, of at most ``points`` values.  They meet in slots first, so no
    task gets those of all others; a slot keeps ``FINER`` times the points."""

    def put(pdf, points):
        v = np.concatenate([np.frombuffer(b, np.float64) for b in pdf["vals"]])
        w = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["wts"]])
        o = np.argsort(v, kind="stable")
        v, w = thin(v[o], w[o], points)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["day"], first["grp"], first["metric"], int(w.sum()), v.tobytes(), w.tobytes())], columns=["day", "grp", "metric", "n", "vals", "wts"])

    slots = partials.withColumn("slot", F.pmod(F.xxhash64("vals"), F.lit(SLOTS)))
    some = slots.groupBy("day", "grp", "metric", "slot").applyInPandas(lambda pdf: put(pdf, FINER * points), RUN_TYPE)
    return some.groupBy("day", "grp", "metric").applyInPandas(lambda pdf: put(pdf, points), RUN_TYPE)


def _cut(vals: bytes, wts, lo: float, hi: float):
    """Values of a run strictly between the bounds, with their weights."""
    v = np.frombuffer(vals, np.float64)
    a, b = np.searchsorted(v, lo, "right"), np.searchsorted(v, hi, "left")
    return v[a:b], None if wts is None else np.frombuffer(wts, np.int64)[a:b]


def _median(v: np.ndarray, w) -> float:
    if w is None:
        return float(v[(len(v) - 1) // 2])
    c = np.cumsum(w)
    return float(v[np.searchsorted(c, (c[-1] + 1) // 2)])


def _weighted(values, weight) -> float:
    v, w = np.asarray(values, np.float64), np.asarray(weight, np.float64)
    keep = w > 0
    v, w = v[keep], w[keep]
    if not len(v):
        return float("nan")
    o = np.argsort(v, kind="stable")
    c = np.cumsum(w[o])
    return float(v[o][np.searchsorted(c, c[-1] / 2)])


def select(stored: DataFrame, quantiles=QUANTILES) -> list[tuple[str, str, float, int, float]]:
    """(group, metric, quantile, n, value) by distributed multi-select."""
    sizes = stored.groupBy("grp", "metric").agg(F.sum("n").alias("n")).limit(MAX_TARGETS + 1).collect()
    if len(sizes) * len(quantiles) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    # target: rank sought among the values between the bounds
    open_: dict[tuple, list] = {}
    total = {}
    for r in sizes:
        for q in quantiles:
            rank = min(max(int(np.ceil(q * r.n - 1e-9)), 1), int(r.n))
            open_[(r.grp, r.metric, q)] = [rank, -np.inf, np.inf, None]
            total[(r.grp, r.metric, q)] = int(r.n)
    done: dict[tuple, float] = {}
    left = stored.select("grp", "metric", "vals", "wts")
    rounds = 0
    while open_:
        targets = list(open_)
        by_run: dict[tuple, list[int]] = {}
        for t, (g, m, _) in enumerate(targets):
            by_run.setdefault((g, m), []).append(t)
        state = [tuple(open_[t]) for t in targets]

        def look(it, by_run=by_run, state=state):
            count: dict[int, list] = {}
            for pdf in it:
                for g, m, vals, wts in zip(pdf["grp"], pdf["metric"], pdf["vals"], pdf["wts"]):
                    for t in by_run.get((g, m), ()):
                        _, lo, hi, pivot = state[t]
                        v, w = _cut(vals, wts, lo, hi)
                        if not len(v):
                            continue
                        c = count.setdefault(t, [0, 0, 0, [], [], [], []])
                        if pivot is None:
                            parts = ((v, w), (v[:0], None))
                        else:
                            a, b = np.searchsorted(v, pivot, "left"), np.searchsorted(v, pivot, "right")
                            c[0] += int(a if w is None else w[:a].sum())
                            c[1] += int(b - a if w is None else w[a:b].sum())
                            c[2] += int(len(v) - b if w is None else w[b:].sum())
                            parts = ((v[:a], None if w is None else w[:a]), (v[b:], None if w is None else w[b:]))
                        for (x, y), p in zip(parts, (3, 5)):
                            if len(x):
                                c[p].append(_median(x, y))
                                c[p + 1].append(len(x) if y is None else int(y.sum()))
            # one proposal a task for each side of the pivot
            yield pd.DataFrame(
                [(t, c[0], c[1], c[2], _weighted(c[3], c[4]), float(sum(c[4])), _weighted(c[5], c[6]), float(sum(c[6]))) for t, c in count.items()],
                columns=["t", "below", "at", "above", "low", "low_w", "high", "high_w"],
            )

        def settle(pdf):
            return pd.DataFrame(
                [(pdf["t"].iloc[0], pdf["below"].sum(), pdf["at"].sum(), pdf["above"].sum(), _weighted(pdf["low"], pdf["low_w"]), _weighted(pdf["high"], pdf["high_w"]))],
                columns=["t", "below", "at", "above", "low", "high"],
            )

        seen = left.mapInPandas(look, "t int, below bigint, at bigint, above bigint, low double, low_w double, high double, high_w double")
        for r in seen.groupBy("t").applyInPandas(settle, "t int, below bigint, at bigint, above bigint, low double, high double").collect():
            s = open_[targets[r.t]]
            if s[3] is None:
                s[3] = r.low
            elif s[0] <= r.below:
                s[2], s[3] = s[3], r.low
            elif s[0] <= r.below + r.at:
                done[targets[r.t]] = s[3]
                del open_[targets[r.t]]
            else:
                s[0], s[1], s[3] = s[0] - r.below - r.at, s[3], r.high
        rounds += 1
        if rounds % SHRINK_EVERY == 0 and open_:
            bounds: dict[tuple, list] = {}
            for (g, m, _), s in open_.items():
                bounds.setdefault((g, m), []).append((s[1], s[2]))

            def shrink(it, bounds=bounds):
                for pdf in it:
                    out = []
                    for g, m, vals, wts in zip(pdf["grp"], pdf["metric"], pdf["vals"], pdf["wts"]):
                        v = np.frombuffer(vals, np.float64)
                        keep = np.zeros(len(v), bool)
                        for lo, hi in bounds.get((g, m), ()):
                            keep[np.searchsorted(v, lo, "right") : np.searchsorted(v, hi, "left")] = True
                        if keep.any():
                            out.append((g, m, v[keep].tobytes(), None if wts is None else np.frombuffer(wts, np.int64)[keep].tobytes()))
                    yield pd.DataFrame(out, columns=["grp", "metric", "vals", "wts"])

            left = staged(left.mapInPandas(shrink, "grp string, metric string, vals binary, wts binary"))
    return [(g, m, q, total[(g, m, q)], v) for (g, m, q), v in sorted(done.items())]


def percentiles(stored: DataFrame, quantiles=QUANTILES, names=("grp", "metric")) -> DataFrame:
    rows = select(stored, quantiles)
    return stored.sparkSession.createDataFrame(rows, f"{names[0]} string, {names[1]} string, q double, n bigint, value double")


def input_type(c: Column) -> Column:
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def eval_runs(evals: DataFrame, by_day: bool = False, limit: int = 0) -> DataFrame:
    return runs(evals, "eval_id", "ingest_ts", "eval_ts", input_type(F.col("input_type")), ["total_ms", "parse_ms", "ir_ms"], by_day, limit)


def day_partials(evals: DataFrame, points: int = POINTS) -> DataFrame:
    """One mergeable partial result per day, input type and metric."""
    return merged(eval_runs(evals, by_day=True, limit=FINER * points), points)


def from_partials(partials: DataFrame, points: int = POINTS, quantiles=QUANTILES, names=("grp", "metric")) -> DataFrame:
    """Percentiles over all partial results, with the bound of their rank
    error as a share of ``n``: half a stretch for the last thinning, and an
    eighth for each of the two before it, which is less than one stretch."""
    return percentiles(partials, quantiles, names).withColumn("rank_error", F.lit(1.0 / points))
