"""Consensus from several annotators' labels (problem 1).

Method: iteratively reweighted voting.  Each round gives every item the label
with the largest weighted support, and every annotator a smoothed accuracy
against the consensus of the *other* annotators (leave one out) over all
items that have others, two votes or more; the weights
of the next round follow from it, until no accuracy moves.  A weight is the
log-odds of the accuracy, so annotators right less than half of the time
(also groups that copy each other's mistakes) hardly count.  Agreement is
reported as Krippendorff's alpha, which corrects for chance and takes items
as they come, with ratings missing.

Votes are reduced to one per (item, annotator) before they are gathered, so
the votes of one item are at most as many as there are annotators.  Rounds
read the gathered votes with numpy and return two numbers per annotator.

Defined results: null items, annotators and labels take no part; several
ratings of an item by one annotator count once, with the latest.  Items with
one rating get that label, with agreement null.  Rounds that do not settle
within ``max_rounds`` give the last state, a warning and ``settled`` false.  Ties go to the label that
comes first in the alphabet.  Empty tables give empty results.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.session import staged

MAX_ANNOTATORS = 200_000
SMOOTHING = 10.0
MAX_ROUNDS = 50
TOLERANCE = 1e-4

# fixed values: words of detection names that tell no family
GENERIC_WORDS = (
    "acad", "adware", "agent", "alisp", "application", "autocad", "backdoor", "behaveslike", "detected",
    "downloader", "dropper", "generic", "grayware", "hacktool", "heur", "heuristic", "lisp", "loader", "macro",
    "malicious", "malware", "msil", "packed", "possible", "probably", "program", "riskware", "script",
    "spyware", "susgen", "suspicious", "threat", "tool", "trojan", "unknown", "unsafe", "unwanted", "variant",
    "virus", "worm",
)
# fixed values: the same among words of three letters
GENERIC_SHORT_WORDS = ("als", "fas", "gen", "lsp", "mal", "pua", "pup", "sus", "trj", "vba", "vbs", "vlx", "win")


def key(c: Column) -> Column:
    """Compared after trimming and without regard to case; blank is null."""
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def family_of(result: Column) -> Column:
    """The family word of a raw detection name, null for generic names: the
    first word of four letters (of any script) or more that tells a family,
    where there is none the first of three letters (two in scripts other than
    Latin)."""
    words = F.regexp_extract_all(F.lower(result), F.lit(r"(\p{L}+)"), F.lit(1))
    named = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))
    short = F.filter(words, lambda w: F.when(w.rlike("^[a-z]+$"), F.length(w) == 3).otherwise(F.length(w).between(2, 3)) & ~w.isin(*GENERIC_SHORT_WORDS))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(short, F.lit(1)))


@dataclass
class Consensus:
    items: DataFrame  # item, names array<string>, e array<int>, l array<int>
    annotators: DataFrame  # annotator, votes, reliability, weight
    result: DataFrame  # item, label, voters, support, agreement
    rounds: int
    settled: bool  # False where the last round still moved an accuracy


def gather(ratings: DataFrame, item: Column, annotator: Column, label: Column, order: Column) -> tuple[DataFrame, list[str]]:
    """One row per item with its votes; annotators and labels as numbers,
    labels numbered within the item in alphabetical order."""
    votes = ratings.select(item.alias("item"), annotator.alias("annotator"), label.alias("label"), order.alias("o"))
    votes = votes.where("item is not null and annotator is not null and label is not null")
    votes = staged(votes.groupBy("item", "annotator").agg(F.max_by("label", F.struct("o", "label")).alias("label")))
    names = sorted(r[0] for r in votes.select("annotator").distinct().limit(MAX_ANNOTATORS + 1).collect())
    if len(names) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    numbers = votes.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "annotator string, e int")
    gathered = votes.join(F.broadcast(numbers), "annotator").groupBy("item").agg(F.collect_list(F.struct("e", "label")).alias("v"))
    labels = F.array_sort(F.array_distinct("v.label"))
    rows = gathered.withColumn("names", labels).select(
        "item", "names", F.col("v.e").alias("e"), F.expr("transform(v.label, x -> cast(array_position(names, x) - 1 as int))").alias("l")
    )
    return staged(rows), names


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Votes of a batch as arrays: item number, annotator, label slot; and
    the item of each label slot."""
    nv = pdf["e"].map(len).to_numpy()
    nl = pdf["names"].map(len).to_numpy()
    base = np.concatenate(([0], np.cumsum(nl)))
    i = np.repeat(np.arange(len(pdf)), nv)
    e = np.concatenate(list(pdf["e"])).astype(np.int64)
    slot = np.concatenate(list(pdf["l"])).astype(np.int64) + base[i]
    return i, e, slot, np.repeat(np.arange(len(pdf)), nl), base


def _leaders(score: np.ndarray, owner: np.ndarray, base: np.ndarray):
    """The best slot of each item, and the best score among its others."""
    order = np.lexsort((np.arange(len(score)), -score, owner))
    best = order[base[:-1]]
    has = np.diff(base) > 1
    second = np.full(len(best), -np.inf)
    second[has] = score[order[base[:-1][has] + 1]]
    second_slot = np.full(len(best), -1)
    second_slot[has] = order[base[:-1][has] + 1]
    return best, second, second_slot


def _round(items: DataFrame, w: np.ndarray, min_voters: int) -> tuple[np.ndarray, np.ndarray]:
    n_annotators = len(w)

    def run(it):
        hits, n = np.zeros(n_annotators), np.zeros(n_annotators)
        for pdf in it:
            pdf = pdf[pdf["e"].map(len) >= min_voters]
            if not len(pdf):
                continue
            i, e, slot, owner, base = _flat(pdf)
            score = np.bincount(slot, w[e], len(owner))
            best, second, second_slot = _leaders(score, owner, base)
            own = slot == best[i]
            # without this vote its label keeps the lead if it beats the
            # second one, or ties with it and comes first
            rest = score[slot] - w[e]
            keeps = (rest > second[i] + 1e-12) | ((np.abs(rest - second[i]) <= 1e-12) & (slot < second_slot[i]))
            alone = np.bincount(slot, minlength=len(owner))[slot] == 1
            hit = own & keeps & ~alone
            hits += np.bincount(e, hit, n_annotators)
            n += np.bincount(e, minlength=n_annotators)
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"e": seen.astype(np.int32), "h": hits[seen], "n": n[seen]})

    hits, n = np.zeros(n_annotators), np.zeros(n_annotators)
    for r in items.select("names", "e", "l").mapInPandas(run, "e int, h double, n double").groupBy("e").agg(F.sum("h"), F.sum("n")).collect():
        hits[r[0]], n[r[0]] = r[1], r[2]
    return hits, n


def weights(accuracy: np.ndarray) -> np.ndarray:
    return np.maximum(np.log(accuracy / (1 - accuracy)), 1e-3 * accuracy)


def consensus(
    ratings: DataFrame, item: Column, annotator: Column, label: Column, order: Column,
    min_voters: int = 2, smoothing: float = SMOOTHING, max_rounds: int = MAX_ROUNDS,
) -> Consensus:
    items, names = gather(ratings, item, annotator, label, order)
    spark = items.sparkSession
    accuracy, w, votes = np.full(len(names), 0.5), np.ones(len(names)), np.zeros(len(names))
    rounds, settled = 0, not names
    for rounds in range(1, max_rounds + 1):
        hits, votes = _round(items, w, min_voters)
        now = (hits + smoothing / 2) / (votes + smoothing)
        moved = float(np.abs(now - accuracy).max(initial=0.0))
        accuracy, w = now, weights(now)
        settled = moved < TOLERANCE
        if settled:
            break
    if not settled:
        warnings.warn(f"reliabilities still move by {moved:.2g} after {rounds} rounds", stacklevel=2)

    def decide(it):
        for pdf in it:
            if not len(pdf):
                continue
            i, e, slot, owner, base = _flat(pdf)
            score = np.bincount(slot, w[e], len(owner))
            count = np.bincount(slot, minlength=len(owner))
            best, _, _ = _leaders(score, owner, base)
            voters = np.bincount(i, minlength=len(pdf))
            yield pd.DataFrame(
                {
                    "item": pdf["item"].to_numpy(),
                    "label": [x[b] for x, b in zip(pdf["names"], best - base[:-1])],
                    "voters": voters.astype(np.int32),
                    "support": score[best] / np.bincount(i, w[e], len(pdf)),
                    "agreement": np.where(voters > 1, count[best] / np.maximum(voters, 1), np.nan),
                }
            )

    result = items.mapInPandas(decide, "item string, label string, voters int, support double, agreement double")
    result = result.withColumn("agreement", F.when(~F.isnan("agreement"), F.col("agreement")))
    who = spark.createDataFrame(
        [(n, int(v), float(a), float(x)) for n, v, a, x in zip(names, votes, accuracy, w)],
        "annotator string, judged_votes bigint, reliability double, weight double",
    )
    return Consensus(items, who, result, rounds, settled)


def alpha(items: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels over items with two ratings or
    more: one row (items, ratings, observed, expected, alpha)."""
    slots = items.where(F.size("e") > 1).select(
        "item", F.size("e").cast("bigint").alias("m"), F.explode(F.expr("transform(l, x -> names[x])")).alias("label")
    )
    cells = slots.groupBy("item", "label").agg(F.first("m").alias("m"), F.count(F.lit(1)).alias("n"))
    per_item = cells.groupBy("item").agg(F.first("m").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    observed = per_item.agg(
        F.count(F.lit(1)).alias("items"), F.sum("m").alias("ratings"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("o")
    )
    totals = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    items_n, n, o = observed.first()
    sq = totals.first()[0]
    rows = []
    if n and n > 1:
        expected = (float(n) * n - sq) / (float(n) * (n - 1))
        rows.append((items_n, n, round(o / n, 6), round(expected, 6), round(1 - o / n / expected, 6) if expected > 0 else None))
    return items.sparkSession.createDataFrame(rows, "items bigint, ratings bigint, observed double, expected double, alpha double")


def engine_consensus(engine_labels: DataFrame) -> Consensus:
    order = F.struct("scanned_at", "label_id")
    return consensus(engine_labels, key(F.col("sha256")), key(F.col("engine")), family_of(F.col("result")), order)


def misnamed(engine_labels: DataFrame, sample_stat: DataFrame, min_engines: int = 3) -> DataFrame:
    """``stat_id`` of the records whose family is not the joint one."""
    joint = engine_consensus(engine_labels).result.where(F.col("voters") >= min_engines).select(F.col("item").alias("k"), "label")
    rows = sample_stat.select("stat_id", key(F.col("sha256")).alias("k"), key(F.col("family")).alias("family")).where("k is not null and family is not null")
    return rows.join(joint, "k").where("family <> label").select("stat_id")
