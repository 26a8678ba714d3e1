"""Mixing sources to target shares of the total size (problem 9).

Method: hash-threshold histograms.  Every document has a hash of its id.
Token counts are summed by source and the leading bits of the hash; prefix
sums of these bounded histograms tell in which bucket the hash threshold of a
source's budget lies, only that bucket is counted again by the next bits, and
so on.  The documents drawn are those below the threshold: a filter, no sort.

The total is the largest one at which every source that is there meets its
share with at most ``max_repeats`` uses of a document (or ``total`` where
that is given and smaller).  Shares are scaled to the sources that have
tokens.  A source with budget ``b`` and ``n`` tokens uses each document
``floor(b / n)`` times and those below the threshold once more, so the draw
for a smaller total is contained in the draw for a larger one.

Defined results: documents whose source is null or no target, and documents
without tokens, are not drawn.  A document id given twice counts twice and is
drawn together.  Null or negative shares and repeats count as 0.  A source
named twice in the targets counts with its shares added and its larger number
of repeats.  Empty tables give empty draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.tokenise import VOCABULARY, encode
from triagelake.session import staged

BITS = 60
# leading bits counted at once, fewer with many sources: so many buckets in all
STEP = 10
DRIVER_ROWS = 100_000
MAX_SOURCES = 10_000
SCHEMA = "source string, target_share double, scaled_share double, max_repeats int, available_tokens bigint, budget double, full_repeats int, threshold bigint"


def token_counts(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, h): the size and the hash of each document."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    ids = encode(rows, "text", ["doc_id", "source"], path=path)
    return ids.select("doc_id", "source", F.size("ids").alias("n_tokens"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS).alias("h"))


def plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> list[tuple]:
    """One row per target: its budget, full repeats and hash threshold.

    ``targets`` has one row per source of the mixture; more than
    ``MAX_SOURCES`` are refused, which bounds what the driver holds.
    """
    rows = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("r"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture of more than {MAX_SOURCES} sources")
    names = sorted(r.source for r in rows)
    want = {r.source: (float(r.share), int(r.r)) for r in rows}
    counts = counts.where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    size = {r.source: int(r.n) for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    usable = [s for s in names if size.get(s) and want[s][0] > 0 and want[s][1] > 0]
    share_sum = sum(want[s][0] for s in usable)
    scaled = {s: want[s][0] / share_sum for s in usable}
    reach = min((want[s][1] * size[s] / scaled[s] for s in usable), default=0.0)
    reach = reach if total is None else min(reach, float(total))
    budget = {s: scaled.get(s, 0.0) * reach for s in names}
    full = {s: min(want[s][1], int(budget[s] / size[s] + 1e-9)) if size.get(s) else 0 for s in names}
    left = {s: budget[s] - full[s] * size.get(s, 0) for s in names}
    # prefix: the leading bits fixed so far; below it everything is drawn
    prefix = {s: 0 for s in names if left[s] > 0 and full[s] < want[s][1]}
    threshold = {s: 0 for s in names}
    spark = counts.sparkSession
    high = BITS
    while prefix and high:
        step = max(min(STEP, (DRIVER_ROWS // len(prefix)).bit_length() - 1, high), 1)
        low = high - step
        edge = spark.createDataFrame(list(prefix.items()), "source string, prefix bigint")
        inside = counts.join(F.broadcast(edge), "source").where(F.shiftright("h", high) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("h", low).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        by: dict[str, list] = {}
        for r in hist.collect():  # at most 2**step rows a source
            by.setdefault(r.source, []).append((r.bucket, int(r.n), int(r.docs)))
        following = {}
        for s in prefix:
            threshold[s] = (prefix[s] + 1) << high
            for bucket, n, docs in sorted(by.get(s, ())):
                if n <= left[s]:
                    left[s] -= n
                    continue
                threshold[s] = bucket << low
                if docs == 1 or low == 0:  # the document on the edge: to the nearer side
                    if n - left[s] < left[s]:
                        threshold[s] = (bucket + 1) << low
                else:
                    following[s] = bucket
                break
        prefix, high = following, low
    return [(s, want[s][0], scaled.get(s, 0.0), want[s][1], size.get(s, 0), budget[s], full[s], threshold[s]) for s in names]


def draw(counts: DataFrame, planned: list[tuple]) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents drawn."""
    edges = counts.sparkSession.createDataFrame(planned, SCHEMA)
    rows = counts.where("n_tokens > 0").join(F.broadcast(edges), "source")
    repeats = F.col("full_repeats") + (F.col("h") < F.col("threshold")).cast("int")
    return rows.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def report(counts: DataFrame, planned: list[tuple]) -> DataFrame:
    """Targets beside the shares reached."""
    edges = counts.sparkSession.createDataFrame(planned, SCHEMA)
    drawn = draw(counts, planned).groupBy("source").agg(
        F.sum(F.col("n_tokens").cast("bigint") * F.col("repeats")).alias("drawn_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
    )
    total = drawn.agg(F.sum("drawn_tokens")).first()[0] or 0
    return edges.join(F.broadcast(drawn), "source", "left").select(
        "source",
        "target_share",
        F.round("scaled_share", 6).alias("scaled_share"),
        F.round(F.coalesce(F.col("drawn_tokens"), F.lit(0)) / F.greatest(F.lit(total), F.lit(1)), 6).alias("actual_share"),
        "available_tokens",
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "max_repeats",
    )


def staged_counts(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return staged(token_counts(df, path=path))
