"""Splits that keep related records together (problem 6).

Method: grouped iterative stratification.  Records that share a key (family
or hash) are joined to components; each component has a vector of label
counts; components are placed rarest outstanding label first, each into the
split that needs that label most.

Components come from a graph of *keys*, not of records: keys of the one kind
are linked where a key of the other kind holds both, so a hot key is one node
and never a star of all its records.

Placement is sequential, so it runs on units of bounded number: components
holding at least ``1 / heavy`` of the records one by one (at most ``heavy``),
the others gathered by rarest label and hash bucket (at most
``labels * buckets``).  Both are such that the driver holds at most
``DRIVER_ROWS`` sums, whatever the number of labels (``MAX_LABELS`` at most).

Defined results: null and blank keys join nothing; a record without keys is a
component of its own; null labels are a label of their own; tables that are
empty give empty results; shares are scaled to sum to 1, null or negative
ones count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.components import components
from triagelake.session import hot_keys, join_unique, staged

# rows (unit, label) that the driver holds, most of one component and of a label
DRIVER_ROWS = 100_000
HEAVY, BUCKETS, MAX_LABELS = 2_000, 512, 100


def key(c: Column) -> Column:
    """Compared after trimming and without regard to case; blank is null."""
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def groups(df: DataFrame, row_id: str, coarse: Column, fine: Column, *keep: str) -> DataFrame:
    """``(id, group_id, group_rows)`` of every row, with the columns ``keep``:
    the least id of the rows it is connected with through equal ``coarse`` or
    ``fine`` keys."""
    rows = staged(df.select(F.col(row_id).alias("id"), key(coarse).alias("c"), key(fine).alias("f"), *keep))
    hot_c, hot_f = hot_keys(rows, "c"), hot_keys(rows, "f")
    # one row per pair of keys, so copies and hot keys shrink before any join
    cells = staged(rows.groupBy("c", "f").agg(F.min("id").alias("id")))
    coarse_ids = staged(cells.where("c is not null").groupBy("c").agg(F.min("id").alias("cid")))
    linked = staged(join_unique(cells.where("c is not null and f is not null"), coarse_ids, "c", "inner", hot_c).select("f", "cid"))
    least = linked.groupBy("f").agg(F.min("cid").alias("least"))
    edges = linked.join(least, "f").where("cid <> least").select(F.col("cid").alias("u"), F.col("least").alias("v"))
    roots = staged(components(edges))
    coarse_root = coarse_ids.join(roots.select(F.col("node").alias("cid"), "component"), "cid", "left").select("c", F.coalesce("component", "cid").alias("c_root"))
    fine_root = (
        cells.where("f is not null").groupBy("f").agg(F.min("id").alias("f_least"))
        .join(least, "f", "left")
        .join(roots.select(F.col("node").alias("least"), "component"), "least", "left")
        .select("f", F.coalesce("component", "least", "f_least").alias("f_root"))
    )
    marked = join_unique(rows, coarse_root, "c", "left", hot_c)
    marked = join_unique(marked, fine_root, "f", "left", hot_f)
    marked = staged(marked.select("id", F.coalesce("c_root", "f_root", "id").alias("root"), *keep))
    sums = marked.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_rows"))
    return join_unique(marked, sums, "root", "inner", hot_keys(marked, "root")).select("id", "group_id", "group_rows", *keep)


def stratify(units: list[tuple], shares: dict[str, float]) -> dict:
    """Iterative stratification of ``(unit, {label: count})``."""
    labels = sorted({x for _, v in units for x in v})
    total = {x: sum(v.get(x, 0) for _, v in units) for x in labels}
    need = {s: {x: shares[s] * total[x] for x in labels} for s in shares}
    room = {s: shares[s] * sum(total.values()) for s in shares}
    waiting = {x: sorted((u for u in units if u[1].get(x)), key=lambda u: (-u[1][x], str(u[0]))) for x in labels}
    at = dict.fromkeys(labels, 0)
    left = dict(total)
    placed: dict = {}
    while True:
        rest = [x for x in labels if left[x] > 0]
        if not rest:
            break
        x = min(rest, key=lambda y: (left[y], y))
        while waiting[x][at[x]][0] in placed:
            at[x] += 1
        unit, vector = waiting[x][at[x]]
        s = max(shares, key=lambda s: (need[s][x], room[s], shares[s], s))
        placed[unit] = s
        for y, n in vector.items():
            need[s][y] -= n
            left[y] -= n
            room[s] -= n
    return placed


def assign(members: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``(id, group_id, split)`` for ``members(id, group_id, group_rows, label)``."""
    spark = members.sparkSession
    weight = {s: max(float(x or 0), 0.0) for s, x in targets.items() if s is not None}
    scale = sum(weight.values())
    if scale <= 0:
        raise ValueError("no split has a positive share")
    shares = {s: x / scale for s, x in weight.items()}
    members = staged(members.withColumn("label", F.coalesce("label", F.lit("\0null"))))
    totals = {r[0]: r[1] for r in members.groupBy("label").count().limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    rows = sum(totals.values())
    rank = {x: i for i, x in enumerate(sorted(totals, key=lambda x: (totals[x], x)))}
    vectors = members.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"), F.first("group_rows").alias("group_rows"))
    order = spark.createDataFrame(list(rank.items()) or [("", 0)], "label string, rank int")
    vectors = vectors.join(F.broadcast(order), "label")
    n = max(len(totals), 1)
    most_heavy = max(min(HEAVY, DRIVER_ROWS // (2 * n)), 1)
    buckets = max(min(BUCKETS, DRIVER_ROWS // (2 * n * n)), 1)
    heavy = F.col("group_rows") * most_heavy >= rows
    rarest = vectors.groupBy("group_id").agg(F.min("rank").alias("rarest"), F.first("group_rows").alias("group_rows"))
    unit = F.when(heavy, F.concat(F.lit("g"), F.col("group_id").cast("string"))).otherwise(
        F.concat_ws("-", F.lit("b"), F.col("rarest").cast("string"), F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("string"))
    )
    units_of = staged(rarest.select("group_id", unit.alias("unit")))
    sums = vectors.select("group_id", "label", "n").join(units_of, "group_id").groupBy("unit", "label").agg(F.sum("n").alias("n"))
    units: dict[str, dict] = {}
    for r in sums.collect():  # at most (most_heavy + labels * buckets) * labels rows
        units.setdefault(r.unit, {})[r.label] = int(r.n)
    placed = stratify(sorted(units.items()), shares)
    where = spark.createDataFrame(list(placed.items()) or [("", "")], "unit string, split string")
    split_of = units_of.join(F.broadcast(where), "unit").select("group_id", "split")
    return join_unique(members.select("id", "group_id", "label"), split_of, "group_id", "inner", hot_keys(members, "group_id")).select(
        "id", "group_id", "split", F.when(F.col("label") != "\0null", F.col("label")).alias("label")
    )


def stat_groups(sample_stat: DataFrame, *keep: str) -> DataFrame:
    return groups(sample_stat, "stat_id", F.col("family"), F.col("sha256"), *keep)


def found(sample_stat: DataFrame) -> DataFrame:
    return stat_groups(sample_stat).where("group_rows > 1").select(F.col("id").alias("stat_id"), "group_id")


def stat_splits(sample_stat: DataFrame, split_targets: DataFrame) -> DataFrame:
    targets = {r[0]: r[1] for r in split_targets.select("split", "target_share").limit(1_000).collect()}
    return assign(stat_groups(sample_stat, "label"), targets).select(F.col("id").alias("stat_id"), "group_id", "split", "label")


def split_report(splits: DataFrame, split_targets: DataFrame) -> DataFrame:
    """Shares reached per label, and overall (label null), beside the targets."""
    by = splits.groupBy("label", "split").agg(F.count(F.lit(1)).alias("records"))
    overall = by.groupBy("split").agg(F.sum("records").alias("records")).select(F.lit("(all)").alias("label"), "split", "records")
    both = by.unionByName(overall)
    totals = both.groupBy("label").agg(F.sum("records").alias("total"))
    return (
        both.join(totals, both.label.eqNullSafe(totals.label)).drop(totals.label)
        .join(split_targets.select("split", "target_share"), "split", "left")
        .select("label", "split", "records", F.round(F.col("records") / F.col("total"), 6).alias("share"), "target_share")
    )
