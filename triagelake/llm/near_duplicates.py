"""Near-duplicate records with small edits (problem 2).

Method: a blocked sparse product of the document by n-gram incidence matrix.
Each text is its set of three-word runs.  Runs are taken rare first (by a
bucketed frequency count over all data); the first ``n - ceil(t*n) + 1`` of
them suffice to meet every text alike by ``t`` or more.  Blocks of runs are
multiplied with numpy, overlap counts are added up per pair over all blocks,
and pairs whose overlap cannot reach ``ceil(t/(1+t) * (na + nb))`` are
discarded.  The pairs left are counted on whole texts (runs told apart by 32
bits of their hash within a pair).

The number of blocks follows the number of incidences, a block is a task, and
a run that stands in very many texts is split by pairs of slices of its
texts, each a run of its own in some block.

Texts with the same set of runs form one class and go through the product
once, so groups of copies cost one member; classes are reported as membership
and only :func:`pairs` expands them.

Defined results: null texts and texts under 20 words belong to no class.
Empty tables give empty results.  Several values of one row may be given;
two rows are alike if any same-named value is.  Extra columns are ignored.
Row ids are expected to be unique; a row id given twice is one record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import _grams as G
from triagelake.session import hot_keys, join_split, join_unique, staged

THRESHOLD = 0.6


def _values(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """One row per (row, field) with a value."""
    parts = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("string").alias("v")) for i, f in enumerate(fields)])
    return df.select(F.col(row_id).alias("id"), F.explode(parts).alias("x")).select("id", F.col("x.f").alias("s"), "x.v").where("v is not null")


def _survey(values: DataFrame, min_words: int, bits: int) -> DataFrame:
    """First pass: class of each value and the frequency sketch."""
    columns = ["id", "s", "hi", "lo", "n", "part", "slot", "counts"]

    def scan(it):
        cache, sketch, seen = G._Hashes(), G.Sketch(bits), G.Seen()
        for pdf in it:
            out = []
            for i, s, h in zip(pdf["id"], pdf["s"], G.word_hashes(pdf["v"], cache)):
                if len(h) >= min_words:
                    g = G.runs(h, s)
                    key = G.identity(g)
                    if seen.first(key):
                        sketch.add(g)
                    out.append((i, s, *key, len(g), None, None, None))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(None,) * 5 + r for r in sketch.rows()], columns=columns)

    return values.mapInPandas(scan, "id bigint, s int, hi int, lo bigint, n int, part int, slot int, counts binary")


def _multiply(t: float):
    """Overlap counts of the pairs within a block, bounded by size."""

    def run(x: G.Incidences):
        def least(a, b):
            na, nb = x.n[a], x.n[b]
            rest = np.maximum(np.ceil(t * na - 1e-9), np.ceil(t * nb - 1e-9)) - 1
            return np.maximum(np.ceil(t / (1 + t) * (na + nb) - 1e-9) - rest, 1).astype(np.int64)

        counts = G.PairCounts(x, least, ordered=False)
        at = np.flatnonzero(x.g[1:] == x.g[:-1])
        shift = 1
        while len(at):
            a, b = x.d[at], x.d[at + shift]
            na, nb = x.n[a], x.n[b]
            ok = (a != b) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9)
            sa, sb = x.side[at], x.side[at + shift]
            ok &= (sa == 0) & (sb == 0) | (sa != sb)
            yield from counts.add(np.minimum(a, b)[ok], np.maximum(a, b)[ok])
            shift += 1
            at = at[at + shift < len(x.g)]
            at = at[x.g[at] == x.g[at + shift]]
        yield counts.frame()

    return run


def near_duplicates(df: DataFrame, row_id: str, fields: list[str], threshold: float = THRESHOLD, min_words: int = G.MIN_WORDS):
    """Classes of equal texts and the pairs of classes alike by ``threshold``.

    Returns ``(members, links)``: ``members(id, s, hi, lo, n)`` has one row per
    record and field ``s``, ``links(s, a_hi, a_lo, b_hi, b_lo, overlap,
    likeness)`` one row per pair of different classes.
    """
    t = threshold
    values = _values(df, row_id, fields)
    bits = G.sketch_bits(values)
    survey = staged(_survey(values, min_words, bits))
    members = survey.where("id is not null").select("id", "s", "hi", "lo", "n")
    total = members.agg(F.sum("n")).first()[0] or 0
    counts = df.sparkSession.sparkContext.broadcast(G.merged_sketch(survey.where("part is not null"), bits))

    def fill(pdf, blocks, state):
        cache, seen = state.setdefault("cache", G._Hashes()), state.setdefault("seen", G.Seen())
        for s, h in zip(pdf["s"], G.word_hashes(pdf["v"], cache)):
            if len(h) < min_words:
                continue
            g = G.runs(h, s)
            key = G.identity(g)
            if seen.first(key):
                n = len(g)
                g = g[G.rare_first(g, counts.value)[: n - int(np.ceil(t * n - 1e-9)) + 1]]
                g, sides = G.split_square(g, G.slices_of(g, counts.value), key[1])
                blocks.add(key, n, 0, g, sides=sides)

    blocks = G.n_blocks(int(total * (1 - t)))
    found = staged(G.product(G.incidence_blocks(values, fill, blocks), _multiply(t), blocks))

    def pack(h, s):
        g = G.runs(h, s)
        return G.identity(g), (np.unique((g >> np.uint64(20)).astype(np.uint32)).tobytes(), None, None)

    def judge(own, other):
        x, y = (np.frombuffer(z[0], np.uint32) for z in (own, other))
        k = int(G.shared(x, y).sum())
        j = k / (len(x) + len(y) - k)
        return (k, j) if j >= t - 1e-12 else None

    return members, G.compared(values, members, found, pack, judge, "overlap int, likeness double", blocks)


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records that are alike, smaller id first.

    The pairs within a class and between two are as many as the result has;
    those of a large class are made by several tasks.
    """
    own = lambda end: F.concat_ws(":", "s", f"{end}hi", f"{end}lo")
    rows = members.select(own("").alias("k"), "id")
    hot = hot_keys(rows, "k")
    x, y = rows.select("k", F.col("id").alias("x")), rows.select("k", F.col("id").alias("y"))
    same = join_split(x, y, "k", hot).where("x < y").select("x", "y")
    near = join_split(x, links.select(own("a_").alias("k"), own("b_").alias("to")), "k", hot).select("x", F.col("to").alias("k"))
    near = join_split(near, y, "k", hot).where("x <> y").select("x", "y")
    return same.unionByName(near).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record and field: its class and the class's number of links."""
    keys = ["s", "hi", "lo"]
    ends = links.select("s", F.explode(F.array(F.struct(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")), F.struct(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo")))).alias("e"))
    degree = ends.groupBy("s", "e.hi", "e.lo").agg(F.count(F.lit(1)).alias("links"))
    size = members.groupBy(*keys).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    info = size.join(degree, keys, "left").select(F.concat_ws(":", *keys).alias("k"), "class_id", "class_rows", "links")
    rows = members.select(F.concat_ws(":", *keys).alias("k"), "id", "s")
    return join_unique(rows, info, "k", "inner", hot_keys(rows, "k")).select(
        F.col("id").alias("row_id"), F.col("s").alias("field"), "class_id", "class_rows", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )
