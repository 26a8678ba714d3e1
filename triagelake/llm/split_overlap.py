"""Records that stand in two splits, exactly, nearly or as a part (problem 3).

Method: content-defined chunks.  Normalised texts (lower-cased words) are cut
where a hash that rolls over three words hits a cut value; chunk digests are
joined across splits in blocks, and the lengths of shared chunks are summed
to the part of an evaluation text that a training text holds.

``cut`` is the mean length of a chunk in windows.  With ``cut`` 1 every window
is a chunk, and the summed overlap is the part of the different three-word
runs, which is what problem 3 asks for: this is the exact mode, and what the
queries use.  A larger ``cut`` sends fewer digests, but an edit then spoils a
whole chunk, so the overlap is underrated (README has figures).

Each evaluation text offers its chunks rare first, by a bucketed count over
all training chunks, up to a length of ``n - t + k`` of its ``n``, where ``t``
is the length that a training text has to hold and ``k`` a tenth of ``n``.  A
text that holds ``t`` lacks ``n - t`` at most, so it holds ``k`` of what is
offered, however edited or short the texts: no pair is lost on the way.
Pairs that reach ``k`` are summed up over all chunks of both whole texts.

The number of blocks follows the number of chunks, a block is a task, and a
chunk of very many training texts is split by slices of these.

Defined results: null splits, null texts and texts under 20 words take no
part in the comparison of texts; records whose normalised ``sample`` values
are equal form a pair whatever their texts.  Texts with equal sets of runs
are compared once.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm import _grams as G
from triagelake.session import hot_keys, join_split, join_unique, staged

CONTAINED = 0.75
CUT = 1
# length that a pair is summed up from: one in so many of the evaluation text
TENTH = 10
STEP = 1_000_000


def path_key(c: Column) -> Column:
    """A sample path without regard to case and the direction of slashes."""
    return F.lower(F.translate(c, "\\", "/"))


def _survey(texts: DataFrame, min_words: int, cut: int, bits: int) -> DataFrame:
    """First pass: class and chunk length of each text, frequency sketch."""
    columns = ["id", "s", "hi", "lo", "n", "part", "slot", "counts"]

    def scan(it):
        cache, sketch, seen = G._Hashes(), G.Sketch(bits), G.Seen()
        for pdf in it:
            out = []
            for i, s, h in zip(pdf["id"], pdf["s"], G.word_hashes(pdf["v"], cache)):
                if len(h) >= min_words:
                    key = G.identity(G.runs(h))
                    c, length = G.chunks(h, cut)
                    if s == 0 and seen.first(key):
                        sketch.add(c)
                    out.append((i, s, *key, int(length.sum()), None, None, None))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(None,) * 5 + r for r in sketch.rows()], columns=columns)

    return texts.mapInPandas(scan, "id bigint, s int, hi int, lo bigint, n int, part int, slot int, counts binary")


def _multiply(contained: float):
    """Summed lengths of the shared offered chunks of the (train, evaluation)
    pairs within a block."""

    def run(x: G.Incidences):
        ev = x.kind[x.d] == 1
        tg, td = x.g[~ev], x.d[~ev]
        eg, ed, ew = x.g[ev], x.d[ev], x.w[ev]
        lo = np.searchsorted(tg, eg, "left")
        left = np.searchsorted(tg, eg, "right") - lo
        counts = G.PairCounts(x, lambda a, b: _least(x.n[b], contained), ordered=True)
        while True:
            # so many incidences at once as make about STEP pairs; one that
            # alone makes more is taken in slices
            open_ = np.flatnonzero(left > 0)
            if not len(open_):
                break
            k = np.minimum(left[open_], STEP)
            take = open_[: max(int(np.searchsorted(np.cumsum(k), STEP, "right")), 1)]
            k = k[: len(take)]
            e = np.repeat(take, k)
            t = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[take], k)
            lo[take] += k
            left[take] -= k
            a, b = td[t], ed[e]
            ok = x.n[a] >= contained * x.n[b] - 1e-9
            yield from counts.add(a[ok], b[ok], ew[e][ok])
        yield counts.frame()

    return run


def _least(n: np.ndarray, contained: float) -> np.ndarray:
    """Shared offered length from which a pair is summed up."""
    return np.minimum(np.ceil(contained * n - 1e-9), -(-n // TENTH)).astype(np.int64)


def split_overlap(
    df: DataFrame,
    row_id: str = "row_id",
    split: str = "split",
    text: str = "text",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("dev", "test"),
    contained: float = CONTAINED,
    min_words: int = G.MIN_WORDS,
    cut: int = CUT,
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts by side, and the pairs of classes that overlap.

    ``members(id, s, hi, lo, n)`` has the side ``s`` (0 train, 1 evaluation)
    and the chunk length ``n``; ``links(b_hi, b_lo, a_hi, a_lo, held)`` an
    evaluation class, a training class, and the part of the former's length
    in chunks that the latter holds.
    """
    side = F.when(F.col(split).isin(*train), 0).when(F.col(split).isin(*evaluation), 1)
    texts = df.select(F.col(row_id).alias("id"), side.alias("s"), F.col(text).alias("v")).where("s is not null and v is not null")
    bits = G.sketch_bits(texts)
    survey = staged(_survey(texts, min_words, cut, bits))
    members = survey.where("id is not null").select("id", "s", "hi", "lo", "n")
    total = members.agg(F.sum("n")).first()[0] or 0
    counts = df.sparkSession.sparkContext.broadcast(G.merged_sketch(survey.where("part is not null"), bits))

    def fill(pdf, blocks, state):
        cache, seen = state.setdefault("cache", G._Hashes()), state.setdefault("seen", G.Seen())
        for s, h in zip(pdf["s"], G.word_hashes(pdf["v"], cache)):
            if len(h) < min_words:
                continue
            key = G.identity(G.runs(h))
            if not seen.first((*key, s)):
                continue
            g, w = G.chunks(h, cut)
            n = int(w.sum())
            if s:
                order = G.rare_first(g, counts.value)
                want = n - int(np.ceil(contained * n - 1e-9)) + int(_least(np.array(n), contained))
                order = order[: int(np.searchsorted(np.cumsum(w[order]), want)) + 1]
                g, w = g[order], w[order]
            g, w = G.split_cross(g, w, G.slices_of(g, counts.value), key[1], all_of=bool(s))
            blocks.add(key, n, s, g, w)

    blocks = G.n_blocks(total // cut)
    found = staged(G.product(G.incidence_blocks(texts, fill, blocks), _multiply(contained), blocks))
    # the evaluation text is the first of a pair from here on
    found = found.select(*[F.col(f"{x}_{y}").alias(f"{z}_{y}") for x, z in (("b", "a"), ("a", "b")) for y in ("hi", "lo")])

    def pack(h, s):
        g, w = G.chunks(h, cut)
        return G.identity(G.runs(h)), (g.tobytes(), w.astype(np.uint32).tobytes() if s and cut > 1 else None, None)

    def judge(own, other):
        e, t = np.frombuffer(own[0], np.uint64), np.frombuffer(other[0], np.uint64)
        w = np.ones(len(e)) if own[1] is None else np.frombuffer(own[1], np.uint32)
        held = float(w[G.shared(t, e)].sum() / w.sum())
        return (held,) if held >= contained - 1e-12 else None

    links = G.compared(texts, members, found, pack, judge, "held double", blocks, sides=(1, 0))
    return members, links.select(F.col("a_hi").alias("b_hi"), F.col("a_lo").alias("b_lo"), F.col("b_hi").alias("a_hi"), F.col("b_lo").alias("a_lo"), "held")


def _keyed(rows: DataFrame, hi: str, lo: str, *rest) -> DataFrame:
    return rows.select(F.concat_ws(":", hi, lo).alias("k"), *rest)


def text_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of records (x train, y evaluation) whose classes are linked."""
    x = _keyed(members.where("s = 0"), "hi", "lo", F.col("id").alias("x"))
    y = _keyed(members.where("s = 1"), "hi", "lo", F.col("id").alias("y"))
    near = join_split(x, _keyed(links, "a_hi", "a_lo", F.concat_ws(":", "b_hi", "b_lo").alias("to")), "k", hot_keys(x, "k"))
    return join_split(near.select("x", F.col("to").alias("k")), y, "k", hot_keys(y, "k")).select("x", "y")


def sample_pairs(df: DataFrame, row_id: str = "row_id", split: str = "split", sample: str = "sample", train=("train",), evaluation=("dev", "test")) -> DataFrame:
    """Pairs of a training and an evaluation record of the same sample."""
    rows = df.select(F.col(row_id).alias("id"), F.col(split).alias("split"), path_key(F.col(sample)).alias("k")).where("k is not null")
    x = rows.where(F.col("split").isin(*train)).select("k", F.col("id").alias("x"))
    y = rows.where(F.col("split").isin(*evaluation)).select("k", F.col("id").alias("y"))
    return join_split(x, y, "k", hot_keys(x, "k")).select("x", "y")


def found_pairs(df: DataFrame, cut: int = CUT) -> DataFrame:
    """All overlapping pairs, smaller id first."""
    members, links = split_overlap(df, cut=cut)
    both = text_pairs(members, links).unionByName(sample_pairs(df))
    return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: its side, its class, and how many classes of the
    other side its own overlaps with.  Copies are not expanded to pairs."""
    keys = ["s", "hi", "lo"]
    ends = links.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"{x}_hi").alias("hi"), F.col(f"{x}_lo").alias("lo")) for s, x in ((0, "a"), (1, "b"))])).alias("e"))
    degree = ends.groupBy("e.s", "e.hi", "e.lo").agg(F.count(F.lit(1)).alias("links"))
    size = members.groupBy(*keys).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    info = size.join(degree, keys, "left").select(F.concat_ws(":", *keys).alias("k"), "class_id", "class_rows", "links")
    rows = members.select(F.concat_ws(":", *keys).alias("k"), "id", "s")
    return join_unique(rows, info, "k", "inner", hot_keys(rows, "k")).select(
        F.col("id").alias("row_id"), F.when(F.col("s") == 0, "train").otherwise("evaluation").alias("side"), "class_id", "class_rows",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )


def report(df: DataFrame) -> DataFrame:
    """Evaluation records per split and repository, and how many overlap.

    The repository is the first segment of ``sample``; null samples count
    under a null repository.
    """
    members, links = split_overlap(df)
    best = _keyed(links, "b_hi", "b_lo", "held").groupBy("k").agg(F.max("held").alias("held"))
    own = _keyed(members.where("s = 1"), "hi", "lo", F.col("id").alias("row_id"))
    by_text = join_unique(own, best, "k", "inner", hot_keys(own, "k")).groupBy("row_id").agg(F.max("held").alias("held"))
    train_keys = df.where("split = 'train' and sample is not null").select(path_key(F.col("sample")).alias("k")).distinct()
    rows = df.where(F.col("split").isin("dev", "test")).select(
        "row_id", "split", path_key(F.col("sample")).alias("k"), F.split(path_key(F.col("sample")), "/")[0].alias("repository")
    )
    rows = join_unique(rows, train_keys.withColumn("same", F.lit(True)), "k", "left", hot_keys(rows, "k")).join(by_text, "row_id", "left")
    text_hit, sample_hit = F.col("held").isNotNull(), F.col("same").isNotNull()
    return rows.groupBy("split", "repository").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(text_hit).alias("text_overlaps"),
        F.count_if(sample_hit).alias("sample_overlaps"),
        F.count_if(text_hit | sample_hit).alias("overlaps"),
        F.round(F.count_if(text_hit | sample_hit) / F.count(F.lit(1)), 6).alias("overlap_rate"),
        F.round(F.avg("held"), 6).alias("mean_overlap"),
    )
