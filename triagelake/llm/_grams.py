"""Word hashing, three-word runs, content-defined chunks and blocked products.

Texts are tokenised in Arrow batches with numpy; what leaves a Python worker
is packed binary, so a shuffle carries a few bytes per incidence instead of a
row per incidence.

Words are runs of letters and digits of the lower-cased text.  A *run* is a
window of three consecutive words, hashed to 64 bits.  A *chunk* is a stretch
of runs that starts where the hash of a run, which rolls over the words, hits
a cut value, so equal stretches are cut alike wherever they stand.

A text is known by a digest of 96 bits (``hi`` 32, ``lo`` 64) of its set of
runs; among 10^12 different texts about 6e-6 pairs share one by chance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
MIN_WORDS = 20
# counters of the frequency sketch: 2**22 up to so many runs of words, then
# with the runs, up to 2**26, which are a byte each where they are sent
SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_RUNS = 22, 26, 1 << 27
SKETCH_PARTS = 16
SKETCH_SLOTS = 64
# documents of a run that are multiplied in one piece
HOT = 4_096
# incidences of a block, and of a flush
PER_BLOCK = 1_000_000
FLUSH = 1_500_000
# texts a task remembers so as not to send a copy twice; more are forgotten
SEEN = 1_000_000
# partners of a text that are compared in one piece
FAN = 512
ROUTE_SLICES = 64

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(29)
_POW = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


class _Hashes(dict):
    """Word to 64-bit hash, filled on demand, forgotten when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _A
    return x ^ (x >> np.uint64(32))


_BLANK = {i: " " for i in range(128) if not chr(i).isalnum()}


def words_of(text: str | None) -> list[str]:
    """Words of a text; plain ASCII is split without the pattern, which gives
    the same words."""
    if not text:
        return []
    text = text.lower()
    return text.translate(_BLANK).split() if text.isascii() else WORD.findall(text)


def word_hashes(texts, cache: _Hashes) -> Iterator[np.ndarray]:
    """One array of word hashes per text; an empty one for a null."""
    look = cache.__getitem__
    for t in texts:
        words = words_of(t)
        yield np.fromiter(map(look, words), np.uint64, len(words))


def _different(g: np.ndarray) -> np.ndarray:
    """The different values, sorted; ``g`` is sorted in place."""
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) else g


def windows(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each three-word window, in order: it rolls over the words."""
    if len(h) < 3:
        return np.empty(0, np.uint64)
    return mix((h[:-2] * _A + (h[1:-1] ^ (h[1:-1] >> _S)) * _B + h[2:] * _C) ^ np.uint64(salt))


def runs(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The different three-word runs of a text, sorted."""
    return _different(windows(h, salt))


def chunks(h: np.ndarray, cut: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Digests, sorted, and lengths (in windows) of the different chunks.

    A chunk starts at the first window and at each whose hash is divisible by
    ``cut``, and goes on to the next start: ``cut`` windows on average, and
    exactly one where ``cut`` is 1.
    """
    w = windows(h)
    if cut <= 1 or not len(w):
        g = _different(w)
        return g, np.ones(len(g), np.int64)
    starts = np.flatnonzero(np.append(True, w[1:] % np.uint64(cut) == 0))
    length = np.diff(np.append(starts, len(w)))
    pos = np.arange(len(w)) - np.repeat(starts, length)
    digest = mix(np.add.reduceat(w * _POW[pos & 4095] + (pos >> 12).astype(np.uint64), starts) + length.astype(np.uint64))
    digest, first = np.unique(digest, return_index=True)
    return digest, length[first]


def identity(g: np.ndarray) -> tuple[int, int]:
    """(hi, lo), signed 32 and 64 bits, of a sorted set of runs."""
    d = xxhash.xxh3_128_digest(g.tobytes())
    return int.from_bytes(d[:4], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Seen(set):
    """Texts that a task has met; bounded, as a text met again does no harm."""

    def first(self, key) -> bool:
        if key in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(key)
        return True


# --------------------------------------------------------------- frequencies


def sketch_bits(df: DataFrame, text: str = "v") -> int:
    """Size of the sketch for the texts of ``df``, by their length."""
    runs_about = (df.agg(F.sum(F.length(text))).first()[0] or 0) / 6
    return min(SKETCH_BITS + max(int(np.ceil(np.log2(max(runs_about, 1) / SKETCH_RUNS))), 0), MOST_SKETCH_BITS)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, compressed."""
    most = int(counts.max(initial=0))
    k = next(k for k in "1248" if most < 1 << 8 * int(k))
    return k.encode() + zlib.compress(counts.astype(f"u{k}").tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"u{blob[:1].decode()}")


class Sketch:
    """Counts of incidences by hash bucket: a bounded summary of all data.

    It only fixes the *order* in which incidences are considered (rare ones
    first) and into how many pieces the work on a run is split; every result
    is exact for any order and any number of pieces.
    """

    def __init__(self, bits: int = SKETCH_BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.counts = np.zeros(1 << bits, np.int32)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, g: np.ndarray) -> None:
        self.held.append(g)
        self.n += len(g)
        if self.n > 1 << 22:
            self.fold()

    def fold(self) -> None:
        if self.held:
            g = (np.concatenate(self.held) & self.mask).astype(np.int64)
            self.counts += np.bincount(g, minlength=len(self.counts)).astype(np.int32)
            self.held, self.n = [], 0

    def rows(self) -> list[tuple[int, int, bytes]]:
        """(part, slot, counts); tasks of the same slot are added first."""
        self.fold()
        context = TaskContext.get()
        slot = context.partitionId() % SKETCH_SLOTS if context else 0
        return [(i, slot, _packed(p)) for i, p in enumerate(np.split(self.counts, SKETCH_PARTS))]


def _added(df: DataFrame, *keys: str, last: bool = False) -> DataFrame:
    """Sums of the sketch rows of each key.  Rows are added as they come, so a
    task holds one part, however many tasks sent one."""

    def close(key, total):
        if last:  # one byte a counter, which grows with the logarithm
            total = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8).tobytes()
        else:
            total = _packed(total)
        return pd.DataFrame([(*key, total)], columns=[*keys, "counts"])

    def add(it):
        at, total = None, None
        for pdf in it:
            for *key, blob in zip(*(pdf[k] for k in keys), pdf["counts"]):
                if key != at:
                    if at is not None:
                        yield close(at, total)
                    at, total = key, np.zeros(1, np.int64)
                total = total + _unpacked(blob).astype(np.int64)
        if at is not None:
            yield close(at, total)

    return df.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, ", ".join(f"{k} int" for k in keys) + ", counts binary")


def merged_sketch(df: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Sum sketch rows (``part``, ``slot``, ``counts``) in two steps to one
    byte a counter: 4 to 64 MB on the driver."""
    width = (1 << bits) // SKETCH_PARTS
    out = np.zeros(1 << bits, np.uint8)
    for r in _added(_added(df, "part", "slot"), "part", last=True).collect():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.uint8)
    return out


def levels(g: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(g & np.uint64(len(counts) - 1)).astype(np.int64)]


def rare_first(g: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of ``g`` in the global order: rare incidences first."""
    return np.lexsort((g, levels(g, counts)))


def slices_of(g: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Into how many pieces the documents of each run are split."""
    level = levels(g, counts)
    n = np.ones(len(g), np.int64)
    hot = level >= 8 * np.log2(1.0 + HOT)
    n[hot] = np.ceil(2.0 ** (level[hot] / 8) / HOT)
    return n


def _piece(g: np.ndarray, a, b) -> np.ndarray:
    """The run of a hot run's piece (a, b)."""
    return mix(g ^ mix(np.uint64(a) * _B + np.uint64(b) + np.uint64(1)))


def split_square(g: np.ndarray, slices: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Incidences of a product of a matrix with itself, hot runs split.

    The documents of a hot run fall into slices; each pair of slices is a run
    of its own, in which only documents of different sides meet.  Returns the
    runs and their sides: 0 all meet, 1 and 2 only each other.
    """
    hot = np.flatnonzero(slices > 1)
    if not len(hot):
        return g, None
    out, side = [g[slices == 1]], [np.zeros(int((slices == 1).sum()), np.uint8)]
    for k in hot:
        s = int(slices[k])
        own = (doc & 0x7FFFFFFFFFFFFFFF) % s
        other = np.arange(s, dtype=np.uint64)
        out.append(_piece(g[k], np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))))
        side.append(np.where(other == own, 0, np.where(other > own, 1, 2)).astype(np.uint8))
    return np.concatenate(out), np.concatenate(side)


def split_cross(g: np.ndarray, w: np.ndarray, slices: np.ndarray, doc: int, all_of: bool) -> tuple[np.ndarray, np.ndarray]:
    """Incidences of a product of two matrices: rows of the one side
    (``all_of`` false) stand in one slice of a hot run, of the other in all."""
    hot = np.flatnonzero(slices > 1)
    if not len(hot):
        return g, w
    out, weight = [g[slices == 1]], [w[slices == 1]]
    for k in hot:
        s = int(slices[k])
        at = np.arange(s, dtype=np.uint64) if all_of else np.array([(doc & 0x7FFFFFFFFFFFFFFF) % s], np.uint64)
        out.append(_piece(g[k], at, np.uint64(0)))
        weight.append(np.full(len(at), w[k]))
    return np.concatenate(out), np.concatenate(weight)


# ------------------------------------------------------------ blocked product


class Blocks:
    """Packs incidences (gram, document, weight) by gram block."""

    def __init__(self, n_blocks: int) -> None:
        self.n_blocks = np.uint64(n_blocks)
        self.reset()

    def reset(self) -> None:
        self.grams: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.sizes: list[int] = []
        self.weights: list[np.ndarray] = []
        self.sides: list[np.ndarray] = []
        self.pending = 0

    def add(self, doc: tuple[int, int], n: int, kind: int, grams: np.ndarray, weights: np.ndarray | None = None, sides: np.ndarray | None = None) -> None:
        """``doc`` is (hi, lo), ``n`` its size, ``kind`` its matrix."""
        self.grams.append(grams)
        self.docs.append((*doc, n, kind))
        self.sizes.append(len(grams))
        self.weights.append(np.ones(len(grams), np.uint32) if weights is None else weights.astype(np.uint32))
        self.sides.append(np.zeros(len(grams), np.uint8) if sides is None else sides)
        self.pending += len(grams)

    def flush(self) -> pd.DataFrame:
        """Rows (block, blob).  A blob holds a document table and its
        incidences sorted by gram.  The upper half of a gram picks the block,
        the lower half is kept beside it; what a collision brings in is
        checked later."""
        if not self.pending:
            self.reset()
            return pd.DataFrame({"block": pd.Series([], dtype="int32"), "blob": pd.Series([], dtype="object")})
        g, w, side = np.concatenate(self.grams), np.concatenate(self.weights), np.concatenate(self.sides)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.uint32), self.sizes)
        block = ((g >> np.uint64(32)) * self.n_blocks) >> np.uint64(32)
        key = block << np.uint64(32) | g & np.uint64(0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        key, w, side, doc = key[order], w[order], side[order], doc[order]
        block, short = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
        his, los = np.array([d[0] for d in self.docs], np.int32), np.array([d[1] for d in self.docs], np.int64)
        ns, kinds = np.array([d[2] for d in self.docs], np.uint32), np.array([d[3] for d in self.docs], np.uint8)
        at = np.flatnonzero(np.diff(block)) + 1
        out_block, out_blob = [], []
        for lo, hi in zip(np.r_[0, at], np.r_[at, len(key)]):
            used, local = np.unique(doc[lo:hi], return_inverse=True)
            wide, weighted, sided = len(used) > 65535, bool((w[lo:hi] != 1).any()), bool(side[lo:hi].any())
            head = np.array([len(used), hi - lo, wide, weighted, sided], np.uint32).tobytes()
            body = los[used].tobytes() + his[used].tobytes() + ns[used].tobytes() + kinds[used].tobytes() + short[lo:hi].tobytes()
            body += local.astype(np.uint32 if wide else np.uint16).tobytes()
            body += (w[lo:hi].tobytes() if weighted else b"") + (side[lo:hi].tobytes() if sided else b"")
            out_block.append(int(block[lo]))
            out_blob.append(head + body)
        self.reset()
        return pd.DataFrame({"block": np.array(out_block, np.int32), "blob": out_blob})


class Incidences:
    """All blobs of a block put together, sorted by gram and document.

    A document that several map tasks sent (equal texts) is taken from the
    first blob that has it.
    """

    def __init__(self, blobs) -> None:
        gs, ds, ws, ss, los, his, ns, kinds = [], [], [], [], [], [], [], []
        base = 0
        for b in blobs:
            nd, ne, wide, weighted, sided = map(int, np.frombuffer(b, np.uint32, 5))
            p = 20
            for out, kind in ((los, np.int64), (his, np.int32), (ns, np.uint32), (kinds, np.uint8)):
                out.append(np.frombuffer(b, kind, nd, p))
                p += out[-1].nbytes
            gs.append(np.frombuffer(b, np.uint32, ne, p))
            p += 4 * ne
            ds.append(np.frombuffer(b, np.uint32 if wide else np.uint16, ne, p).astype(np.int64) + base)
            p += (4 if wide else 2) * ne
            ws.append(np.frombuffer(b, np.uint32, ne, p).astype(np.int64) if weighted else np.ones(ne, np.int64))
            p += 4 * ne if weighted else 0
            ss.append(np.frombuffer(b, np.uint8, ne, p) if sided else np.zeros(ne, np.uint8))
            base += nd
        lo, hi, kind = np.concatenate(los), np.concatenate(his), np.concatenate(kinds)
        order = np.lexsort((kind, hi, lo))
        a, b = order[1:], order[:-1]
        first = np.r_[True, (lo[a] != lo[b]) | (hi[a] != hi[b]) | (kind[a] != kind[b])]
        number = np.empty(len(lo), np.int64)
        number[order] = np.cumsum(first) - 1
        kept = np.zeros(len(lo), bool)
        kept[order[first]] = True
        at = order[first]
        self.lo, self.hi, self.kind, self.n = lo[at], hi[at], kind[at], np.concatenate(ns)[at].astype(np.int64)
        d = np.concatenate(ds)
        use = kept[d]
        g, d = np.concatenate(gs)[use], number[d[use]]
        order = np.argsort(g.astype(np.uint64) << np.uint64(32) | d.astype(np.uint64))
        self.g, self.d = g[order], d[order]
        self.w, self.side = np.concatenate(ws)[use][order], np.concatenate(ss)[use][order]


def n_blocks(incidences: int, per_block: int | None = None) -> int:
    return int(max(8, -(-incidences // (per_block or PER_BLOCK))))


def incidence_blocks(df: DataFrame, fill, blocks: int) -> DataFrame:
    """``fill(pdf, Blocks)`` packs a batch; rows (block, blob) come out."""

    def pack(it):
        b = Blocks(blocks)
        state: dict = {}
        for pdf in it:
            fill(pdf, b, state)
            if b.pending > FLUSH:
                yield b.flush()
        yield b.flush()

    return df.mapInPandas(pack, "block int, blob binary")


PAIR = ("a_hi", "a_lo", "b_hi", "b_lo")


def product(packed: DataFrame, multiply, blocks: int) -> DataFrame:
    """Apply ``multiply(Incidences)`` to each block, add up the overlaps ``o``
    of the same pair, and keep pairs with ``least`` of them.  A block's pairs
    come as frames of bounded size, however many there are.
    """

    def run(it):
        block, held = None, []
        for pdf in it:
            for b, blob in zip(pdf["block"], pdf["blob"]):
                if b != block and held:
                    yield from multiply(Incidences(held))
                    held = []
                block = b
                held.append(blob)
        if held:
            yield from multiply(Incidences(held))

    # a block is a task: blocks are not hashed, which would put some together
    by_block = packed.repartitionById(blocks, F.col("block")).sortWithinPartitions("block")
    part = by_block.mapInPandas(run, "a_hi int, a_lo bigint, b_hi int, b_lo bigint, o bigint, least int")
    # within a block pairs are summed up already, so there is little to combine
    # before the shuffle, and its tasks follow the number of blocks
    summed = part.repartition(blocks, *PAIR).groupBy(*PAIR).agg(F.sum("o").alias("o"), F.min("least").alias("least"))
    return summed.where("o >= least").select(*PAIR)


PAIRS = 2_000_000


class PairCounts:
    """Overlaps of pairs of numbered documents, handed on when many."""

    def __init__(self, inc: Incidences, least, ordered: bool) -> None:
        """``least(a, b)`` is the overlap that a pair must reach in all."""
        self.inc, self.least, self.ordered = inc, least, ordered
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, o: np.ndarray | None = None):
        """Count ``o`` (or one) for each pair; yields a frame when full."""
        self.keys.append(a * len(self.inc.lo) + b)
        self.counts.append(np.ones(len(a), np.int64) if o is None else o)
        self.n += len(a)
        if self.n > PAIRS:
            yield self.frame()

    def frame(self) -> pd.DataFrame:
        x = self.inc
        if not self.n:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in (*PAIR, "o", "least")})
        key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        o = np.bincount(at, np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.n = [], [], 0
        a, b = key // len(x.lo), key % len(x.lo)
        if not self.ordered:
            swap = (x.lo[a] > x.lo[b]) | (x.lo[a] == x.lo[b]) & (x.hi[a] > x.hi[b])
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"a_hi": x.hi[a], "a_lo": x.lo[a], "b_hi": x.hi[b], "b_lo": x.lo[b], "o": o, "least": self.least(a, b)})


# --------------------------------------------------------------- exact counts


def compared(values: DataFrame, members: DataFrame, found: DataFrame, pack, judge, schema: str, tasks: int, sides: tuple[int, int] | None = None) -> DataFrame:
    """``judge(own, other)`` on whole texts for each pair of ``found``.

    ``values(id, s, v)`` are the texts, ``members(id, s, hi, lo)`` their
    classes; ``sides`` are those of the first and the second of a pair, where
    a class may stand on both.  Of each
    class one record is read again and packed by ``pack(v, s)`` (the class and
    binary sets); sets meet where pairs of the first class are gathered, at
    most about ``FAN`` of them in one piece, one partner after the other.
    """
    partners = found.groupBy("a_hi", "a_lo").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("pieces"))
    piece = F.pmod(F.xxhash64("b_hi", "b_lo"), F.col("pieces")).cast("int")
    routed = found.join(partners, ["a_hi", "a_lo"]).select(*PAIR, piece.alias("piece"))
    to = F.struct(F.col("a_hi").alias("at_hi"), F.col("a_lo").alias("at_lo"), "piece", F.col("end")).alias("to")
    own = routed.select("a_hi", "a_lo", "piece").distinct().withColumn("end", F.lit(0)).select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), to)
    other = routed.withColumn("end", F.lit(1)).select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"), to)
    keys = ["hi", "lo"]
    if sides:
        own, other, keys = own.withColumn("s", F.lit(sides[0])), other.withColumn("s", F.lit(sides[1])), ["hi", "lo", "s"]
    routes = own.unionByName(other).groupBy(*keys, F.pmod(F.xxhash64("to"), F.lit(ROUTE_SLICES)).alias("slice")).agg(F.collect_list("to").alias("to"))
    reps = members.groupBy("hi", "lo", "s").agg(F.min("id").alias("id"))
    texts = values.repartition(tasks, "id", "s").join(reps.join(routes, keys).select("id", "s", "hi", "lo", "to"), ["id", "s"])
    sent_type = "at_hi int, at_lo bigint, piece int, end int, s int, hi int, lo bigint, x binary, y binary, z binary"
    names = [c.split()[0] for c in sent_type.split(", ")]

    def send(it):
        cache = _Hashes()
        for pdf in it:
            out = []
            for s, hi, lo, to, h in zip(pdf["s"], pdf["hi"], pdf["lo"], pdf["to"], word_hashes(pdf["v"], cache)):
                own, sets = pack(h, s)
                if own == (hi, lo):  # a record id may come with several texts
                    out.extend((t["at_hi"], t["at_lo"], t["piece"], t["end"], s, hi, lo, *sets) for t in to)
            yield pd.DataFrame(out, columns=names)

    def meet(it):
        at, own = None, None
        for pdf in it:
            out = []
            for at_hi, at_lo, p, end, s, hi, lo, *sets in zip(*(pdf[c] for c in names)):
                if (at_hi, at_lo, p) != at:
                    at, own = (at_hi, at_lo, p), None
                if end == 0:
                    own = sets
                elif own is not None:
                    got = judge(own, sets)
                    if got is not None:
                        out.append((s, at_hi, at_lo, hi, lo, *got))
            yield pd.DataFrame(out, columns=["s", *PAIR, *[c.split()[0] for c in schema.split(", ")]])

    sent = texts.select("s", "hi", "lo", "to", "v").mapInPandas(send, sent_type)
    by = sent.repartition(tasks, "at_hi", "at_lo", "piece").sortWithinPartitions("at_hi", "at_lo", "piece", "end")
    return by.mapInPandas(meet, "s int, a_hi int, a_lo bigint, b_hi int, b_lo bigint, " + schema)


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of ``y`` stand in ``x``; both sorted, ``x`` not empty."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
