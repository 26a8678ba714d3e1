"""Encoding of texts with a public tokenizer (problem 8).

Method: tree concatenation.  A text is cut where its pre-tokens end; only a
pre-token too long to be one unit of work (long unsplit text) is halved again
and again, its leaves are encoded in parallel, and neighbours are joined by
re-encoding a window around the join.  The window grows until its first token
is the left side's token at that place and its last one the right side's.
Every adjacent pair of the joined sequence is then a pair of some valid
encoding, which makes the whole the encoding of the whole pre-token.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; repeated rows are encoded each.  Extra
columns may be carried along.  An empty table gives an empty result.

The vocabulary file is a parameter and is read once per Python worker.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.session import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published pre-tokenisation pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 4_096
PIECE = 16_384
SLICE = 512  # texts encoded at once

TEXT, SINGLE, GLUED = 0, 1, 2

# white space as Unicode defines it, which the vocabulary's own matcher uses
_SPACE = "\t-\r \x85\xa0  -     　"
_pre = regex.compile(PATTERN.replace(r"[^\s\p{L}", rf"[^{_SPACE}\p{{L}}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
_is_space = re.compile(f"[{_SPACE}]").match


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _solid(leaf: int) -> re.Pattern:
    return re.compile(r"\S{%d}|\s{%d}" % (leaf, leaf))


def cut(text: str, leaf: int = LEAF, piece: int = PIECE) -> list[tuple[int, str]]:
    """(kind, part) of a text; the parts in order give the text again.

    TEXT parts end with a pre-token that is no white space, so what follows
    has no say in how they are split.  SINGLE parts are one pre-token, GLUED
    ones continue the pre-token of the part before.
    """
    if len(text) <= leaf or (len(text) <= piece and not _solid(leaf).search(text)):
        return [(TEXT, text)]
    out: list[tuple[int, str]] = []
    start = safe = 0
    tail: list[tuple[int, int]] = []

    def close() -> None:
        if safe > start:
            out.append((TEXT, text[start:safe]))
        out.extend((SINGLE, text[a:b]) for a, b in tail)

    for m in _pre.finditer(text):
        a, b = m.span()
        if b - a > leaf:
            close()
            tail = []
            size = b - a
            while size > leaf:
                size = -(-size // 2)
            out.extend((GLUED if k > a else SINGLE, text[k : min(k + size, b)]) for k in range(a, b, size))
            start = safe = b
        elif _is_space(text, b - 1):
            tail.append((a, b))
        else:
            safe, tail = b, []
            if safe - start >= piece:
                out.append((TEXT, text[start:safe]))
                start = safe
    close()
    return out


def encode_part(enc: tiktoken.Encoding, kind: int, part: str) -> list[int]:
    return enc.encode_ordinary(part) if kind == TEXT else enc._encode_single_piece(part)


def join_ids(enc: tiktoken.Encoding, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """The encoding of a pre-token from the encodings of its two sides."""
    while True:
        i, j = max(0, len(left) - window), min(len(right), window)
        ids = enc._encode_single_piece(b"".join(enc.decode_tokens_bytes(left[i:] + right[:j])))
        if (i == 0 or ids[0] == left[i]) and (j == len(right) or ids[-1] == right[j - 1]):
            return left[:i] + ids + right[j:]
        window *= 2


def join_tree(enc: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    """Join the leaves of one pre-token, neighbours first."""
    while len(parts) > 1:
        parts = [join_ids(enc, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _slices(batches, size: int = SLICE):
    """Batches of at most so many rows, which bounds what is held at once."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _id_arrays(lists: list[list[int]]) -> pa.Array:
    offsets = [0]
    for x in lists:
        offsets.append(offsets[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([i for x in lists for i in x], pa.int32()))


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "ids", path: str = VOCABULARY, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """Rows of ``df`` (columns ``keep``) with the token ids of ``text``."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (text, out)]
    kept = T.StructType([df.schema[c] for c in keep])
    # the work of a row follows its length, so rows are packed by columns only
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    pieces_type = T.StructType(kept.fields + [T.StructField("_row", T.LongType()), T.StructField("_parts", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType())])))])

    def split_long(batches):
        base, n = TaskContext.get().partitionId() << 40, 0
        for b in _slices(batches, 16):
            parts = []
            for t in b.column("_text").to_pylist():
                parts.append([{"k": k, "t": p} for k, p in cut(t or "", leaf, piece)])
            rows = pa.array(range(base + n, base + n + b.num_rows), pa.int64())
            n += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [rows, pa.array(parts, pa.list_(pa.struct([("k", pa.int32()), ("t", pa.string())])))], names=keep + ["_row", "_parts"]
            )

    def short_ids(batches):
        enc = encoding(path)
        for b in _slices(batches):
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [_id_arrays(ids)], names=keep + [out])

    ids_field = T.StructField(out, T.ArrayType(T.IntegerType()))
    one_unit = F.coalesce(F.length("_text") <= leaf, F.lit(True))
    short = source.where(one_unit).mapInArrow(short_ids, T.StructType(kept.fields + [ids_field]))

    # the few long texts are cut once; both uses of the parts read them
    cut_rows = staged(source.where(~one_unit).mapInArrow(split_long, pieces_type))
    leaves = cut_rows.select(
        *[F.col(f"`{c}`") for c in keep], "_row", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_seq", "_p")
    ).select(*[F.col(f"`{c}`") for c in keep], "_row", "_n", "_seq", "_p.k", "_p.t")

    leaf_type = T.StructType(kept.fields + [T.StructField(c, T.LongType()) for c in ("_row", "_n", "_seq")] + [T.StructField("_k", T.IntegerType()), ids_field])

    def leaf_ids(batches):
        enc = encoding(path)
        for b in _slices(batches):
            ids = [encode_part(enc, k, t) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [b.column(c).cast(pa.int64()) for c in ("_row", "_n", "_seq")] + [b.column("k"), _id_arrays(ids)],
                names=keep + ["_row", "_n", "_seq", "_k", out],
            )

    whole = leaves.where("_n = 1").mapInArrow(leaf_ids, leaf_type).select(*[F.col(f"`{c}`") for c in keep], out)
    # parts of long texts are spread over all tasks whatever row they are of
    spread = leaves.where("_n > 1").repartition(F.xxhash64("_row", "_seq")).mapInArrow(leaf_ids, leaf_type)

    def assemble(rows):
        enc = encoding(path)
        joined, run = [], []
        for k, ids in zip(rows.column("_k").to_pylist(), rows.column(out).to_pylist()):
            if k != GLUED and run:
                joined.extend(join_tree(enc, run))
                run = []
            run.append(ids)
        if run:
            joined.extend(join_tree(enc, run))
        return joined

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("_seq")
        first = group.slice(0, 1)
        return pa.Table.from_arrays([first.column(c) for c in keep] + [_id_arrays([assemble(group)])], names=keep + [out])

    long = spread.groupBy("_row").applyInArrow(gather, T.StructType(kept.fields + [ids_field]))
    return short.unionByName(whole).unionByName(long)
