"""Text cut off by field limits or broken transfers (problem 10).

Method: a hashed logistic regression on how a text ends.  Positives are made
by cutting intact texts (anywhere, or at a length that is a spike of their
source; some get a trailing line or an ellipsis appended), negatives are texts
as they are and texts that only lost their full stop.  A first fit takes the
texts it holds for cut out of the negatives, a second fit is used.

Features: classes of the closing characters, the closing words, what the line
before a short last line ends with, open brackets, quotes and code fences,
how often the last line occurs in the corpus, and how far the length stands
out among the lengths of the source.  The two corpus statistics cover all
documents.  The classifier is fitted on about ``SAMPLE`` different texts
(those with the least hashes), every document is scored.

Defined results: null, empty and blank texts are no cases and have no score;
repeated rows are scored each; a null source is a source of its own.  An
empty table gives an empty result, too few texts to fit give no cases.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.source_syntax import judge
from triagelake.session import hot_keys, join_unique, staged

BITS = 16
SAMPLE = 12_000
THRESHOLD = 0.5
DOUBT = 0.2
SPIKE = 8.0
MIN_DOCUMENTS = 4
RESERVED = 256  # slots of the corpus statistics, at the end of the table

# fixed values: marks that are put behind a cut
MARKS = ("...", " ...", " [...]", "[…]", " (cut)", " [cut]", " (truncated)", " [truncated]", " (more)", " [more]")

_STOP = ".?!。？！"
_CLOSE = ")]}\"'”’»`"


def _class(ch: str) -> str:
    if ch in _STOP:
        return "."
    if ch in _CLOSE:
        return ")"
    if ch.isdigit():
        return "0"
    if ch == "…":
        return "~"
    if ch == "�":
        return "R"
    if ch in ",;:，；：、-–—/\\=+([{<“„«_&|":
        return ","
    if ch.isspace():
        return " "
    if ord(ch) >= 0x2E80 and ch.isalpha():
        return "C"
    if ch.isalpha():
        return "A" if ch.isupper() else "a"
    return "x"


def tail_line(text: str) -> str:
    """The last line with its numbers made equal, at most its last 60 characters."""
    return re.sub(r"\d+", "9", text.rstrip().rsplit("\n", 1)[-1])[-60:]


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|"', re.S)
_WORD = re.compile(r"\w+|[^\w\s]")


def _open_json(text: str, at: int) -> str:
    depth = 0
    for m in _JSON.finditer(text, at):
        x = m.group()
        if x in "{[":
            depth += 1
        elif x in "}]":
            depth -= 1
        elif x == '"':
            return "string"
    return "open" if depth > 0 else "closed"


def _balance(text: str) -> tuple[str, str]:
    """Kind of text, and whether something in it is left open."""
    s = text.lstrip("﻿ \t\r\n")
    if s[:1] in ("(", ";") and "(" in s:
        return "lisp", judge("lsp", s)[0]
    at = s.find('{"')
    if at < 0 and s[:1] == "{":
        at = 0
    fences = s.count("```")
    if at >= 0:
        return "json", _open_json(s, at) + ("+" if fences % 2 else "")
    return ("fence" if fences else "prose"), "open" if fences % 2 else "closed"


def features(text: str) -> list[str]:
    s = text.rstrip()
    lines = s.rsplit("\n", 1)
    last = lines[-1]
    kind, left = _balance(text)
    bare = s.rstrip("." + _STOP + "… ") or s
    shape = "".join(map(_class, s[-3:]))
    words = [re.sub(r"\d+", "0", w.lower()) for w in _WORD.findall(bare[-120:])][-3:]
    dots = "..." if s.endswith("...") else "…" if s.endswith("…") else ""
    before = lines[0].rstrip() if len(lines) > 1 else ""
    ended = _class(before[-1]) if before else "^"
    short = min(len(last) // 10, 6)
    out = [
        "b", f"c1{shape[-1:]}", f"c3{shape}", f"ch{s[-1]}", f"k{kind}{left}", f"kc{kind}{left}{shape[-1:]}", f"nl{text != s}",
        f"d{dots}", f"dk{dots}{kind}{left}", f"p{ended}", f"ps{ended}{short}{shape[-1:]}", f"pk{ended}{kind}", f"s{short}{kind}",
        f"q{last.count('(') > last.count(')')}{last.count(chr(34)) % 2}{shape[-1:]}",
    ]
    if words:
        out += [f"w{words[-1]}", f"ww{' '.join(words[-2:])}", f"www{' '.join(words)}", f"wd{words[-1]}{shape[-1:]}", f"wl{min(len(words[-1]), 8)}{shape[-1:]}"]
    if dots:
        inner = bare[-1:]
        out.append(f"di{_class(inner) if inner else '^'}{short}")
    if before:
        tail = [re.sub(r"\d+", "0", w.lower()) for w in _WORD.findall(before[-60:])][-2:]
        out += [f"pw{' '.join(tail[-1:])}{ended}", f"l{re.sub(r'[0-9]+', '9', last)[:40]}"]
    return out


def slots(names: list[str]) -> list[int]:
    size = (1 << BITS) - RESERVED
    return sorted({xxhash.xxh3_64_intdigest(x) % size for x in names})


def _statistics_slots(n_tail, ended, spike) -> list[int]:
    """Slots of the corpus statistics: tail frequency and length spike."""
    base = (1 << BITS) - RESERVED
    t = min(int(np.log2(max(n_tail, 1))), 15)
    z = min(int(np.log2(max(spike, 1.0)) * 2), 31)
    return [base + t, base + 16 + t * 2 + int(ended), base + 64 + z, base + 96 + z * 2 + int(ended)]


def variants(doc_id: int, text: str, limits: list[int], tails: list[str]):
    """(label, text, length) examples made of one text, fixed by its id.

    Texts as long as a limit are left out, they may be cut.  A text beyond a
    limit is rarely found, so the length of a limit is given to part of the
    texts cut anywhere, and to a few intact ones.
    """
    rng = np.random.default_rng(doc_id & 0x7FFFFFFF)
    s = text.rstrip()

    def length(n: int, share: float) -> int:
        return limits[int(rng.integers(len(limits)))] if limits and rng.random() < share else n

    if len(text) not in limits:
        yield 0, text, length(len(text), 0.04)
        if s and s[-1] in ".。" and not s.endswith("..") and rng.random() < 0.12:
            yield 0, s[:-1], len(s) - 1
    for k in range(2):
        if len(s) > 24:
            at = int(rng.integers(12, len(s) - 4))
            if rng.random() < 0.35:
                at = s.rfind(" ", 8, at) + 1 or at
        else:
            continue
        cut = s[:at]
        if not cut.strip():
            continue
        end = cut.rstrip()[-1]
        kind, left = _balance(cut)
        if end in _STOP and left in ("closed", "ok"):
            continue
        r = rng.random()
        if k == 1 and r < 0.12:
            cut = cut.rstrip() + "…"
        elif k == 1 and r < 0.2:
            cut = cut.rstrip() + MARKS[int(rng.integers(len(MARKS)))]
        elif k == 1 and r < 0.4 and tails:
            cut = cut.rstrip() + "\n" + tails[int(rng.integers(len(tails)))]
        elif r > 0.95:
            cut = cut[:-1] + "�"
        yield 1, cut, length(len(cut), 0.5 if k == 0 else 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 200, l2: float = 1.5e-5) -> np.ndarray:
    """Logistic regression over sparse binary rows, full-batch Adam."""
    idx = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.zeros(1 << BITS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.bincount(row, w[idx], len(rows))))
        g = np.bincount(idx, ((p - y) * weight / total)[row], len(w)) + l2 * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _score(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    if not len(rows):
        return np.empty(0)
    idx = np.concatenate(rows)
    z = np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), w[idx], len(rows))
    return 1 / (1 + np.exp(-z))


def _fitted(x: list[np.ndarray], y: np.ndarray, ids: np.ndarray, folds: int = 3) -> np.ndarray:
    """Weights of the slots that several documents share.

    Among the negatives are texts that are cut.  Each is judged by a model
    that has not seen it, twice, and those held for cut are left out of the
    last fit.
    """
    if len(set(y)) < 2:
        return np.full(1 << BITS, -1.0)
    pairs = np.unique(np.concatenate(x) * (1 << 40) + np.repeat(np.unique(ids, return_inverse=True)[1], [len(r) for r in x]))
    often = np.bincount(pairs >> 40, minlength=1 << BITS) >= MIN_DOCUMENTS
    x = [r[often[r]] for r in x]
    fold = np.array([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) % folds for i in ids])
    keep = np.ones(len(y), bool)
    # first leave out all that may be cut, then judge again from what is left
    for bound in (DOUBT, THRESHOLD):
        judged = np.zeros(len(y))
        for k in range(folds):
            rest, own = np.flatnonzero((fold != k) & keep), np.flatnonzero((fold == k) & (y == 0))
            if len(own) and len(set(y[rest])) == 2:
                judged[own] = _score([x[i] for i in own], fit([x[i] for i in rest], y[rest], np.ones(len(rest)), steps=120))
        keep = (y == 1) | (judged < bound)
    kept = np.flatnonzero(keep)
    return fit([x[i] for i in kept], y[kept], np.ones(len(kept)))


_READ = "id bigint, source string, len int, whole bigint, tail bigint, ended boolean, slots array<int>, label int"


def _reader(tails: list[str] | None = None):
    """Documents to feature rows; with ``tails``, examples of documents whose
    source has the lengths ``limits``."""

    def read(it):
        for pdf in it:
            out = []
            given = [None] * len(pdf) if tails is None else pdf["limits"]
            for i, source, text, limits in zip(pdf["id"], pdf["source"], pdf["text"], given):
                each = [(None, text, len(text))] if tails is None else variants(i, text, [] if limits is None else [int(x) for x in limits], tails)
                for label, t, n in each:
                    s = t.rstrip()
                    if not s:
                        continue
                    tail = xxhash.xxh3_64_intdigest(tail_line(t)) - (1 << 63)
                    whole = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                    out.append((i, source, n, whole, tail, s[-1] in _STOP, slots(features(t)), label))
            frame = pd.DataFrame(out, columns=["id", "source", "len", "whole", "tail", "ended", "slots", "label"])
            frame["label"] = frame["label"].astype("Int32")
            yield frame

    return read


def _length_key() -> Column:
    return F.concat_ws(":", F.col("len").cast("string"), "source").alias("length_key")


def _with_statistics(rows: DataFrame, tails: DataFrame, lengths: DataFrame, hot: list, hot_lengths: list) -> DataFrame:
    """A common last line, and a length limit of a large source, are hot keys."""
    joined = join_unique(rows, tails, "tail", "left", hot).withColumn("length_key", _length_key())
    return join_unique(joined, lengths, "length_key", "left", hot_lengths).fillna({"n_tail": 1, "spike": 1.0})


def scores(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, source, score)`` of every document with a text."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    docs = docs.where(F.col("text").rlike(r"\S"))
    read = staged(docs.mapInPandas(_reader(), _READ))

    # copies of a text bring their last line along, so texts are counted once
    counts = staged(read.groupBy("tail", "whole").count().groupBy("tail").agg(F.count(F.lit(1)).alias("n_tail")))
    by_length = read.groupBy("source", "len").agg(F.count(F.lit(1)).alias("n"))
    # a length stands out against the mean count of the lengths around it
    around = by_length.groupBy("source", F.floor(F.col("len") / 64).alias("band")).agg(F.sum("n").alias("band_n"), F.max("n").alias("band_max"))
    near = by_length.withColumn("band", F.floor(F.col("len") / 64)).join(around, ["source", "band"])
    spike = F.col("n") / F.greatest((F.col("band_n") - F.col("n")) / 63, F.lit(0.5))
    lengths = staged(near.select("source", "len", "n", spike.alias("spike")))

    # of each source the lengths at which very many texts end
    out = lengths.where((F.col("spike") >= SPIKE) & (F.col("n") >= 5))
    limits = out.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "len")), False), lambda x: x["len"]).alias("limits"))
    # different texts below a hash threshold: about ``sample`` of them
    share = min(1.0, sample / max(read.count(), 1))
    h = F.xxhash64("text")
    chosen = docs.select(h.alias("id"), "source", "text").where(F.shiftrightunsigned(h, 11) < int(share * 2**53)).dropDuplicates(["id"])
    common = _common_tails(chosen)

    examples = staged(chosen.join(limits, "source", "left").mapInPandas(_reader(common), _READ))
    hot, hot_lengths = hot_keys(read, "tail"), hot_keys(read, _length_key())
    spikes = lengths.select(_length_key(), "spike")
    rows = _with_statistics(examples, counts, spikes, hot, hot_lengths).select("id", "slots", "ended", "n_tail", "spike", "label").toPandas()
    x = [np.array(sorted({*s, *_statistics_slots(n, e, z)}), np.int64) for s, e, n, z in zip(rows["slots"], rows["ended"], rows["n_tail"], rows["spike"])]
    w = _fitted(x, rows["label"].to_numpy(dtype=np.float64), rows["id"].to_numpy())
    model = spark.sparkContext.broadcast(w.astype(np.float32))

    def rate(it):
        for pdf in it:
            x = [np.array(sorted({*s, *_statistics_slots(n, e, z)}), np.int64) for s, e, n, z in zip(pdf["slots"], pdf["ended"], pdf["n_tail"], pdf["spike"])]
            yield pd.DataFrame({"doc_id": pdf["id"], "source": pdf["source"], "score": _score(x, model.value.astype(np.float64))})

    full = _with_statistics(read, counts, spikes, hot, hot_lengths).select("id", "source", "slots", "ended", "n_tail", "spike")
    return full.mapInPandas(rate, "doc_id bigint, source string, score double")


def _common_tails(docs: DataFrame, least: int = 3, most: int = 300) -> list[str]:
    """Short last lines that the sample repeats, to append to cut texts."""
    line = F.regexp_replace(F.regexp_extract("text", r"\n([^\n]{3,40})\s*$", 1), r"\d+", "7")
    rows = docs.select(line.alias("l")).where("l <> ''").groupBy("l").count().where(F.col("count") >= least)
    return sorted(r.l for r in rows.orderBy(F.desc("count"), "l").limit(most).collect() if not r.l.startswith((" ", "(", ")", "}", "- ")) and r.l[-1] not in _STOP)


def found(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores(documents).where(F.col("score") >= threshold).select("doc_id").distinct()


def rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Truncated documents per source (null sources as ``(none)``)."""
    hit = F.col("score") >= threshold
    return scores(documents).groupBy(F.when(F.col("source") == "", "(none)").otherwise(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(hit).alias("truncated"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("rate")
    )
