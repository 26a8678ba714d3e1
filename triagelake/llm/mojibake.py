"""Garbled text from wrong character encoding (problem 7).

Method: map characters back to legacy bytes, run a byte-structure automaton
over them to find maximal well-formed multibyte spans, and decode those spans
only.  This is done for the distinct words of the corpus, once each.

Two kinds of evidence make a word garbled.

* Structure: a replacement character or a C1 control; lead characters with a
  question mark for the byte after them, twice or more in a word; or spans of
  UTF-8 among the legacy bytes that decode to plausible characters and leave no letter of
  the surrounding run over.  Spans are decoded again while that works, which
  undoes text garbled twice.
* Vocabulary: the bytes, read in another legacy encoding, give a word (or, for
  scripts written without spaces, characters) that the corpus uses far more
  often than the word as it stands.  Counts cover the whole corpus.

Defined results: null and pure ASCII values are no cases.  A value is restored
where each of its garbled words is; what was lost (replacement characters,
dropped bytes) stays as it is and the value is marked not restorable.  The
route says what gave the value away: ``spans`` (the automaton's, in any of its
words), else ``lost`` (bytes that are gone), else ``vocabulary``.
Repeated rows of the same key and value give one row; empty tables give none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.session import hot_keys, join_unique, staged

RATIO, LEAST = 4, 3
ROUTES = ("spans", "lost", "vocabulary")
WORDS_PER_TASK = 2_000


def _table(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined
    stand for the C1 control of the same number, as decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    if codec == "cp1252":
        out.update((chr(b), b) for b in range(128, 160))
    return out


# fixed values: the legacy encodings tried
SINGLE = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r")
DOUBLE = ("gbk", "cp932", "cp949", "big5")
_TABLES = {c: _table(c) for c in SINGLE}


def to_bytes(word: str, codec: str) -> bytes | None:
    """Legacy bytes of a word, None if a character has none."""
    table = _TABLES.get(codec)
    if table is None:
        try:
            return word.encode(codec)
        except UnicodeEncodeError:
            return None
    out = bytearray()
    for ch in word:
        o = ord(ch)
        if o >= 128:
            o = table.get(ch, -1)
            if o < 0:
                return None
        out.append(o)
    return bytes(out)


def plausible(ch: str) -> bool:
    o = ord(ch)
    return (
        0xA1 <= o <= 0x17F and o != 0xAD
        or 0x391 <= o <= 0x3C9
        or o in (0x192, 0x2C6, 0x2DC, 0x401, 0x451)
        or 0x410 <= o <= 0x44F
        or 0x2013 <= o <= 0x2044
        or o in (0x20AC, 0x2116, 0x2122, 0x2212, 0x221E, 0x2248, 0x2260, 0x2264, 0x2265)
        or 0x2190 <= o <= 0x2195
        or 0x2500 <= o <= 0x257F
        or 0x3000 <= o <= 0x30FF
        or 0x4E00 <= o <= 0x9FFF
        or 0xAC00 <= o <= 0xD7A3
        or 0xFF01 <= o <= 0xFF60
    )


def utf8_spans(b: bytes) -> list[tuple[int, int]]:
    """Maximal stretches of well-formed UTF-8 multibyte characters."""
    spans: list[tuple[int, int]] = []
    i, n = 0, len(b)
    while i < n:
        x = b[i]
        if x < 0xC2 or x > 0xF4:
            i += 1
            continue
        need = 1 if x < 0xE0 else 2 if x < 0xF0 else 3
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(x, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(x, 0xBF)
        tail = b[i + 1 : i + 1 + need]
        if len(tail) == need and low <= tail[0] <= high and all(0x80 <= y <= 0xBF for y in tail[1:]):
            if spans and spans[-1][1] == i:
                spans[-1] = (spans[-1][0], i + 1 + need)
            else:
                spans.append((i, i + 1 + need))
            i += 1 + need
        else:
            i += 1
    return spans


def _byte_runs(word: str, codec: str):
    """Maximal runs of non-ASCII characters the encoding has, with bytes and
    the character that each byte comes from."""
    table = _TABLES.get(codec)
    run: list[tuple[int, bytes]] = []
    for i, ch in enumerate(word + " "):
        if ord(ch) >= 128:
            b = None
            if table is not None:
                b = bytes([table[ch]]) if ch in table else None
            else:
                try:
                    b = ch.encode(codec)
                except UnicodeEncodeError:
                    b = None
            if b is not None:
                run.append((i, b))
                continue
        if run:
            yield run
            run = []


def decode_spans(word: str, codec: str) -> tuple[str, int, int]:
    """The word with its UTF-8 spans decoded, the number of characters
    decoded, and the number of letters left over in the runs that have spans."""
    out, last, decoded, rest = [], 0, 0, 0
    for run in _byte_runs(word, codec):
        b = b"".join(x for _, x in run)
        of = [i for i, x in run for _ in x]
        covered = set()
        good = []
        for lo, hi in utf8_spans(b):
            text = b[lo:hi].decode("utf-8")
            if all(map(plausible, text)) or (lo, hi) == (0, len(b)) and all(plausible(c) or c in "\xa0\xad" for c in text):
                if len(set(of[lo:hi])) and (lo == 0 or of[lo - 1] != of[lo]) and (hi == len(b) or of[hi] != of[hi - 1]):
                    good.append((of[lo], of[hi - 1] + 1, text))
                    covered.update(of[lo:hi])
        if good:
            rest += sum(word[i].isalpha() for i, _ in run if i not in covered)
        for a, z, text in good:
            out += [word[last:a], text]
            last = z
            decoded += len(text)
    return "".join(out) + word[last:], decoded, rest


def _structure(word: str) -> str | None:
    """The word with garbled spans decoded, None without structural evidence."""
    for codec in ("cp1252", "mac_roman", "cp1251", "cp437", "cp850"):
        text, decoded, rest = decode_spans(word, codec)
        # letters beside the spans speak for true text, except where each
        # character of a garble is a letter or not as chance has it
        if decoded and (codec == "cp1252" or rest <= decoded // 2 and rest <= 2):
            return text
    text, decoded, rest = decode_spans(word, "gbk")
    if decoded and rest <= 1:
        new = [c for c in text if ord(c) >= 128]
        cyrillic = all(0x400 <= ord(c) <= 0x451 for c in new)
        wide = all(ord(c) >= 0x2E80 for c in new)
        latin = all(ord(c) < 0x180 and c.isalpha() for c in new) and re.search(r"[A-Za-z][À-ſ]|[À-ſ][A-Za-z]", text)
        if cyrillic and len(new) >= 3 or wide or latin and _one_case(text):
            return text
    return None


def _one_case(text: str) -> bool:
    letters = "".join(re.findall(r"[A-Za-zÀ-ſ]+", text)[:1])
    return letters.islower() or letters.isupper() or letters.istitle()


def unspaced(ch: str) -> bool:
    o = ord(ch)
    return 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3


def units(word: str) -> list[str]:
    """What is counted of a word: the characters of scripts written without
    spaces, else the word in lower case without digits and outer marks."""
    wide = [c for c in word if unspaced(c)]
    if wide:
        return sorted(set(wide))
    w = re.sub(r"[0-9]+", "0", word.removeprefix("\\P").lower()).strip(".:?!,;()<>\"'")
    return [w] if w else []


_WIDE = "[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]"
_INSIDE = re.compile(rf"[a-z]{_WIDE}|{_WIDE}[a-z]+(?![\w./\\\\-])")


def _read_again(word: str) -> list[str]:
    """The word under other pairs of encodings."""
    found: dict[str, None] = {}
    codecs = SINGLE + DOUBLE
    for d in codecs:
        b = to_bytes(word, d)
        if b is None:
            continue
        for e in ("utf-8", *codecs):
            if e == d:
                continue
            try:
                r = b.decode(e)
            except UnicodeDecodeError:
                continue
            # scripts without spaces don't stand inside a word of Latin letters
            if r != word and not (_INSIDE.search(r) and not _INSIDE.search(word)):
                found[r] = None
    return [r for r in found if all(plausible(c) or ord(c) < 128 for c in r)]


_LEAD = re.compile(r"([ÂÃÄÅÐÑ])(\??)(?![-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])")


_LOST = re.compile(r"[ÂÃÄÅÐÑ]\?")


def _fill(word: str) -> list[str]:
    """A lead character whose continuation got lost: every way to fill it,
    for each such character by itself."""
    found = []
    for m in _LEAD.finditer(word):
        lead = _TABLES["cp1252"][m.group(1)]
        for c in range(0x80, 0xC0):
            ch = bytes((lead, c)).decode("utf-8")
            if ch.isalpha() and plausible(ch):
                found.append(word[: m.start()] + ch + word[m.end() :])
    return found


def analyse(word: str) -> tuple[str | None, str, bool, list[str]]:
    """(route of structural evidence, restored, restorable, other readings to
    look up); spans come first."""
    text = word
    for _ in range(3):
        following = _structure(text)
        if following is None:
            break
        text = following
    lost = "�" in word or any(0x80 <= ord(c) < 0xA0 for c in text) or len(_LOST.findall(text)) > 1
    if text != word or lost or any(0x80 <= ord(c) < 0xA0 for c in word):
        # the bytes may still be of another encoding than the spans suggest
        return "spans" if text != word else "lost", text, not lost, [] if "�" in word else _read_again(word)
    return None, word, True, _read_again(word) + _fill(word)


WORDS = r"[ \t\r\n]+"


def values_of(fas_resources: DataFrame, fas_bytes: DataFrame) -> DataFrame:
    """(origin, sample_id, idx, value) of all non-ASCII values, once each."""
    a = fas_resources.select(F.lit("resource").alias("origin"), "sample_id", F.col("idx").cast("int").alias("idx"), "value")
    b = fas_bytes.select(F.lit("strings").alias("origin"), "sample_id", F.posexplode("strings").alias("idx", "value"))
    return a.unionByName(b).where(F.col("value").rlike(r"[^\x00-\x7F]")).distinct()


def garbled_words(words: DataFrame) -> DataFrame:
    """``(w, restored, restorable, route)`` of the garbled ones among
    ``words(w, n)``, which are spread over tasks by their number."""
    tasks = max(-(-words.count() // WORDS_PER_TASK), 1)
    words = words.repartition(tasks, "w")

    def count_units(it):
        for pdf in it:
            rows = [(u, n) for w, n in zip(pdf["w"], pdf["n"]) for u in units(w)]
            yield pd.DataFrame(rows, columns=["u", "n"])

    def look(it):
        for pdf in it:
            rows = []
            for w in pdf["w"]:
                route, restored, restorable, readings = analyse(w)
                if route:
                    rows.append((w, route, restored, restorable, None))
                if readings:
                    rows.extend((w, "own", w, True, u) for u in units(w))
                for r in readings:
                    rows.extend((w, "other", r, True, u) for u in units(r))
            yield pd.DataFrame(rows, columns=["w", "kind", "r", "ok", "u"])

    counts = words.mapInPandas(count_units, "u string, n bigint").groupBy("u").agg(F.sum("n").alias("n"))
    looked = staged(words.mapInPandas(look, "w string, kind string, r string, ok boolean, u string"))
    rated = looked.where("kind in ('own', 'other')").join(counts, "u", "left").groupBy("w", "kind", "r").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    best = rated.groupBy("w").agg(
        F.max(F.when(F.col("kind") == "own", F.col("n"))).alias("own"),
        F.max_by("r", F.when(F.col("kind") == "other", F.struct("n", "r"))).alias("r"),
        F.max(F.when(F.col("kind") == "other", F.col("n"))).alias("n"),
    )
    read = best.where((F.col("n") >= LEAST) & (F.col("n") >= RATIO * F.coalesce("own", F.lit(0)))).select("w", F.col("r").alias("reading"))
    sure = looked.where("kind not in ('own', 'other')").select("w", F.col("r").alias("decoded"), "ok", F.col("kind").alias("route"))
    return sure.join(read, "w", "full").select(
        "w", F.coalesce("reading", "decoded").alias("restored"), (F.col("reading").isNotNull() | F.coalesce("ok", F.lit(False))).alias("restorable"),
        F.coalesce("route", F.lit("vocabulary")).alias("route"),
    )


def restored(fas_resources: DataFrame, fas_bytes: DataFrame) -> DataFrame:
    """(origin, sample_id, idx, value, restored, restorable, route) of the
    values that are garbled in whole or in part."""
    values = staged(values_of(fas_resources, fas_bytes))
    each = values.select("origin", "sample_id", "idx", "value", F.explode(F.array_distinct(F.split("value", WORDS))).alias("w"))
    each = each.where(F.col("w").rlike(r"[^\x00-\x7F]"))
    words = staged(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    hits = join_unique(each, garbled_words(words), "w", "inner", hot_keys(each, "w"))
    per_value = hits.groupBy("origin", "sample_id", "idx", "value").agg(
        F.sort_array(F.collect_list(F.struct(F.length("w").alias("len"), "w", "restored")), False).alias("swap"), F.bool_and("restorable").alias("restorable"), F.min(F.struct(F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route")).alias("k"), "route")).alias("by")
    )
    text = F.aggregate("swap", F.col("value"), lambda t, s: F.replace(t, s["w"], s["restored"]))
    return per_value.select("origin", "sample_id", "idx", "value", text.alias("restored"), "restorable", "by.route")


def found(fas_resources: DataFrame, fas_bytes: DataFrame) -> DataFrame:
    return restored(fas_resources, fas_bytes).select("origin", "sample_id", "idx").distinct()
