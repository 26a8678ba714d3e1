"""Binary containers to rows: compiled streams, their resources, records.

Formats are read in Arrow batches with the bytes of one file per row; a file
that does not hold the expected marks gives a row that says so.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = ord("$")
MAX_BAD_HEADERS = 512
MAX_NAME = 80
MAX_WARNINGS = 32

_BLANK = re.compile(rb"[ \t\r\n]*")
_DIGITS = re.compile(rb"[0-9]+")


def decrypt(data: bytes, key: bytes) -> bytes:
    """Rolling exclusive-or with each key byte and the one before it."""
    if not key:
        return data
    n = len(key)
    pad = [key[(i + 1) % n] ^ key[i] for i in range(n)] if n > 1 else [0]
    return bytes(b ^ pad[i % n] for i, b in enumerate(data))


def _stream(data: bytes, at: int) -> tuple[bytes | None, bytes, int]:
    """(stream, key, position after it) of a length-prefixed stream."""
    at = _BLANK.match(data, at).end()
    size = _DIGITS.match(data, at)
    if not size:
        return None, b"", at
    start = data.find(b"$", size.end())
    end = start + 1 + int(size.group())
    if start < 0 or end > len(data):
        return None, b"", at
    body = data[start + 1 : end]
    if end >= len(data):
        return body, b"", end
    length = data[end]
    end += 1
    if length == SEPARATOR:
        return body, b"", end
    key = data[end : end + length]
    if len(key) < length:
        return None, b"", end
    end += length
    if end < len(data) and data[end] == SEPARATOR:
        end += 1
    return decrypt(body, key), key, end


def compiled_streams(data: bytes) -> tuple[bytes | None, bytes | None, str | None]:
    """(code, resources, what is wrong) of a compiled file."""
    mark = data.find(b"FAS4-FILE")
    if mark < 0:
        return None, None, "no marker"
    line = data.find(b"\r\n", mark)
    if line < 0:
        return None, None, "no header end"
    code, _, at = _stream(data, line + 2)
    if code is None:
        return None, None, "bad code stream"
    resources, _, _ = _stream(data, at)
    return code, resources, None if resources is not None else "no resource stream"


_BOUNDARY = re.compile(r"\[[A-Za-z0-9_:+*<>=?$!.&-]+\]?(?=\[|\Z)")
_SYMBOL = re.compile(r"[A-Za-z0-9_:+*<>=/?$!.-]+\Z")


def split_chunk(chunk: str) -> list[str]:
    """Parts of a resource chunk: a bracket that opens a bare name starts one."""
    starts = [0] + [m.start() for m in _BOUNDARY.finditer(chunk) if m.start() > 0]
    return [p for p in (chunk[a:b] for a, b in zip(starts, [*starts[1:], len(chunk)])) if p]


def is_symbol(value: str) -> bool:
    """A name rather than a text; upper-case names with underscores are texts."""
    if not _SYMBOL.match(value):
        return False
    return not ("_" in value and not re.search("[a-z]", value))


def resource_entries(stream: bytes) -> list[tuple[int, str, str]]:
    """(index, kind, value) of a resource stream, in order."""
    out: list[tuple[int, str, str]] = []
    if len(stream) < 4:
        return out
    for chunk in stream[4:].split(b"\0")[:-1]:
        for part in split_chunk(chunk.decode("utf-8", "replace")):
            if len(part) >= 2:
                out.append((len(out), "symbol" if is_symbol(part) else "string", part))
    return out


def compiled_files(files: DataFrame, key: str = "sample_id", content: str = "content") -> DataFrame:
    """Streams of compiled files: code, stream lengths, ordered resources and
    whether only a raw scan is left (``used_fallback``)."""

    def run(it):
        for pdf in it:
            rows = []
            for k, data in zip(pdf["k"], pdf["c"]):
                code, res, wrong = compiled_streams(bytes(data))
                entries = [{"idx": i, "kind": x, "value": v} for i, x, v in resource_entries(res or b"")]
                rows.append((k, code, len(code or b""), len(res or b""), entries, wrong is not None and code is None, wrong))
            yield pd.DataFrame(rows, columns=["sample_id", "code", "stream1_length", "stream2_length", "resources", "used_fallback", "problem"])

    return files.selectExpr(f"`{key}` as k", f"`{content}` as c").where("c is not null").mapInPandas(
        run, "sample_id string, code binary, stream1_length int, stream2_length int, resources array<struct<idx:int,kind:string,value:string>>, used_fallback boolean, problem string"
    )


def raw_strings(content: Column, least: int = 4, most: int = 256) -> Column:
    """Printable runs of bytes, where the format can't be read."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"([ -~]{{{least},{most}}})"), F.lit(1))


# fixed values: record types of a container
RECORD_KINDS = {0x0532: "fas", 0x0546: "dcl", 0x0537: "raw"}


def record_kind(blob: bytes, code: int) -> str:
    if code in RECORD_KINDS:
        return RECORD_KINDS[code]
    if len(blob) >= 128 and b"FAS4-FILE" in blob[:128]:
        return "fas"
    if len(blob) >= 512:
        head = blob[:512]
        if b"(defun " in head or b"(setq " in head:
            return "lsp"
        if b": dialog{" in head or b":dialog{" in head:
            return "dcl"
    return "unknown"


def container_records(data: bytes) -> tuple[list[tuple], list[str]]:
    """(records, warnings) of a container: a directory of named blobs.

    A header that can't be one moves the scan on by a byte; it ends after too
    many of those.
    """
    found, warnings, bad = [], [], 0
    load = data.find(b"LOAD(")
    start = data.find(b"\0", load) + 1 if load >= 0 else 0
    if load >= 0 and start == 0:
        return found, ["no directory"]
    tail = len(data)
    if len(data) >= 12:
        guess = struct.unpack_from("<I", data, 8)[0] + 4
        tail = guess if data[guess : guess + 8] == b"VRTLIB-1" else data.find(b"VRTLIB-1")
        tail = len(data) if tail < 0 else tail
    at = start
    while at + 7 <= tail:
        if data[at] == 0:
            at += 1
            continue
        length, code, name = struct.unpack_from("<IHB", data, at)
        body = at + 7 + name
        if length == 0 or at + length > len(data) or not 0 < name <= MAX_NAME or body > at + length:
            bad += 1
            if len(warnings) < MAX_WARNINGS:
                warnings.append(f"no record at {at}")
            if bad >= MAX_BAD_HEADERS:
                break
            at += 1
            continue
        bad = 0
        blob = data[body : at + length]
        found.append((len(found), at, length, code, data[at + 7 : body].decode("latin-1"), record_kind(blob, code), blob))
        at += length
    return found, warnings


def containers(files: DataFrame, key: str = "sample_id", content: str = "content") -> DataFrame:
    """One row per record of a container; equal blobs share a digest, so they
    need to be decoded once only."""

    def run(it):
        for pdf in it:
            rows = []
            for k, data in zip(pdf["k"], pdf["c"]):
                records, warnings = container_records(bytes(data))
                rows.extend((k, *r, len(warnings)) for r in records)
            yield pd.DataFrame(rows, columns=["sample_id", "idx", "position", "length", "type_code", "name", "kind", "blob", "warnings"])

    out = files.selectExpr(f"`{key}` as k", f"`{content}` as c").where("c is not null").mapInPandas(
        run, "sample_id string, idx int, position int, length bigint, type_code int, name string, kind string, blob binary, warnings int"
    )
    return out.withColumn("digest", F.md5("blob"))


def compiled_records(records: DataFrame) -> DataFrame:
    """Streams of the compiled records, each different blob decoded once."""
    fas = records.where("kind = 'fas'")
    once = fas.groupBy("digest").agg(F.first("blob").alias("blob"))
    streams = compiled_files(once, "digest", "blob").withColumnRenamed("sample_id", "digest")
    return fas.select("sample_id", "idx", "name", "digest").join(streams, "digest")
