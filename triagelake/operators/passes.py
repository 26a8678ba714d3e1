"""Passes over the instruction form of scripts.

``instr(sample_id, fn, block, seq, opcode, result, operands array<string>)``;
``functions(sample_id, fn, params array<string>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import character, int_prefix
from triagelake.operators.effects import any_in, startup_target
from triagelake.operators.graph import reachable_blocks


def fold_constants(instr: DataFrame) -> DataFrame:
    """Calls of four functions on literals become assignments of their value;
    names that nothing resolves count as literals where they are joined."""
    fn, args = F.lower(F.get("operands", 0)), F.slice("operands", 2, F.greatest(F.size("operands") - 1, F.lit(0)))
    first = F.get(args, 0)
    code = int_prefix(first)
    value = (
        F.when(fn == "strcat", F.array_join(args, ""))
        .when((fn == "chr") & code.between(1, 0x10FFFF), character(code))
        .when(fn == "atoi", F.coalesce(code, F.lit(0)).cast("string"))
        .when(fn == "itoa", code.cast("string"))
    )
    folded = (F.col("opcode") == "CALL") & value.isNotNull()
    return instr.withColumns({"opcode": F.when(folded, "ASSIGN").otherwise(F.col("opcode")), "operands": F.when(folded, F.array(value)).otherwise(F.col("operands"))})


def prune_noops(instr: DataFrame) -> DataFrame:
    """Without instructions that do nothing: NOP, and x = x."""
    same = (F.col("opcode") == "ASSIGN") & F.coalesce(F.element_at("operands", -1) == F.col("result"), F.lit(False))
    return instr.where((F.col("opcode") != "NOP") & ~same)


def prune_unreachable(instr: DataFrame, entries: DataFrame, successors: DataFrame) -> DataFrame:
    """Without the blocks that control flow from an entry does not reach."""
    return instr.join(reachable_blocks(entries, successors), ["sample_id", "block"], "left_semi")


def parameter_bindings(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Arguments of call sites beside the parameters they bind, by position.

    ``calls(sample_id, fn, callee, args array<string>)``.
    """
    a = calls.select("sample_id", F.col("fn").alias("caller"), "callee", F.posexplode("args").alias("pos", "argument"))
    p = functions.select("sample_id", F.col("fn").alias("callee"), F.posexplode("params").alias("pos", "parameter"))
    return a.join(p, ["sample_id", "callee", "pos"]).select("sample_id", "caller", "callee", "parameter", "argument")


def path_resolution(path: Column) -> tuple[Column, Column]:
    """How far a path is resolved, and what it is."""
    low = F.lower(path)
    level = F.when(path.isNull() | (path == "") | (path == "unknown"), "unresolved").when(path.rlike(r"^([A-Za-z]:[\\/]|[\\/]{2}|/)"), "full").when(path.rlike(r"[\\/.]"), "partial").otherwise("unresolved")
    kind = F.when(startup_target(path, "evidence"), "startup").when(any_in(low, ("menu", ".mnu", ".cui")), "menu").otherwise("data")
    return level, kind


def environment_check(name: Column) -> tuple[Column, Column]:
    """Class and severity of a look at the environment."""
    low = F.lower(name)
    kind = (
        F.when(any_in(low, ("date", "time")), "TIME").when(any_in(low, ("mac", "host", "serial")), "HOST_ID").when(any_in(low, ("dwg", "file", "path")), "FILE_CONTEXT")
        .when(any_in(low, ("acad", "product", "ver")), "APP_CONTEXT").otherwise("SYSTEM_CONTEXT")
    )
    severity = F.when(kind.isin("HOST_ID", "TIME"), "high").when(kind == "FILE_CONTEXT", "medium").otherwise("low")
    return kind, severity


def obfuscating_definitions(nodes: DataFrame) -> DataFrame:
    """Definitions whose head looks like a transformation.  The head of a
    definition is always its keyword, so in practice there are none."""
    return nodes.where((F.col("op") == "DEFUN") & any_in(F.lower("fn"), ("mkgroup", "decode", "encode", "transform", "obfuscate"))).select("sample_id", F.lit(0.9).alias("confidence"))
