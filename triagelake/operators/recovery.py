"""Merging what is recovered from compiled files, and comparing it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.effects import any_in, dedup_cap
from triagelake.operators.evaluation import set_compare

# fixed values: effects that a recovered behaviour stands for; no target means
# its first evidence
BEHAVIOUR_EFFECTS = {
    "wsh_warning_suppression": (("registry_modify", None),),
    "script_payload_staging": (("com_create", "ADODB.Stream"), ("com_invoke", "ScriptControl")),
    "wsf_payload_output": (("file_write", None),),
    "reactor_persistence": (("com_invoke", None),),
    "timestamped_artifact_naming": (("env_check", "date"),),
    "file_search_copy_propagation": (("file_read", "findfile"), ("file_write", "vl-file-copy")),
}
# fixed values: where behaviours without a function belong
MODULE = "recovered_fas_module"
LIGHT_FUNCTIONS, LIGHT_BINDINGS = 2_000, 5_000


def _supporting(functions: Column) -> Column:
    names = F.transform(functions, lambda f: F.format_string("fn_%04x", f))
    return F.when(F.size(functions) > 0, names).otherwise(F.array(F.lit(MODULE)))


def behaviour_effects(behaviours: DataFrame) -> DataFrame:
    """Synthetic effects, one set per behaviour and supporting function (the
    module where none is named); the function is their source."""
    table = F.create_map(*[x for k, v in BEHAVIOUR_EFFECTS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(e).alias("e"), F.lit(t).cast("string").alias("t")) for e, t in v]))])
    rows = behaviours.select("sample_id", "kind", "category", "evidence", F.explode(_supporting(F.col("functions"))).alias("fn"))
    rows = rows.select("*", F.posexplode(F.try_element_at(table, F.col("kind"))).alias("k", "x"))
    meta = F.create_map(F.lit("recovered_from"), F.lit("fas_behavior"), F.lit("recovered_behavior"), F.col("kind"), F.lit("recovered_category"), F.col("category"))
    return rows.select(
        "sample_id", F.col("k").alias("seq"), "fn", F.col("x.e").alias("effect_type"), F.coalesce("x.t", F.get("evidence", 0)).alias("target"), F.col("fn").alias("source"),
        meta.alias("meta"), F.lit(None).cast("int").alias("line"),
    )


def behaviour_summaries(behaviours: DataFrame) -> DataFrame:
    """``(sample_id, fn, behaviour)`` as functions' own behaviours have it."""
    return behaviours.select("sample_id", F.explode(_supporting(F.col("functions"))).alias("fn"), F.col("kind").alias("behaviour")).distinct()


def recovered_evidence(behaviours: DataFrame) -> DataFrame:
    """What behaviours add to the evidence of spreading, per sample: methods,
    entry points of reactors, code that is loaded, and whether it is likely."""
    kind = F.col("kind")
    spreads, output = kind == "file_search_copy_propagation", kind == "wsf_payload_output"
    entries = F.flatten(F.collect_list(F.when(kind == "reactor_persistence", F.transform("functions", lambda f: F.format_string("fn_%04x", f)))))
    loaded = F.array_sort(F.collect_set(F.when(spreads, "vl-file-copy").when(output, ".WSF")))
    return behaviours.groupBy("sample_id").agg(
        F.array_sort(F.collect_set("kind")).alias("methods"), F.array_sort(F.array_distinct(entries)).alias("entry_points"), loaded.alias("code_loader_targets"),
        F.bool_or(kind.isin("reactor_persistence", "file_search_copy_propagation", "wsf_payload_output")).alias("propagation_likely"),
    )


def merge_effects(source: DataFrame, *recovered: DataFrame) -> DataFrame:
    """Source effects first, recovered ones after them, each (type, target,
    source) once per sample and within the cap."""
    ranked = source.withColumn("_o", F.struct(F.lit(0).alias("a"), F.col("seq").alias("b")))
    for k, r in enumerate(recovered, 1):
        ranked = ranked.unionByName(r.withColumn("_o", F.struct(F.lit(k).alias("a"), F.col("seq").cast("int").alias("b"))))
    return dedup_cap(ranked, order="_o").drop("_o")


def light_mode(frames: DataFrame, bindings: DataFrame) -> DataFrame:
    """Samples too large for propagation and inherited effects."""
    f = frames.groupBy("sample_id").agg(F.count(F.lit(1)).alias("functions"))
    b = bindings.groupBy("sample_id").agg(F.count(F.lit(1)).alias("bindings"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.join(b, "sample_id", "full").select("sample_id", ((z("functions") >= LIGHT_FUNCTIONS) | (z("bindings") >= LIGHT_BINDINGS)).alias("light"))


def record_groups(metadata: DataFrame) -> DataFrame:
    """Metadata keys of a container by the record they name, in order.
    ``metadata(sample_id, key, value)``, keys ``<record>_<field>``."""
    prefix = F.regexp_extract("key", r"^(.*)_(functions|bindings|behaviors|resource_summary|calls)$", 1)
    return metadata.withColumn("record", prefix).where("record <> ''").groupBy("sample_id", "record").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields")).orderBy("sample_id", "record")


def function_names(instr: DataFrame, least: int = 40) -> DataFrame:
    """Names of functions recovered from what they push and call.

    Every text scores for its function by kind and by how early it stands;
    the best one names it, ties go to the first in the alphabet; below
    ``least`` the offset does.  Equal names in a file get a number.
    """
    texts = instr.where("frame is not null and text is not null")
    order = F.row_number().over(Window.partitionBy("sample_id", "frame").orderBy("seq"))
    t = F.lower("text")
    score = (
        F.when(t.rlike(r"^(c:|s::)"), 100).when(F.col("name").isin("SETQ_DEFUN"), 80).when(t.rlike(r"^[a-z][a-z0-9:_-]{2,40}$") & (F.col("name") == "PUSH_CONST"), 30).when(F.col("name").isin("CALL", "CALL_JMP"), 10).otherwise(1)
    ) + F.greatest(F.lit(10) - order, F.lit(0))
    scored = texts.withColumn("score", score).groupBy("sample_id", "frame", "text").agg(F.sum("score").alias("score"))
    best = scored.groupBy("sample_id", "frame").agg(F.min(F.struct((-F.col("score")).alias("s"), "text")).alias("b"))
    name = F.when(-F.col("b.s") >= least, F.regexp_replace("b.text", r"[^A-Za-z0-9:_-]", "_")).otherwise(F.format_string("fn_%04x", "frame"))
    named = best.select("sample_id", "frame", name.alias("name"))
    n = F.row_number().over(Window.partitionBy("sample_id", "name").orderBy("frame"))
    return named.withColumn("n", n).select("sample_id", "frame", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string"))).alias("name"))


_ARITHMETIC = {"ADD_FIXNUM": "+", "SUB_FIXNUM": "-", "MUL_FIXNUM": "*", "DIV_FIXNUM": "/", "MOD_FIXNUM": "rem", "LE_FIXNUM": "<=", "GE_FIXNUM": ">=", "LT_FIXNUM": "<", "GT_FIXNUM": ">", "SUB": "-", "CONS": "cons"}
_UNARY = {"CAR": "car", "CDR": "cdr", "NULL_P": "null", "ATOM_P": "atom", "INC1": "1+", "DEC1": "1-"}
MAX_EXPRESSION = 512


def expressions(instr: DataFrame) -> DataFrame:
    """Calls with their arguments as text, from a symbolic stack.

    One file's instructions form a group, in order; the stack is cleared at
    the end of a function, expressions are cut at a length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, stack = [], []
        pop = lambda: stack.pop() if stack else "?"
        for r in pdf.sort_values("seq").itertuples():
            ops = list(r.operands) if r.operands is not None else []
            if r.name in ("PUSH_CONST", "PUSH_SYM", "PUSH_GVAR"):
                stack.append(f'"{r.text}"' if r.name == "PUSH_CONST" and r.text is not None else r.text or f"#{ops[0]}")
            elif r.name == "PUSH_INT32":
                stack.append(str(ops[0]))
            elif r.name in ("PUSH_NIL", "PUSH_T"):
                stack.append("nil" if r.name == "PUSH_NIL" else "T")
            elif r.name in ("LOAD_LVAR", "LOAD_LVAR2"):
                stack.append(f"v{ops[0]}")
            elif r.name == "DUP" and stack:
                stack.append(stack[-1])
            elif r.name == "POP" or r.name.startswith("SETQ"):
                pop()
            elif r.name in _ARITHMETIC:
                b, a = pop(), pop()
                stack.append(f"({_ARITHMETIC[r.name]} {a} {b})"[:MAX_EXPRESSION])
            elif r.name in _UNARY:
                stack.append(f"({_UNARY[r.name]} {pop()})"[:MAX_EXPRESSION])
            elif r.name in ("MAKE_LIST", "LD_LIST") or r.name in ("CALL", "CALL_JMP"):
                # all that the count names; of those missing, as many as the length can show
                have = min(ops[0], len(stack))
                args = ["?"] * min(ops[0] - have, MAX_EXPRESSION) + stack[len(stack) - have :]
                del stack[len(stack) - have :]
                head = "list" if r.name in ("MAKE_LIST", "LD_LIST") else r.text or f"sym_{ops[1]}"
                text = f"({' '.join([head, *args])})"[:MAX_EXPRESSION]
                stack.append(text)
                if head != "list":
                    out.append((r.sample_id, int(r.seq), None if pd.isna(r.frame) else int(r.frame), head, text))
            elif r.name in ("END_DEFUN", "END_DEFUN2"):
                stack.clear()
        frame = pd.DataFrame(out, columns=["sample_id", "seq", "frame", "callee", "expression"])
        frame["frame"] = frame["frame"].astype("Int32")
        return frame

    return instr.groupBy("sample_id").applyInPandas(run, "sample_id string, seq int, frame int, callee string, expression string")


def rendered(names: DataFrame, exprs: DataFrame, compact: int | None = None) -> DataFrame:
    """Recovered source of each function: its calls in order.

    All of them, unless the compact form is asked for with the number of calls
    to keep, which says at the end how many it leaves out.
    """
    w = Window.partitionBy("sample_id", "frame").orderBy("seq")
    calls = exprs.where("frame is not null").withColumn("k", F.row_number().over(w))
    line = F.struct("seq", F.concat(F.lit("  "), "expression").alias("line"))
    kept = line if compact is None else F.when(F.col("k") <= compact, line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n")
    if compact is not None:
        rest = F.max("k") - compact
        body = F.concat(body, F.when(rest > 0, F.concat(F.lit("\n  ;; ... "), rest.cast("string"), F.lit(" additional calls omitted in compact mode\n"))).otherwise(""))
    bodies = calls.groupBy("sample_id", "frame").agg(body.alias("body"))
    return names.join(bodies, ["sample_id", "frame"], "left").select("sample_id", "frame", "name", F.concat(F.lit("(defun "), "name", F.lit(" ()\n"), F.coalesce("body", F.lit("")), F.lit(")")).alias("source"))


# --------------------------------------------------------------- comparisons


def source_items(texts: DataFrame, key: str = "sample_id", text: str = "text") -> DataFrame:
    """Definitions, called heads and strings of source texts: ``(key, kind,
    item)``."""
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    each = F.array(
        F.struct(F.lit("function").alias("kind"), find(r"(?i)\(\s*defun(?:-q)?\s+([^\s()\"]+)").alias("items")),
        F.struct(F.lit("api").alias("kind"), find(r"\(\s*((?:vl|vla|vlax|vlr)-[A-Za-z0-9*>-]+|command|load|open|startapp|findfile|setvar|getvar)(?=[\s()])").alias("items")),
        F.struct(F.lit("string").alias("kind"), find(r'"((?:[^"\\]|\\.){4,})"').alias("items")),
    )
    rows = texts.where(F.col(text).isNotNull()).select(key, F.explode(each).alias("x")).select(key, "x.kind", F.explode("x.items").alias("item"))
    return rows.select(key, "kind", F.when(F.col("kind") == "string", canonical_text(F.col("item"))).otherwise(F.lower("item")).alias("item")).where("item <> ''").distinct()


def canonical_text(c: Column) -> Column:
    """Strings in a common form: blanks collapsed, escapes undone."""
    return F.trim(F.regexp_replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"')), r"\s+", " "))


def recovered_items(frames: DataFrame, instr: DataFrame, resources: DataFrame) -> DataFrame:
    """The same kinds of items from compiled files, noise left out."""
    api = instr.where("text is not null").select("sample_id", F.lit("api").alias("kind"), F.lower("text").alias("item")).where(F.col("item").rlike(r"^(vl|vla|vlax|vlr)-|^(command|load|open|startapp|findfile|setvar|getvar)$"))
    texts = resources.where("kind = 'string' and length(value) >= 4").select("sample_id", F.lit("string").alias("kind"), canonical_text(F.col("value")).alias("item")).where(~F.col("item").rlike(r"^[^A-Za-z0-9]*$"))
    fn = frames.select("sample_id", F.lit("function").alias("kind"), F.lower("name").alias("item")).where("not item rlike '^fn_'")
    return api.unionByName(texts).unionByName(fn).distinct()


def compare_items(expected: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recall and precision per sample and kind."""
    return set_compare(expected, recovered, "sample_id", "kind")


def top_bindings(aliases: DataFrame) -> DataFrame:
    """Names that a script binds at top level; those inside a function are
    its own."""
    return aliases.where("fn = '__toplevel__'").select("sample_id", F.regexp_replace("name", r"_\d+$", "").alias("name")).where("name <> ''").distinct()


def candidate_apis(facts: DataFrame) -> DataFrame:
    """Names that masking may take away: calls, nodes, and effect sources."""
    names = facts.where("fact in ('call', 'node')").select("sample_id", F.lower(F.when(F.col("fact") == "call", F.col("name")).otherwise(F.col("fn"))).alias("api"))
    sources = facts.where("fact = 'effect'").select("sample_id", F.lower("source").alias("api"))
    both = names.unionByName(sources).distinct()
    return both.where(F.col("api").rlike(r"^(vl|vla|vlax|vlr|acet)-") | F.col("api").isin("command", "load", "open", "startapp", "findfile", "setvar", "getvar", "eval", "write-line", "read-line", "princ"))


def mask_surface(rows: DataFrame, share: float, seed: int, *identity: str) -> DataFrame:
    """Rows left when each is dropped with a probability, by digest of its
    identity, so the same rows go wherever the job runs."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])), 1, 8), 16, 10).cast("bigint")
    return rows.where(h >= int(share * 2**32))


def merged_unique(*lists: Column) -> Column:
    """Items of several lists in order, each once."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]), lambda x: x.isNotNull() & (x != "")))


def api_classes(name: Column) -> Column:
    return F.when(any_in(name, ("vlax-", "vla-")), "com").when(name.startswith("vlr-"), "reactor").when(name.startswith("vl-"), "extension").otherwise("core")
