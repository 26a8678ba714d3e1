"""Queries over compiled code, with their SQL.

The compiled files of the tables hold random bytes, which the instruction
counts read as they are.  What code does is shown on files put together from
the events of a user's week: each event is an instruction (or two), encoded
to bytes and decoded again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import recovery as V
from triagelake.session import staged, table
from triagelake.sources import bytecode as B

SYMBOLS = ("findfile", "vl-file-copy", "vlr-dwg-reactor", "getvar", "scriptcontrol", "foo", "c:run", "bar-baz", "load", "open")
STRINGS = (
    "acaddoc.lsp", "x", r"HKEY_CURRENT_USER\Software\Microsoft\Windows Script Host\Settings", "ScriptControl", "ADODB.Stream", "out.WSF", "M=$(edtime,$(getvar,date),YYMODD)", "a b",
    "s::startup", "c:go", "edtime", "77", "t12", "menu.mnu", "q", "zz",
)


def event_code(spark, sf_dir):
    """Code files: one of each user and week, an event after the other."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    byte = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    code = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("09"), byte(k % len(STRINGS)), F.lit("00")))
        .when(F.col("event_type") == "view", F.concat(F.lit("03"), byte(k % len(SYMBOLS)), F.lit("00")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("06"), byte(k % len(SYMBOLS)), F.lit("00")))
        .when(F.col("event_type") == "error", F.concat(F.lit("35"), byte(k % 3), byte(k % len(SYMBOLS)), F.lit("0000")))
        .when(k % 2 == 0, F.concat(F.lit("1614"), byte(k % 5), byte(k % 3), byte(k % 4), F.lit("00")))
        .otherwise(F.concat(F.lit("0D"), byte(k % 6), F.lit("00")))
    )
    rows = e.select(F.concat_ws("@", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")).alias("sample_id"), "ts", "event_id", code.alias("c"))
    files = rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "c"))), lambda x: x["c"]), "").alias("c"))
    lits = lambda xs: F.array(*map(F.lit, xs))
    return files.select("sample_id", F.unhex(F.concat(F.lit("01000000"), "c")).alias("code"), lits(SYMBOLS).alias("symbols"), lits(STRINGS).alias("strings"))


def _instructions(spark, sf_dir):
    return staged(B.instructions(event_code(spark, sf_dir)))


def _whole(df):
    """Whole numbers as they are compared."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def code_instructions(spark, sf_dir):
    """Instructions of all compiled files, by name."""
    i = B.instructions(table(spark, sf_dir, "fas_bytes"))
    return i.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("files"), F.sum("size").alias("bytes"))


def code_listing(spark, sf_dir):
    i = B.instructions(event_code(spark, sf_dir))
    return _whole(i.select("sample_id", "seq", "position", "name", F.get("operands", 0).alias("first"), "size", "frame", "text"))


def code_frames(spark, sf_dir):
    return _whole(B.frames(_instructions(spark, sf_dir)).select("sample_id", "frame", "kind", "num_args", "max_args", "vars", "end", "instructions", F.array_join("calls", ",").alias("calls"), "indirect", "locals"))


def code_edges(spark, sf_dir):
    return _whole(B.edges(B.instructions(event_code(spark, sf_dir))))


def code_blocks(spark, sf_dir):
    return B.block_starts(_instructions(spark, sf_dir)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("position").alias("positions"))


def code_owners(spark, sf_dir):
    i = _instructions(spark, sf_dir)
    return B.owners(i, B.frames(i)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("instructions"), F.count("owner").alias("owned"), F.sum("owner").alias("owners"))


def code_bindings(spark, sf_dir):
    return _whole(B.bindings(B.instructions(event_code(spark, sf_dir))))


def code_behaviours(spark, sf_dir):
    b = B.behaviours(B.instructions(event_code(spark, sf_dir)))
    return b.select("sample_id", "kind", "category", F.array_join("functions", ",").alias("functions"), F.array_join("evidence", "|").alias("evidence"))


def code_effects(spark, sf_dir):
    """Effects that behaviours stand for."""
    b = B.behaviours(B.instructions(event_code(spark, sf_dir)))
    return V.behaviour_effects(b).select("sample_id", "fn", "effect_type", "target", "source")


def code_evidence(spark, sf_dir):
    e = V.recovered_evidence(B.behaviours(B.instructions(event_code(spark, sf_dir))))
    return e.select("sample_id", *[F.array_join(c, "|").alias(c) for c in ("methods", "entry_points", "code_loader_targets")], "propagation_likely")


def code_calls(spark, sf_dir):
    """Calls between functions of compiled code, as the call graph takes them."""
    c = B.recovered_calls(B.instructions(event_code(spark, sf_dir)))
    return c.groupBy("sample_id", "fn", "name").agg(F.count(F.lit(1)).alias("n"))


def code_names(spark, sf_dir):
    return _whole(V.function_names(B.instructions(event_code(spark, sf_dir))))


def code_expressions(spark, sf_dir):
    return V.expressions(B.instructions(event_code(spark, sf_dir)))


def code_sources(spark, sf_dir):
    i = _instructions(spark, sf_dir)
    return V.rendered(V.function_names(i), V.expressions(i))


QUERIES = {
    f.__name__: f
    for f in (
        code_instructions, code_listing, code_frames, code_edges, code_blocks, code_owners, code_bindings, code_behaviours, code_effects, code_evidence, code_calls, code_names,
        code_expressions, code_sources,
    )
}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


_OPS = ", ".join(f"('{code:02X}', '{name}', {B.SIZES[layout]})" for code, (name, layout) in sorted(B.OPCODES.items()))
_ROW = lambda name, first, size, text="NULL", args="NULL, o2 := NULL": f"struct_pack(name := '{name}', o0 := {first}, o1 := {args}, size := {size}, text := {text})"
_INSTR = f"""ev AS (SELECT user_id::VARCHAR || '@' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS sample_id, ts, event_id, event_type AS t, json_extract_string(props, '$.k')::BIGINT AS k, {_list(SYMBOLS)} AS sy, {_list(STRINGS)} AS st FROM events),
ex AS (SELECT sample_id, ts, event_id, CASE t WHEN 'click' THEN [{_ROW('PUSH_CONST', f'k % {len(STRINGS)}', 3, f'st[k % {len(STRINGS)} + 1]')}]
 WHEN 'view' THEN [{_ROW('PUSH_SYM', f'k % {len(SYMBOLS)}', 3, f'sy[k % {len(SYMBOLS)} + 1]')}] WHEN 'purchase' THEN [{_ROW('SETQ_GVAR', f'k % {len(SYMBOLS)}', 3, f'sy[k % {len(SYMBOLS)} + 1]')}]
 WHEN 'error' THEN [{_ROW('CALL', 'k % 3', 5, f'sy[k % {len(SYMBOLS)} + 1]')}]
 ELSE CASE WHEN k % 2 = 0 THEN [{_ROW('END_DEFUN', 'NULL', 1)}, {_ROW('DEFUN', 'k % 5', 5, 'NULL', 'k % 3, o2 := k % 4')}] ELSE [{_ROW('BR_IF_FALSE', 'k % 6', 3)}] END END AS l FROM ev),
un AS (SELECT sample_id, ts, event_id, unnest(l) AS x, unnest(range(len(l))) AS j FROM ex),
sq AS (SELECT sample_id, x.name AS name, x.o0::BIGINT AS o0, x.o1::BIGINT AS o1, x.o2::BIGINT AS o2, x.size::BIGINT AS size, x.text AS text, row_number() OVER w - 1 AS seq,
 4 + coalesce(sum(x.size) OVER (PARTITION BY sample_id ORDER BY ts, event_id, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM un WINDOW w AS (PARTITION BY sample_id ORDER BY ts, event_id, j)),
i AS (SELECT *, max(CASE WHEN name = 'DEFUN' THEN position END) OVER (PARTITION BY sample_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS frame FROM sq)"""
_EDGES = """ed AS (SELECT DISTINCT sample_id, position AS src, position + 3 + CASE WHEN k = 'fallthrough' THEN 0 ELSE o0 END AS dst, k AS kind FROM (SELECT *, unnest(['BR_IF_FALSE', 'fallthrough']) AS k FROM i WHERE name = 'BR_IF_FALSE'))"""
_FN = "printf('fn_%04x', frame)"
_SEEN = "fl AS (SELECT sample_id, " + ", ".join(
    [f"bool_or(name = 'PUSH_CONST' AND contains(lower(text), {_text(w)})) AS s_{k}" for k, w in B.BEHAVIOUR_TEXTS.items()]
    + [f"bool_or(name = 'CALL' AND lower(text) = {_text(w)}) AS c_{k}" for k, w in B.BEHAVIOUR_CALLS.items()]
    + [f"list_sort(list(DISTINCT frame) FILTER ({c} AND frame IS NOT NULL)) AS f_{k}" for k, c in (
        ("control", "name = 'CALL' AND text = 'scriptcontrol'"), ("reactor", "name = 'CALL' AND text = 'vlr-dwg-reactor'"), ("files", "name = 'CALL' AND text IN ('findfile', 'vl-file-copy')"),
        ("settings", r"name = 'PUSH_CONST' AND contains(lower(text), 'windows script host\settings')"), ("stamp", "name = 'PUSH_CONST' AND contains(lower(text), '$(edtime,$(getvar,date)')"),
    )]
) + " FROM i WHERE text IS NOT NULL AND name IN ('PUSH_CONST', 'CALL') GROUP BY sample_id)"
_WHEN = ("s_settings", "(s_control OR c_control) AND s_stream", "(s_control OR c_control) AND s_wsf", "s_reactor OR c_reactor", "s_stamp OR (c_getvar AND s_edtime)", "s_find OR c_find OR s_copy OR c_copy")
_SHOWN = "bh AS (" + " UNION ALL ".join(
    f"SELECT sample_id, '{kind}' AS kind, '{category}' AS category, coalesce({fns}, []) AS functions, {_list(evidence)} AS evidence FROM fl WHERE {seen}"
    for (kind, category, evidence), seen, fns in zip(B.BEHAVIOURS, _WHEN, ("f_settings", "f_control", "f_control", "f_reactor", "f_stamp", "f_files"))
) + ")"
_EFFECT_ROWS = ", ".join(f"('{kind}', '{e}', {_text(t) if t else 'NULL'})" for kind, es in V.BEHAVIOUR_EFFECTS.items() for e, t in es)

SQL = {
    "code_instructions": f"""WITH RECURSIVE op(h, name, s) AS (VALUES {_OPS}), f AS (SELECT row_number() OVER () AS r, sample_id, hex(code) AS x, octet_length(code) AS n FROM fas_bytes WHERE code IS NOT NULL),
d(r, p) AS (SELECT r, 4::BIGINT FROM f WHERE n > 4 UNION ALL SELECT d.r, p + 1 + coalesce(s, 0) FROM d JOIN f USING (r) LEFT JOIN op ON h = substr(x, p * 2 + 1, 2) WHERE (coalesce(s, 0) = 0 OR p + s < n) AND p + 1 + coalesce(s, 0) < n)
SELECT coalesce(name, 'UNKNOWN_' || substr(x, p * 2 + 1, 2)) AS name, count(*) AS n, count(DISTINCT sample_id) AS files, sum(1 + coalesce(s, 0))::BIGINT AS bytes FROM d JOIN f USING (r) LEFT JOIN op ON h = substr(x, p * 2 + 1, 2)
WHERE coalesce(s, 0) = 0 OR p + s < n GROUP BY 1""",
    "code_listing": f"WITH {_INSTR} SELECT sample_id, seq, position, name, o0 AS first, size, frame, text FROM i",
    "code_frames": f"""WITH {_INSTR}, g AS (SELECT sample_id, frame, max(position + size - 1) AS "end", count(*) AS instructions, coalesce(string_agg(DISTINCT text, ',' ORDER BY text) FILTER (name = 'CALL'), '') AS calls FROM i WHERE frame IS NOT NULL GROUP BY ALL)
SELECT sample_id, frame, 'DEFUN' AS kind, o1 AS num_args, o2 AS max_args, o0 AS vars, g."end", instructions, calls, 0::BIGINT AS indirect, greatest(o0 - o1, 0) AS locals FROM i JOIN g USING (sample_id, frame) WHERE name = 'DEFUN'""",
    "code_edges": f"WITH {_INSTR}, {_EDGES} SELECT * FROM ed",
    "code_blocks": f"WITH {_INSTR}, {_EDGES} SELECT sample_id, count(*) AS blocks, sum(p)::BIGINT AS positions FROM (SELECT sample_id, position AS p FROM i WHERE name = 'DEFUN' UNION SELECT sample_id, dst FROM ed) GROUP BY sample_id",
    "code_owners": f"WITH {_INSTR} SELECT sample_id, count(*) AS instructions, count(frame) AS owned, sum(frame)::BIGINT AS owners FROM i GROUP BY sample_id",
    "code_bindings": f"""WITH {_INSTR}, l AS (SELECT *, CASE WHEN lag(name) OVER w = 'PUSH_CONST' THEN lag(text) OVER w END AS value FROM i WINDOW w AS (PARTITION BY sample_id ORDER BY seq))
SELECT sample_id, -1::BIGINT AS scope, o0 AS slot, arg_max(value, seq) AS value, arg_max(text, seq) AS symbol, max(position) AS position FROM l WHERE name = 'SETQ_GVAR' AND value IS NOT NULL GROUP BY sample_id, o0""",
    "code_behaviours": f"WITH {_INSTR}, {_SEEN}, {_SHOWN} SELECT sample_id, kind, category, array_to_string(functions, ',') AS functions, array_to_string(evidence, '|') AS evidence FROM bh",
    "code_effects": f"""WITH {_INSTR}, {_SEEN}, {_SHOWN}, t(kind, effect_type, target) AS (VALUES {_EFFECT_ROWS}), w AS (SELECT sample_id, kind, evidence, unnest(CASE WHEN len(functions) > 0 THEN list_transform(functions, lambda frame: {_FN}) ELSE ['{V.MODULE}'] END) AS fn FROM bh)
SELECT sample_id, fn, effect_type, coalesce(target, evidence[1]) AS target, fn AS source FROM w JOIN t USING (kind)""",
    "code_evidence": f"""WITH {_INSTR}, {_SEEN}, {_SHOWN}, en AS (SELECT sample_id, string_agg(DISTINCT {_FN}, '|' ORDER BY {_FN}) AS entry_points FROM (SELECT sample_id, unnest(functions) AS frame FROM bh WHERE kind = 'reactor_persistence') GROUP BY sample_id)
SELECT sample_id, string_agg(kind, '|' ORDER BY kind) AS methods, coalesce(any_value(entry_points), '') AS entry_points,
 concat_ws('|', CASE WHEN bool_or(kind = 'wsf_payload_output') THEN '.WSF' END, CASE WHEN bool_or(kind = 'file_search_copy_propagation') THEN 'vl-file-copy' END) AS code_loader_targets,
 bool_or(kind IN ('reactor_persistence', 'file_search_copy_propagation', 'wsf_payload_output')) AS propagation_likely FROM bh LEFT JOIN en USING (sample_id) GROUP BY sample_id""",
    "code_calls": f"WITH {_INSTR} SELECT sample_id, {_FN} AS fn, lower(text) AS name, count(*) AS n FROM i WHERE i.name = 'CALL' AND frame IS NOT NULL GROUP BY 1, 2, 3",
    "code_names": f"""WITH {_INSTR}, o AS (SELECT *, lower(text) AS t, row_number() OVER (PARTITION BY sample_id, frame ORDER BY seq) AS k FROM i WHERE frame IS NOT NULL AND text IS NOT NULL),
s AS (SELECT sample_id, frame, text, sum(CASE WHEN regexp_matches(t, '^(c:|s::)') THEN 100 WHEN regexp_matches(t, '^[a-z][a-z0-9:_-]{{2,40}}$') AND name = 'PUSH_CONST' THEN 30 WHEN name = 'CALL' THEN 10 ELSE 1 END + greatest(10 - k, 0)) AS score FROM o GROUP BY ALL),
b AS (SELECT sample_id, frame, CASE WHEN score >= 40 THEN regexp_replace(text, '[^A-Za-z0-9:_-]', '_', 'g') ELSE {_FN} END AS name FROM s QUALIFY row_number() OVER (PARTITION BY sample_id, frame ORDER BY score DESC, text) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY frame) AS n FROM b)
SELECT sample_id, frame, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS name FROM n""",
}
