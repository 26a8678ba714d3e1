"""Technique mapping: every detector emits (technique, confidence), the
largest confidence per sample and technique counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V
from triagelake.operators.effects import any_in
from triagelake.operators.rules import from_summary, risky_powershell, suspicious_command, suspicious_registry


def _start_artefact(t: Column) -> Column:
    return any_in(t, V.STARTUP_FILES) | t.contains("startup") | t.contains(".mnl") | t.rlike(V.STARTUP_PATTERN)


def _pairs(*pairs: tuple[Column, list[tuple[str, float]]]) -> Column:
    """Array of (technique, confidence) of the conditions that hold."""
    each = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(t).alias("technique"), F.lit(x).alias("confidence"))) for c, out in pairs for t, x in out]
    return F.array_compact(F.array(*each))


def effect_observations(effects: DataFrame) -> DataFrame:
    """What single effects show."""
    k, t, s = F.col("effect_type"), F.lower("target"), F.lower("source")
    concrete = ~from_summary()
    write, process, com = k == "file_write", k == "process_create", k.isin("com_create", "com_invoke")
    start_file = (k.isin("file_write", "file_read")) & (
        _start_artefact(t)
        | any_in(t, ("*.lsp", "*.fas", "*.mnl", "acaddoc"))
        | (t.contains("acad") & any_in(t, ("new", "old")))
        | any_in(s, ("vl-directory-files", "newacad", "oldacad", "acaddoc"))
    )
    net = (k == "network_connect") & concrete
    load = (k == "file_read") & (s == "load")
    benign_app = any_in(t, V.BENIGN_APPLICATIONS)
    # ordinary use of the host's own objects is left out
    internal = s.startswith("vla-") | s.startswith("vlax-get") | s.startswith("vlax-ename->vla") | s.contains("vl-load-com") | any_in(
        t, ("gettextstring", "insertionpoint", "effectivename", "addline", "addcircle", "addtext", "addmtext", "get", "put", "invoke")
    )
    foreign = com & concrete & ~internal
    kind = (
        F.when(any_in(t, ("wscript.shell", "shell.application")), "shell")
        .when(any_in(t, ("xmlhttp", "msxml")), "xmlhttp")
        .when(t.contains("adodb"), "adodb")
        .when(any_in(t, ("vbscript", "scriptlet")), "script")
        .when(t.contains("filesystemobject"), "fso")
        .when(any_in(t, ("wbemscripting", "swbemlocator")), "wmi")
        .when(k == "com_invoke", F.when(any_in(t, ("insertlines", "codemodule", "addfromstring")), "inject").otherwise("none"))
        .when((t != "") & ~(s.contains("vlax-") & ~s.contains("vlax-create-object") & any_in(t, ("ent", "obj"))), "other")
        .otherwise("none")
    )
    shell_kind = (
        F.when(any_in(t, ("rundll32", "setupapi", "installhinfsection")), "proxy")
        .when(t.contains("regsvr32"), "regsvr")
        .when(any_in(t, ("cmd.exe", "wscript")), "cmd")
        .when(t.contains("powershell"), F.when(risky_powershell(t), "ps").otherwise("ps-benign"))
        .when(benign_app, "app")
        .otherwise("os")
    )
    found = _pairs(
        (start_file, [("T1547.001", 0.95)]),
        (s.contains("vlr-"), [("T1543", 0.88), ("T1547.001", 0.82)]),
        (net & ~t.rlike("^https?://"), [("T1071.001", 0.88)]),
        (net & t.rlike("^https?://"), [("T1071.001", 0.93)]),
        (load, [("T1059.007", 0.30)]),
        (load & _start_artefact(t), [("T1059.007", 0.78), ("T1547.001", 0.72)]),
        (process & concrete & benign_app, [("T1059.007", 0.35)]),
        (process & concrete & ~benign_app & suspicious_command(t), [("T1059.007", 0.95)]),
        (process & concrete & ~benign_app & ~suspicious_command(t), [("T1059.007", 0.40)]),
        (k.isin("registry_modify", "registry_delete") & suspicious_registry(t), [("T1112", 0.90)]),
        (foreign & (kind == "shell"), [("T1059.003", 0.95), ("T1106", 0.90)]),
        (foreign & (kind == "xmlhttp"), [("T1071.001", 0.55), ("T1106", 0.55)]),
        (foreign & (kind == "adodb"), [("T1105", 0.90)]),
        (foreign & (kind == "script"), [("T1059.005", 0.93)]),
        (foreign & (kind == "fso"), [("T1106", 0.75)]),
        (foreign & (kind == "wmi"), [("T1082", 0.85)]),
        (foreign & (kind == "inject"), [("T1055", 0.95), ("T1547.001", 0.90)]),
        (foreign & (kind == "other"), [("T1106", 0.50)]),
        (process & (shell_kind == "proxy"), [("T1218.010", 0.99)]),
        (process & (shell_kind == "regsvr"), [("T1218.010", 0.95), ("T1112", 0.90)]),
        (process & (shell_kind == "cmd"), [("T1059.003", 0.92)]),
        (process & (shell_kind == "ps"), [("T1059.003", 0.90)]),
        (process & (shell_kind == "ps-benign"), [("T1059.003", 0.35)]),
        (process & (shell_kind == "app"), [("T1059.003", 0.30)]),
        (process & (shell_kind == "os"), [("T1059.003", 0.80)]),
        (k == "command_hijack", [("T1569", 0.95)]),
    )
    return effects.select(
        "sample_id", F.explode_outer(found).alias("o"), start_file.alias("start_file"), s.contains("vlr-").alias("reactor"), net.alias("net"),
        ((write & concrete) | (process & concrete & suspicious_command(t))).alias("acts"),
        (foreign & (kind == "xmlhttp")).alias("xmlhttp"), (foreign & kind.isin("adodb", "shell")).alias("stages"),
        any_in(s, ("wbemscripting", "swbemlocator")).alias("mac"), F.when(k == "command_hijack", t).alias("hijacked"),
    )


def node_observations(nodes: DataFrame) -> DataFrame:
    """What single top-level nodes show."""
    op, text, name = F.col("op"), F.col("text"), F.lower("name")
    first = F.lower(F.when(F.get("args", 0).kind == "text", F.get("args", 0).text).otherwise(""))
    load, defun = op == "LOAD", op == "DEFUN"
    remote = (first != "") & (first.rlike(r"^(https?://|ftp://|//|\\\\)") | first.contains("://"))
    local = (first != "") & ~remote & (first.rlike(r"\.(lsp|fas|vlx|mnl|dcl)$") | first.rlike(r"[\\/]") | first.rlike(r"^[A-Za-z0-9_-]+$"))
    starts = _start_artefact(first)
    command = F.when(defun & name.startswith("c:"), F.substring(name, 3, 1_000))
    found = _pairs(
        (any_in(text, ("acad.mnl", "acaddoc")) | text.rlike(V.STARTUP_PATTERN), [("T1547.001", 0.82)]),
        (defun & name.contains("startup"), [("T1547.001", 0.85)]),
        (op == "EVAL", [("T1059.007", 0.90)]),
        (load & remote, [("T1059.007", 0.85)]),
        (load & local & ~starts, [("T1059.007", 0.30)]),
        (load & local & starts, [("T1059.007", 0.78), ("T1547.001", 0.72)]),
        (load & ~remote & ~local, [("T1059.007", 0.20)]),
        (command.isin(*V.CRITICAL_COMMANDS), [("T1548.001", 0.95), ("T1569", 0.95)]),
    )
    cdate = text.contains("cdate")
    return nodes.select(
        "sample_id", F.explode_outer(found).alias("o"), (defun & name.contains("startup")).alias("hook"), (op == "EVAL").alias("eval"), (load & remote).alias("remote"),
        (op == "STRING_DECODE").alias("decode"), F.lower("fn").contains("macaddr").alias("mac"), (op.isin("SETQ", "SETVAR", "IF", "COND") & cdate).alias("dated"),
        (op.isin("IF", "COND") & text.rlike("20[0-2][0-9]")).alias("compared"), command.alias("command"), "seq",
    )


def techniques(effects: DataFrame, nodes: DataFrame, named_only: bool = False) -> DataFrame:
    """``(sample_id, technique, confidence)``, the largest of all detectors."""
    e, n = effect_observations(effects), node_observations(nodes)
    single = e.where("o is not null").select("sample_id", "o.*").unionByName(n.where("o is not null").select("sample_id", "o.*"))
    b = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    ef = e.groupBy("sample_id").agg(*map(b, ("start_file", "reactor", "net", "acts", "xmlhttp", "stages", "mac")), F.collect_set("hijacked").alias("hijacked"))
    nf = n.groupBy("sample_id").agg(
        *map(b, ("hook", "eval", "remote", "dated", "compared")), F.coalesce(F.bool_or("mac"), F.lit(False)).alias("node_mac"),
        F.count_distinct(F.when(F.col("decode"), F.col("seq"))).alias("decodes"), F.collect_set("command").alias("commands"),
    )
    flags = ef.join(nf, "sample_id", "full").fillna(False).fillna(0, ["decodes"])
    c = F.col
    mac = c("mac") | c("node_mac")
    redirected = F.coalesce(F.arrays_overlap("commands", "hijacked"), F.lit(False))
    combined = _pairs(
        ((c("hook") | c("reactor")) & c("start_file"), [("T1547.001", 1.0)]),
        (c("net") & c("acts"), [("T1105", 0.86)]),
        (c("eval") & c("remote"), [("T1059.007", 1.0)]),
        (c("decodes") > 3, [("T1140", 0.85)]),
        (c("decodes") > 10, [("T1027", 0.90)]),
        (c("xmlhttp") & c("stages"), [("T1105", 0.95)]),
        (mac, [("T1082", 0.85)]),
        (mac & c("dated"), [("T1497.001", 0.90)]),
        (mac & ~c("dated") & c("compared"), [("T1497.001", 0.85)]),
        (c("dated") & ~mac, [("T1497.001", 0.70)]),
        (redirected, [("T1548.001", 0.95), ("T1569", 0.95)]),
    )
    both = single.unionByName(flags.select("sample_id", F.explode(combined).alias("o")).select("sample_id", "o.*"))
    best = both.groupBy("sample_id", "technique").agg(F.max("confidence").alias("confidence"))
    return best.where(F.col("technique").isin(*[t[0] for t in V.TECHNIQUES])) if named_only else best


def technique_weight(technique: Column) -> Column:
    table = F.create_map(*[x for t, _, w in V.TECHNIQUES for x in (F.lit(t), F.lit(w))])
    return F.coalesce(F.try_element_at(table, technique), F.lit(V.DEFAULT_TECHNIQUE_WEIGHT))


def technique_risk(found: DataFrame) -> DataFrame:
    """Weighted mean confidence per sample; unnamed techniques count too."""
    w = technique_weight(F.col("technique"))
    return found.groupBy("sample_id").agg(F.least(F.sum(w * F.col("confidence")) / F.sum(w), F.lit(1.0)).alias("attack_risk"))
