"""Detection rules as boolean aggregates: one shuffle for all rules.

Each rule is a predicate over flags and counts of a sample's effects; the
flags of all rules come from a single aggregation by sample, so the work is
one partial and one final aggregate whatever the number of rules.  Rules over
the text of top-level nodes are a second aggregate over the node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import vocabulary as V
from triagelake.operators.effects import any_in, startup_target


def suspicious_registry(path: Column) -> Column:
    return any_in(F.lower(F.trim(path)), V.SUSPICIOUS_REGISTRY)


def risky_powershell(command: Column) -> Column:
    c = F.lower(F.trim(command))
    hidden = c.contains("-executionpolicy bypass") | c.contains("-windowstyle hidden")
    return c.contains("powershell") & (any_in(c, V.POWERSHELL_RISKS) | hidden & any_in(c, (".ps1", "start-process", "cmd.exe")))


def suspicious_command(command: Column) -> Column:
    c = F.lower(F.trim(command))
    return any_in(c, V.SUSPICIOUS_COMMANDS) | risky_powershell(command)


def payload_target(target: Column) -> Column:
    t = F.lower(F.trim(target))
    short = (F.length(t) <= 3) & ~any_in(t, (".", "\\", "/"))
    noise = t.isin(*V.NOISE_TARGETS) | t.rlike("^(sym_|fn_|block_)") | short
    return F.when(t == "", False).when(startup_target(t), True).when(noise, False).otherwise(any_in(t, V.PAYLOAD_PATHS) | any_in(t, V.PAYLOAD_ENDINGS))


def _meta(name: str) -> Column:
    return F.coalesce(F.try_element_at("meta", F.lit(name)), F.lit(""))


def from_summary() -> Column:
    """Effect made of a recovered resource summary, not of code."""
    return (_meta("recovered_from") == "resource_summary") | F.coalesce(F.map_contains_key("meta", "summary_field"), F.lit(False))


def downloaded_hint() -> Column:
    content, t = F.lower(F.trim(_meta("content"))), F.lower(F.trim("target"))
    return content.rlike("^https?://") | (_meta("inferred_from") == "unknown_call_args") & t.rlike(r"\.(dcl|lsp|fas)$")


def dropper_write() -> Column:
    t, s = F.lower("target"), F.lower("source")
    concrete = (
        (F.col("effect_type") == "file_write")
        & (payload_target(t) | payload_target(s) | downloaded_hint())
        & (~from_summary() | startup_target(t) | payload_target(t))
    )
    script = any_in(F.concat_ws(" ", t, s), V.PAYLOAD_ENDINGS + V.SCRIPT_ENDINGS)
    return concrete & (startup_target(t) | startup_target(s) | script | downloaded_hint())


def effect_flags(effects: DataFrame, key: str = "sample_id") -> DataFrame:
    """Flags and counts of all effect rules, one row per sample."""
    k, t, s = F.col("effect_type"), F.lower("target"), F.lower("source")
    text = F.concat_ws(" ", s, t)
    write, read, com = k == "file_write", k == "file_read", k.isin("com_create", "com_invoke")
    network, process, registry = k == "network_connect", k == "process_create", k == "registry_modify"
    concrete = ~from_summary()
    xmlhttp, adodb = any_in(text, ("xmlhttp", "msxml")), any_in(text, ("adodb.stream", "adodb.connection"))
    shell = any_in(text, ("shell.application", "wscript.shell"))
    url_shape = t.contains("?") | t.contains("%")
    fas_mark = any_in(t, ("acaddoc.fas", "acad.fas")) | t.contains(";;") & t.contains(".fas")
    low_source = F.col("source").isin("goto", "push-symbol", "push-token", "recovered_fas_module", "__toplevel__") | s.rlike("^(fn_|sym_|block_)")
    artefact = startup_target(F.col("target")) | startup_target(F.col("source"))
    text_artefact = startup_target(text) | text.contains("acaddoc")
    flags = {
        "start_write": write & (startup_target(t) | fas_mark),
        "copies": s.contains("vl-file-copy") | (F.col("source") == "writelsp"),
        "wildcard": (write & any_in(t, ("*.lsp", "*.fas", "*.mnl"))) | (s.contains("vl-directory-files") & any_in(t, (".lsp", ".fas"))),
        "start_var": write & ((t.contains("acad") & any_in(t, ("new", "old"))) | any_in(s, ("newacad", "oldacad", "acaddoc"))),
        "fas_comment": write & t.contains(";;") & t.contains(".fas"),
        "hide": k.isin("file_hidden", "registry_modify") & t.contains("hide"),
        "persist": write & any_in(t, ("startup", "acaddoc")),
        "env": k == "env_check",
        "timed": any_in(s, ("time", "date")),
        "com_xmlhttp": com & xmlhttp & concrete,
        "com_adodb": com & adodb & concrete,
        "com_shell": com & shell & concrete,
        "network": network,
        "network_concrete": network & concrete,
        "url_shape": network & url_shape,
        "drop": dropper_write(),
        "exec": process & suspicious_command(F.col("target")),
        "inject": (k == "com_invoke") & (any_in(text, ("insertlines", "addfromstring")) | s.contains("vlax-invoke")),
        "vbproject": com & (any_in(text, ("vbproject", "codemodule")) | s.contains("vlax-get")),
        "acaddoc": text.contains("acaddoc"),
        "spreads": (write | read) & any_in(s, ("vl-file-copy", "vlax-invoke")),
        "copy_func": (write & any_in(s, ("app", "copy", "open", "write"))) | (read & any_in(s, ("app", "copy", "read"))),
        "source_target": write & t.isin("source", "target"),
        "erase_all": k.isin("command_hijack", "process_create") & t.contains("erase") & t.contains("all"),
        "erase": k.isin("command_hijack", "process_create") & any_in(t, ("erase", "delete")),
        "backup": write & any_in(t, (".bak", "backup", "ja", "universidad")),
        "listing": s.contains("directory") | t.contains("vl-directory-files") | any_in(t, ("*.lsp", "*.mnl")),
        "infects": (write | read) & any_in(s, ("app", "nth", "strcat")),
        "start_load": read & (s == "load") & startup_target(t),
        "script_control": com & text.contains("scriptcontrol"),
        "any_adodb": com & adodb,
        "wsf": write & any_in(text, (".wsf",)),
        "wsh_settings": registry & any_in(text, ("windows script host\\settings", "windows script host/settings")),
        "infect_artefact": any_in(t, ("acadisa.lin", "base.dcl", "acad.lsp", "acaddoc")),
        "reactor": k.isin("com_invoke", "env_check") & any_in(text, ("reactor", "vlr-")),
        "file_findfile": (write | read) & text.contains("findfile"),
        "file_copy": (write | read) & text.contains("vl-file-copy"),
        "file_artefact": (write | read) & (artefact | any_in(text, ("acaddoc", "acad.lsp"))),
        "recovered": text.contains("recovered_fas_module"),
        "read_findfile": read & text.contains("findfile"),
        "write_copy": write & text.contains("vl-file-copy"),
        "any_artefact": text_artefact | artefact,
        "copy_artefact": any_in(text, ("helper-dwgprefix", "modemacro", "&{symbol afas")) | text_artefact,
        "low_source": network & low_source,
    }
    counts = {
        "n_start_write": write & startup_target(t),
        "n_fas_mark": write & fas_mark,
        "n_write": write,
        "n_read": read,
        "n_hijack": k == "command_hijack",
        "n_http": network & t.rlike("^https?://"),
        "n_registry": registry & suspicious_registry(F.col("target")),
        "n_exec": process & suspicious_command(F.col("target")),
    }
    undefined = F.collect_set(F.when(k == "command_undefine", F.col("target")))
    redefined = F.collect_set(F.when((write | (k == "com_create")) & s.startswith("defun") & t.startswith("c:"), F.substring(t, 3, 1_000)))
    return effects.groupBy(key).agg(
        *[F.coalesce(F.bool_or(v), F.lit(False)).alias(n) for n, v in flags.items()],
        *[F.count_if(v).alias(n) for n, v in counts.items()],
        F.arrays_overlap(undefined, redefined).alias("redefined"),
    )


def effect_rules() -> dict[str, Column]:
    """The predicate of each rule over the flags."""
    c = F.col
    starts = c("n_start_write") + c("n_fas_mark")
    pays = c("drop") | c("exec")
    return {
        "WORM_001": (c("start_write") & c("copies"))
        | (starts >= 2)
        | (c("start_write") & (c("n_read") > 0) & (c("n_write") >= 2))
        | (c("wildcard") & (c("n_write") >= 2))
        | (c("start_var") & (c("n_write") >= 2) & (c("n_read") > 0))
        | ((starts >= 1) & (c("n_write") >= 2) & c("fas_comment")),
        "HIJACK_001": F.coalesce(c("redefined"), F.lit(False)),
        "STEALTH_001": c("hide") & c("persist"),
        "ENVAWARE_001": c("env") & c("timed"),
        "NETWORK_001": (c("com_xmlhttp") & c("network") & (pays | (c("com_shell") & c("url_shape"))))
        | (c("network_concrete") & (pays | (c("com_adodb") & c("com_shell") & c("url_shape")))),
        "VBA_INJECT_001": (c("inject") & c("acaddoc")) | (c("vbproject") & c("spreads")) | (c("acaddoc") & c("spreads")),
        "WORM_REPL_001": (c("copy_func") & (c("n_hijack") >= 3))
        | (c("source_target") & (c("n_write") >= 2) & (c("n_read") >= 1))
        | ((c("n_write") >= 2) & (c("n_read") >= 1) & (c("n_hijack") >= 2))
        | (c("copy_func") & c("acaddoc")),
        "DESTRUCT_001": c("erase_all") | c("backup") | c("erase"),
        "DIR_TRAV_001": c("listing") & c("infects"),
        "STARTUP_LOAD_001": c("start_load"),
        "NET_DROPPER_001": c("network_concrete") & c("drop"),
        "PROC_EXEC_001": c("exec"),
        "COM_DROPPER_001": (c("com_xmlhttp") & c("com_adodb") & pays)
        | (c("com_adodb") & c("com_shell") & pays)
        | (c("com_xmlhttp") & c("com_shell") & pays)
        | (c("com_xmlhttp") & c("exec"))
        | (c("network_concrete") & c("com_adodb") & pays),
        "SCRIPTCTRL_001": c("script_control") & (c("any_adodb") | c("wsf") | c("wsh_settings")),
        "STARTUP_INFECT_001": c("infect_artefact") & (c("n_read") + c("n_write") >= 8),
        "REACT_PROP_001": c("reactor") & c("file_copy") & (c("file_findfile") | c("file_artefact")),
        "REC_FAS_PROP_001": c("recovered") & c("read_findfile") & c("write_copy") & c("any_artefact"),
        "FINDCOPY_001": c("read_findfile") & c("write_copy") & c("copy_artefact"),
        "NET_STUB_001": (c("n_http") <= 8) & c("network_concrete") & c("low_source") & ((c("n_http") >= 2) | ((c("n_http") >= 1) & c("url_shape"))),
    }


def node_flags(nodes: DataFrame, key: str = "sample_id") -> DataFrame:
    """Flags of the rules over text; ``nodes(sample_id, op, fn, name, text)``
    has the top-level nodes with their whole text in lower case."""
    fn, text = F.lower("fn"), F.col("text")
    args = F.substring(text, F.length("fn") + 2, F.lit(1 << 30))
    start_words = any_in(args, ("s::startup", "acaddoc", "acad.lsp", "acadlspasdoc"))
    has = lambda *w: F.coalesce(F.bool_or(any_in(text, w)), F.lit(False))
    both = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return nodes.groupBy(key).agg(
        both((F.col("op") == "DEFUN") & F.lower("name").contains("startup") | any_in(fn, ("vlr-", "reactor")) & start_words | (fn == "setvar") & args.contains("acadlspasdoc")).alias("hook"),
        both(text.contains("vl-file-copy") & text.contains("findfile") & any_in(text, ("acad.vlx", "acad.mnl", "acad.lsp", "acaddoc", "ai_utils.lsp"))).alias("copy_string"),
        has("boot.dat").alias("boot"),
        has("vbarun").alias("vbarun"),
        has("acaddoc", "base.dcl", "cadhelp.jpg", "acad.bak", "beifen.bak").alias("boot_ref"),
        has("acad.lsp", "acaddoc.lsp", "acadisa.lin").alias("x_artefact"),
        has("acad.lsp").alias("x_acad"),
        has("acadisa.lin").alias("x_lin"),
        has("open").alias("x_open"),
        has("read-line").alias("x_read"),
        has("write-line").alias("x_write"),
        has("writeapp").alias("x_writeapp"),
        has("findfile").alias("x_findfile"),
        has("bashupload.com").alias("x_upload"),
        has("winhttp.winhttprequest.5.1").alias("x_winhttp"),
        has("adodb.stream").alias("x_adodb"),
        has("post", "application/octet-stream").alias("x_post"),
        has("vl-file-delete", "vla-delete").alias("x_delete"),
        has("*nuclear*", "*reactor*", "*power*").alias("x_select"),
        has("wcmatch").alias("x_wcmatch"),
        has("dwgname").alias("x_dwgname"),
        has("vla-get-modelspace", "vla-get-layers", "objectname").alias("x_model"),
        F.count_if(F.col("op") == "STRING_DECODE").alias("n_decode"),
    )


def node_rules() -> dict[str, Column]:
    c = F.col
    return {
        "STARTUP_HOOK_001": c("hook"),
        "STARTUP_COPY_STR_001": c("copy_string"),
        "BOOTDAT_CHAIN_001": c("boot") & (c("vbarun") | c("boot_ref")),
        "STARTUP_REWRITE_001": c("x_artefact") & c("x_open") & c("x_read") & c("x_write") & (c("x_writeapp") | (c("x_findfile") & c("x_acad") & c("x_lin"))),
        "EXFIL_STUB_001": c("x_upload") | (c("x_winhttp") & c("x_adodb") & c("x_post")),
        "DESTRUCT_STUB_001": c("x_delete") & (c("x_select") | (c("x_wcmatch") & c("x_dwgname"))) & c("x_model"),
    }


def _hits(flags: DataFrame, rules: dict[str, Column], key: str, repeated: dict[str, str]) -> DataFrame:
    info = {r: (n, s) for r, n, s in V.RULES}
    each = [
        F.struct(F.lit(r).alias("rule_id"), F.lit(info[r][0]).alias("name"), F.lit(info[r][1]).alias("severity"), F.when(p, 1).otherwise(0).cast("bigint").alias("hits"))
        for r, p in rules.items()
    ]
    each += [F.struct(F.lit(r).alias("rule_id"), F.lit(info[r][0]).alias("name"), F.lit(info[r][1]).alias("severity"), F.col(n).alias("hits")) for r, n in repeated.items()]
    return flags.select(key, F.explode(F.array(*each)).alias("h")).select(key, "h.*").where("hits > 0")


def rule_hits(effects: DataFrame, nodes: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """``(sample_id, rule_id, name, severity, hits)``; two rules hit once per
    effect, the others once."""
    out = _hits(effect_flags(effects, key), effect_rules(), key, {"REGISTRY_001": "n_registry", "CMD_EXEC_001": "n_exec"})
    if nodes is not None:
        out = out.unionByName(_hits(node_flags(nodes, key), node_rules(), key, {}))
    return out


def top_nodes(facts: DataFrame) -> DataFrame:
    """Top-level nodes of a fact table, with the name that a defun defines."""
    first = F.get("args", 0)
    return facts.where("fact = 'node' and depth = 0").select(
        "sample_id", "seq", F.col("name").alias("op"), "fn", F.when(first.kind == "text", first.text).alias("name"), F.col("source").alias("text"), "args", "line"
    )
