"""Definitions, uses, calls, functions and imports from syntax nodes, and the analyses that start from source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks, text
from ..lineage import cut
from . import taint

#: Taint settings for Python: what brings data in, what must not get it, and what makes it safe.
PYTHON_TAINT = {
    "sources": [{"pattern": p} for p in ("request.args", "request.form", "request.json", "request.data", "request.GET", "request.POST", "input(", "sys.argv", "os.environ")],
    "sinks": [
        {"function": "execute", "vulnerability": "sql-injection", "tainted_args": [0]}, {"function": "executemany", "vulnerability": "sql-injection", "tainted_args": [0]}, {"function": "raw", "vulnerability": "sql-injection", "tainted_args": [0]},
        {"function": "os.system", "vulnerability": "command-injection", "tainted_args": [0]}, {"function": "os.popen", "vulnerability": "command-injection", "tainted_args": [0]}, {"function": "subprocess.run", "vulnerability": "command-injection", "tainted_args": [0]},
        {"function": "subprocess.call", "vulnerability": "command-injection", "tainted_args": [0]}, {"function": "subprocess.Popen", "vulnerability": "command-injection", "tainted_args": [0]}, {"function": "eval", "vulnerability": "command-injection", "tainted_args": [0]},
        {"function": "open", "vulnerability": "path-traversal", "tainted_args": [0]}, {"function": "send_file", "vulnerability": "path-traversal", "tainted_args": [0]}, {"function": "requests.get", "vulnerability": "ssrf", "tainted_args": [0]},
        {"function": "requests.post", "vulnerability": "ssrf", "tainted_args": [0]}, {"function": "urlopen", "vulnerability": "ssrf", "tainted_args": [0]}, {"function": "render_template_string", "vulnerability": "xss", "tainted_args": [0]}, {"function": "Markup", "vulnerability": "xss", "tainted_args": [0]},
    ],
    "sanitizers": [{"function": f} for f in ("escape(", "quote(", "int(", "float(", "secure_filename(", "sanitize")],
}


def owned(nodes: DataFrame) -> DataFrame:
    """Nodes with fn, the key (path::name::line) of the outermost function around them."""
    functions = nodes.where("kind = 'function_definition'")
    outer = functions.select(F.col("path").alias("o_path"), F.col("node_id").alias("o_id"), F.col("path_from_root").alias("o_root"))
    inner = outer.join(functions.select(F.col("path").alias("o_path"), F.col("node_id").alias("i_id")), "o_path").where((F.col("i_id") != F.col("o_id")) & F.array_contains("o_root", F.col("i_id"))).select("o_path", "o_id")
    outer = outer.join(inner, ["o_path", "o_id"], "left_anti").select("o_path", "o_id")
    names = nodes.where("field_name = 'name' AND kind = 'identifier'").select(F.col("path").alias("o_path"), F.col("parent_id").alias("o_id"), F.col("text").alias("o_name"))
    outer = outer.join(names, ["o_path", "o_id"]).select("o_path", "o_id", F.concat_ws("::", "o_path", "o_name").alias("fn"), "o_name")
    above = nodes.withColumn("_a", F.explode("path_from_root"))
    return above.join(outer, (F.col("path") == F.col("o_path")) & (F.col("_a") == F.col("o_id"))).drop("_a", "o_path")


def definitions(inside: DataFrame, settings: dict = PYTHON_TAINT) -> DataFrame:
    """path, fn, name, def_line, ord and state of assignments to plain names; a repeated one without a source is clean of the old value."""
    left = inside.where("field_name = 'left' AND kind = 'identifier'").select("path", "fn", F.col("parent_id").alias("a"), F.col("text").alias("name"))
    held = inside.where("kind IN ('assignment', 'augmented_assignment')").select("path", F.col("node_id").alias("a"), F.col("text").alias("declaration"), (F.col("start_row") + 1).alias("def_line"))
    state = taint.declared_state(F.col("declaration"), [s["pattern"] for s in settings["sources"]], [s["function"] for s in settings["sanitizers"]])
    return left.join(held, ["path", "a"]).select("path", "fn", "name", "def_line", F.col("a").cast("int").alias("ord"), state.alias("state"))


def uses(inside: DataFrame) -> DataFrame:
    """path, fn, name and use_line of names that are read."""
    read = inside.where("kind = 'identifier' AND coalesce(field_name, '') NOT IN ('left', 'name', 'attribute', 'alias')")
    return read.select("path", "fn", F.col("text").alias("name"), (F.col("start_row") + 1).alias("use_line")).distinct()


def calls(inside: DataFrame) -> DataFrame:
    """call_id, path, fn, callee, line, args (texts, in order) and receiver (the name that takes the result)."""
    made = inside.where("kind = 'call'").select("path", "fn", F.col("node_id").alias("c"), (F.col("start_row") + 1).alias("line"), "parent_id", "field_name")
    callee = inside.where("field_name = 'function'").select("path", F.col("parent_id").alias("c"), F.col("text").alias("callee"))
    lists = inside.where("kind = 'argument_list' AND field_name = 'arguments'").select("path", F.col("parent_id").alias("c"), F.col("node_id").alias("l"))
    each = inside.where("is_named AND kind != 'keyword_argument'").select("path", F.col("parent_id").alias("l"), "ordinal", "text")
    args = lists.join(each, ["path", "l"]).groupBy("path", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("args"))
    taken = inside.where("field_name = 'left' AND kind = 'identifier'").select("path", F.col("parent_id"), F.col("text").alias("receiver"))
    out = made.join(callee, ["path", "c"]).join(args, ["path", "c"], "left").join(taken, ["path", "parent_id"], "left")
    return out.select(F.concat_ws(":", "path", F.col("c").cast("string")).alias("call_id"), "path", "fn", "callee", "line", F.coalesce("args", F.array().cast("array<string>")).alias("args"), F.when(F.col("field_name") == "right", F.col("receiver")).alias("receiver"))


def functions(inside: DataFrame) -> DataFrame:
    """key, path, name, line and params of outermost functions."""
    made = inside.where("node_id = o_id").select("path", "fn", F.col("o_name").alias("name"), (F.col("start_row") + 1).alias("line"), F.col("node_id").alias("f"))
    lists = inside.where("kind = 'parameters'").select("path", F.col("parent_id").alias("f"), F.col("node_id").alias("p"))
    plain = inside.where("kind = 'identifier'").select("path", F.col("parent_id").alias("p"), "ordinal", "text")
    around = inside.where("kind IN ('default_parameter', 'typed_parameter')").select("path", F.col("parent_id").alias("p"), "ordinal", F.regexp_extract("text", r"^([^\s:=]+)", 1).alias("text"))
    named = lists.join(plain.unionByName(around), ["path", "p"]).groupBy("path", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("params"))
    out = made.join(named, ["path", "f"], "left").select(F.col("fn").alias("key"), "path", "name", "line", F.coalesce("params", F.array().cast("array<string>")).alias("params"))
    return out.groupBy("key").agg(F.max_by(F.struct("path", "name", "line", "params"), "line").alias("x")).select("key", "x.*")


def imports(nodes: DataFrame) -> DataFrame:
    """path, local_name, module and exported_name of from-imports."""
    held = nodes.where("kind = 'import_from_statement'").select("path", F.col("node_id").alias("i"))
    module = nodes.where("field_name = 'module_name'").select("path", F.col("parent_id").alias("i"), F.col("text").alias("module"))
    names = nodes.where("kind IN ('dotted_name', 'aliased_import') AND field_name = 'name'").select("path", F.col("parent_id").alias("i"), "text")
    plain, other = F.regexp_extract("text", r"^(\S+)", 1), F.regexp_extract("text", r"\sas\s+(\S+)$", 1)
    return held.join(module, ["path", "i"]).join(names, ["path", "i"]).select("path", F.when(other == "", plain).otherwise(other).alias("local_name"), "module", plain.alias("exported_name"))


def _finding(rows: DataFrame, files: DataFrame, level: str, tool: str) -> DataFrame:
    rule = F.concat(F.lit(f"{tool}/{level.lower()}/"), F.col("vulnerability"))
    shown = rows.join(files.select("path", F.col("text").alias("source")), "path").withColumn("snippet", text.context(F.col("source"), F.col("line")))
    kind: Column = ranks.vulnerability_severity(F.col("vulnerability"))
    return shown.select(text.fingerprint(rule, F.col("path"), F.col("snippet")).alias("fingerprint"), rule.alias("rule_id"), kind.alias("severity"), F.lit("medium").alias("confidence"), F.lit("security").alias("category"), text.normal_path(F.col("path")).alias("file_path"), F.col("line").alias("start_line"), F.lit(0).alias("start_col"), "snippet", "variable")


def flow_findings(files: DataFrame, nodes: DataFrame, sinks: DataFrame, settings: dict = PYTHON_TAINT, tool: str = "sieve") -> DataFrame:
    """Findings of taint that reaches a sink within a function."""
    inside = cut(owned(nodes))
    defs = taint.propagate(definitions(inside, settings), uses(inside))
    return _finding(taint.tainted_sinks(calls(inside), sinks, uses(inside), defs), files, "L2", tool)


def cross_file_findings(files: DataFrame, nodes: DataFrame, sinks: DataFrame, settings: dict = PYTHON_TAINT, tool: str = "sieve", most: int = taint.MOST_CALLS) -> DataFrame:
    """Findings of taint that reaches a sink over calls, within and across files."""
    inside = cut(owned(nodes))
    known = functions(inside)
    found = taint.resolve_imports(imports(nodes), files)
    linked = cut(taint.resolve_calls(calls(inside), known, found))
    rows = taint.cross_call_taint(linked, known, definitions(inside, settings), uses(inside), sinks, most)
    where = rows.groupBy("fn", "line", "vulnerability", "variable").agg(F.min("depth").alias("depth"))
    return _finding(where.join(known.select(F.col("key").alias("fn"), "path"), "fn"), files, "L3", tool)
