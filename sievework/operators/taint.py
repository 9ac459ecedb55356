"""Data flow: reaching definitions, taint within a function, call resolution and taint across calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import cut

MOST_ROUNDS, MOST_CALLS = 100, 5
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js")


def reaching_definitions(uses: DataFrame, defs: DataFrame, keys: tuple[str, ...] = ("path", "fn", "name")) -> DataFrame:
    """Each use with the state and line of the last definition at or before its line; of one line's the last by ``ord``.

    Both sides meet in one sorted pass over their union, so a name with many definitions and uses isn't
    multiplied; uses without a definition have nulls.
    """
    a = defs.select(*keys, F.col("def_line").alias("line"), F.lit(0).alias("side"), F.col("ord"), F.struct("def_line", "ord", "state").alias("d"), F.lit(None).cast("long").alias("use_id"))
    b = uses.select(*keys, F.col("use_line").alias("line"), F.lit(1).alias("side"), F.lit(0).alias("ord"), F.lit(None).cast(a.schema["d"].dataType).alias("d"), F.col("use_id").cast("long"))
    order = Window.partitionBy(*keys).orderBy("line", "side", "ord").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("d", F.last("d", ignorenulls=True).over(order)).where("side = 1")
    return both.select("use_id", *keys, F.col("line").alias("use_line"), "d.def_line", "d.state")


def earliest_tainted(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Each use with the earliest tainted definition at or before its line."""
    first = defs.where("state = 'tainted'").groupBy("path", "fn", "name").agg(F.min("def_line").alias("tainted_line"))
    return uses.join(first, ["path", "fn", "name"]).where("tainted_line <= use_line")


def propagate(defs: DataFrame, uses: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """defs (path, fn, name, def_line, ord, state) with the states at the fix-point.

    A use whose reaching definition is tainted taints the unknown definitions on its line that come after
    that definition; clean ones stop it. Every round works on all functions at once.
    """
    uses = uses.select("path", "fn", "name", "use_line", F.monotonically_increasing_id().alias("use_id"))
    uses, defs = cut(uses), cut(defs)
    for _ in range(rounds):
        carried = reaching_definitions(uses, defs).where("state = 'tainted'").select("path", "fn", F.col("use_line").alias("at"), "def_line").groupBy("path", "fn", "at").agg(F.min("def_line").alias("since"))
        hit = (F.col("state") == "unknown") & F.col("since").isNotNull() & (F.col("def_line") > F.col("since"))
        joined = defs.join(carried.withColumnRenamed("at", "def_line"), ["path", "fn", "def_line"], "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
        joined = cut(joined)
        if joined.where("hit").isEmpty():
            break
        defs = joined.select("path", "fn", "name", "def_line", "ord", F.when(F.col("hit"), "tainted").otherwise(F.col("state")).alias("state"))
    return defs


def declared_state(declaration: Column, sources: list[str], sanitizers: list[str]) -> Column:
    """clean if the text holds a sanitizer, else tainted if it holds a source, else unknown."""
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(declaration, w)) if words else F.lit(False)
    return F.when(holds(sanitizers), "clean").when(holds(sources), "tainted").otherwise("unknown")


def sink_calls(calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """Calls (call_id, callee, ...) of a sink (ordinal, function, vulnerability, tainted_args): equal, or ending in ``.function``; the first in order.

    Names are cut at their dots into all their endings, so this is an equi-join.
    """
    parts = F.split("callee", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    rows = calls.withColumn("ending", F.explode(endings)).join(sinks.withColumnRenamed("function", "ending"), "ending")
    first = rows.groupBy("call_id").agg(F.min("ordinal").alias("ordinal"))
    return calls.join(first, "call_id").join(sinks, "ordinal")


def tainted_sinks(calls: DataFrame, sinks: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Sink calls with an argument, at a place that the sink names, that is a variable with a tainted reaching definition.

    calls: call_id, path, fn, callee, line, args (texts).
    """
    rows = sink_calls(calls, sinks).select("call_id", "path", "fn", "callee", "line", "vulnerability", "tainted_args", F.posexplode("args").alias("place", "name"))
    rows = rows.where(F.array_contains("tainted_args", F.col("place"))).withColumn("use_id", F.monotonically_increasing_id())
    rows = cut(rows)
    found = reaching_definitions(rows.withColumnRenamed("line", "use_line"), defs).where("state = 'tainted'").select("use_id", "def_line")
    best = rows.join(found, "use_id").groupBy("call_id").agg(F.min(F.struct("place", "name", "def_line")).alias("b"))
    return calls.join(best, "call_id").join(rows.select("call_id", "vulnerability").distinct(), "call_id").select("call_id", "path", "fn", "callee", "line", "vulnerability", F.col("b.name").alias("variable"), F.col("b.def_line").alias("source_line"))


def clean_callee(name: Column) -> Column:
    return F.regexp_replace(name, r"^(this|self)\.", "")


def resolve_imports(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """Imports (path, local_name, module, exported_name) with the file they name: the first known candidate; others are dropped."""
    base = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("module"))
    start = F.when(F.startswith("module", F.lit(".")), text.resolved_path(base)).otherwise(F.replace("module", F.lit("."), F.lit("/")))
    tried = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(start, F.lit(e)).alias("target")) for k, e in enumerate(endings)])
    rows = imports.withColumn("c", F.explode(tried)).select(*imports.columns, "c.rank", "c.target")
    rows = rows.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return rows.groupBy(*imports.columns).agg(F.min_by("target", "rank").alias("target"))


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls (call_id, path, callee, ...) with callee_key: a function of the same file, else an imported one, else the first of that name by key.

    functions: key (file::name), path, name; imports: path, local_name, target, exported_name.
    """
    name = clean_callee(F.col("callee"))
    rows = calls.withColumn("n", name)
    own = functions.groupBy(F.col("path"), F.col("name").alias("n")).agg(F.min("key").alias("k1"))
    of = functions.select(F.col("path").alias("target"), F.col("name").alias("exported_name"), F.col("key").alias("k2"))
    named = imports.join(of, ["target", "exported_name"]).groupBy("path", F.col("local_name").alias("n")).agg(F.min("k2").alias("k2"))
    everywhere = functions.groupBy(F.col("name").alias("n")).agg(F.min("key").alias("k3"))
    rows = rows.join(own, ["path", "n"], "left").join(named, ["path", "n"], "left").join(everywhere, "n", "left")
    return rows.withColumn("callee_key", F.coalesce("k1", "k2", "k3")).drop("n", "k1", "k2", "k3")


def reachable(edges: DataFrame, starts: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """entry, node and depth: the fewest steps, up to ``most``, from each start (node) along edges (src, dst)."""
    edges = edges.select("src", "dst").distinct()
    seen = cut(starts.select(F.col("node").alias("entry"), "node", F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, most + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("entry", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("entry", "node"), ["entry", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def call_chains(edges: DataFrame, starts: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """entry, node, depth and the smallest chain of keys among the shortest."""
    seen = cut(starts.select(F.col("node").alias("entry"), "node", F.lit(0).alias("depth"), F.array("node").alias("chain")).distinct())
    front, edges = seen, edges.select("src", "dst").distinct()
    for depth in range(1, most + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("entry", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        step = step.groupBy("entry", "node").agg(F.min("chain").alias("chain"))
        front = cut(step.join(seen.select("entry", "node"), ["entry", "node"], "left_anti").select("entry", "node", F.lit(depth).alias("depth"), "chain"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def cross_call_taint(calls: DataFrame, functions: DataFrame, defs: DataFrame, uses: DataFrame, sinks: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """Sinks that taint reaches over 1 to ``most`` calls: entry, fn (both keys), depth, callee, line, vulnerability, variable.

    Entries are functions with a tainted definition. Each step gives the functions that are called with a
    tainted argument their parameter as tainted definition, and follows taint in them. calls: call_id,
    path, fn (a key), callee, callee_key, line, args; functions: key, params (names).
    """
    entries = defs.where("state = 'tainted'").select(F.col("fn").alias("entry"), "path").distinct()
    state = defs.join(entries.select(F.col("entry").alias("fn")).distinct(), "fn", "left_semi").withColumn("entry", F.col("fn"))
    seen = entries.select("entry", F.col("entry").alias("fn")).distinct()
    found = None
    for depth in range(most + 1):
        key = F.concat_ws("\x1f", "entry", "fn")
        own = propagate(state.select("path", key.alias("fn"), "name", "def_line", "ord", "state"), state.select("entry", "fn").distinct().join(uses, "fn").select("path", key.alias("fn"), "name", "use_line"))
        inside = state.select("entry", "fn").distinct().join(calls, "fn").select("call_id", "path", key.alias("fn"), "callee", "callee_key", "line", "args")
        if depth:
            hits = tainted_sinks(inside.withColumn("call_id", F.concat_ws("\x1f", F.col("fn"), F.col("call_id").cast("string"))), sinks, uses, own)
            hits = cut(hits.select(F.substring_index("fn", "\x1f", 1).alias("entry"), F.substring_index("fn", "\x1f", -1).alias("fn"), F.lit(depth).alias("depth"), "callee", "line", "vulnerability", "variable"))
            found = hits if found is None else found.unionByName(hits)
        if depth == most:
            break
        asked = inside.where("callee_key IS NOT NULL").select("path", "fn", "line", "callee_key", F.posexplode("args").alias("place", "name")).withColumn("use_id", F.monotonically_increasing_id())
        asked = cut(asked)
        tainted = reaching_definitions(asked.withColumnRenamed("line", "use_line"), own).where("state = 'tainted'").select("use_id")
        passed = asked.join(tainted, "use_id", "left_semi").select(F.substring_index("fn", "\x1f", 1).alias("entry"), F.col("callee_key").alias("fn"), "place").distinct()
        passed = passed.join(seen, ["entry", "fn"], "left_anti")
        given = passed.join(functions.select(F.col("key").alias("fn"), F.col("path").alias("f_path"), F.col("line").alias("f_line"), "params"), "fn")
        given = given.select("entry", "fn", F.col("f_path").alias("path"), F.get("params", F.col("place")).alias("name"), F.col("f_line").alias("def_line"), F.lit(-1).alias("ord"), F.lit("tainted").alias("state")).where("name IS NOT NULL")
        given = cut(given)
        if given.isEmpty():
            break
        reached = given.select("entry", "fn").distinct()
        seen = cut(seen.unionByName(reached))
        state = cut(given.unionByName(reached.join(defs, "fn").select("entry", "fn", "path", "name", "def_line", "ord", "state")))
    return found


def entry_points(defs: DataFrame) -> DataFrame:
    return defs.where("state = 'tainted'").select("path", "fn").distinct()


def tainted_returns(returns: DataFrame, defs: DataFrame) -> DataFrame:
    """Functions that return a variable (path, fn, name, line) with a tainted reaching definition."""
    rows = cut(returns.withColumn("use_id", F.monotonically_increasing_id()))
    return reaching_definitions(rows.withColumnRenamed("line", "use_line"), defs).where("state = 'tainted'").select("path", "fn").distinct()


def returned_to(calls: DataFrame, returning: DataFrame) -> DataFrame:
    """Receivers (path, fn, receiver, line) of calls whose function returns taint."""
    return calls.where("receiver IS NOT NULL").join(returning.select(F.col("fn").alias("callee_key")), "callee_key", "left_semi").select("path", "fn", F.col("receiver").alias("name"), "line")
