"""Queries that apply each family of scalar functions, and the lockfile parsers, to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import lockfiles
from .scan_queries import table


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages: tests, positions, prefixes, splits, cases, lengths and bytes."""
    url = F.col("url")
    rest = F.when(url.startswith("http://"), F.substring(url, F.lit(8), F.length(url))).otherwise(url)
    parts = F.split(url, "/")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url.contains("example").alias("has"), url.startswith("https").alias("starts"), url.endswith("/").alias("ends"),
        F.instr("url", "://").alias("at"),
        rest.alias("without_prefix"),
        F.when(url.endswith("/"), F.substring(url, F.lit(1), F.length(url) - 1)).otherwise(url).alias("without_suffix"),
        F.size(parts).alias("n_parts"), F.get(F.split(url, "://", 2), F.lit(1)).alias("after_first"),
        F.get(F.split(url, "/", 4), F.lit(3)).alias("fourth_and_on"), F.substring_index(url, "/", -1).alias("last_part"),
        F.size(F.split(text.trimmed(F.regexp_replace(url, "[/.]", " ")), r"\s+")).alias("n_words"),
        F.concat(F.substring(url, 1, 4), F.lit("|"), F.substring(url, F.lit(5), F.length(url))).alias("parted"),
        text.trimmed(F.concat(F.lit(" \t\u00a0"), url, F.lit("\u2003\n"))).alias("trimmed"),
        F.regexp_replace(url, "/+$", "").alias("trimmed_end"), F.lower(url).alias("low"), F.upper(url).alias("up"),
        F.replace(url, F.lit("example"), F.lit("x")).alias("replaced"), F.array_join(parts, "\\").alias("joined"),
        F.format_string("%s#%d", url, F.col("page_id")).alias("formatted"), F.octet_length(url).alias("n_bytes"),
        F.reverse(F.left(F.reverse(url), F.lit(5))).alias("tail"), url.rlike("^[0-9a-z:/.]+$").alias("plain"),
        F.substring(F.encode(url, "utf-8"), 1, 6).cast("string").alias("first_bytes"),
        text.unquoted(F.concat(F.lit("\"'"), url, F.lit("`"))).alias("unquoted"),
    )


def utf8_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut in the middle of a character or not: whether they are UTF-8, and read anyway."""
    held = table(spark, sf_dir, "documents").where("octet_length(text) >= 40")
    cut = F.substring(F.encode("text", "utf-8"), 1, 40)
    return held.select(
        "doc_id", F.is_valid_utf8(cut.cast("string")).alias("valid"),
        F.length(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\ufffd+$", "")).alias("whole_characters"),
    )


_PATH = "concat_ws('/', n_name, coalesce(nullif(substr(p_brand, 7), '13'), ''), replace(p_name, ' ', '.'))"


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of nations and parts: extension, name, folder, joined, and globs."""
    nations = table(spark, sf_dir, "nation")
    parts = table(spark, sf_dir, "part").join(nations, F.pmod("p_partkey", F.lit(25)) == F.col("n_nationkey"))
    path = F.expr(_PATH)
    globs = {"deep": "**/*.widget", "flat": "*/*/cold.*", "named": "N*[0-9]/**", "either": "**/{hot,cold}.*"}
    return parts.select(
        "p_partkey", text.extension(path).alias("extension"), text.file_name(path).alias("file_name"),
        F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.concat_ws("/", F.lit("src"), path).alias("joined"),
        *[path.rlike("^" + text.glob_pattern(g) + "$").alias(name) for name, g in globs.items()],
    )


def parse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and days in text, some of them not readable."""
    number = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("x"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    day = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("1997-13-41")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", number.try_cast("bigint").alias("number"), F.date_format(day.try_cast("date"), "dd.MM.yyyy").alias("day"),
        F.substring("o_orderpriority", 1, 1).try_cast("bigint").alias("rank"),
    )


def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events: fields, typed and not, objects built, and keys replaced and removed."""
    props = F.from_json("props", "k long, gone string")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props", props.alias("p"))
    return rows.select(
        "event_id", F.col("p.k").alias("k"), F.get_json_object("props", "$.k").alias("as_text"), F.get_json_object("props", "$.none").alias("none"),
        F.json_array_length(F.to_json(F.array("p.k", F.lit(1)))).alias("items"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.col("p.k").alias("k"))).alias("built"),
        F.to_json(F.col("p").withField("k", F.col("p.k") + 1).withField("id", F.col("event_id")).dropFields("gone")).alias("changed"),
    )


def hash_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts and of their first bytes, in hexadecimal and in base 64."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.lower(F.hex(F.encode("source", "utf-8"))).alias("hexed"),
        F.base64(F.encode("source", "utf-8")).alias("based"), F.unbase64(F.base64(F.encode("source", "utf-8"))).cast("string").alias("back"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates: formats, days up to a day, and whether that is over 30 days."""
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), age.alias("days"), (age > 30).alias("stale"),
        (F.current_timestamp() > F.col("o_orderdate")).alias("past"),
    )


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in percent without division by zero, differences that stop at zero, bounds and remainders."""
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    whole = F.pmod(key, F.lit(4))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(whole > 0, size / whole * 100).otherwise(0.0).alias("percent"), F.greatest(size - 20, F.lit(0)).alias("rest"),
        F.least(size, F.lit(10).cast("bigint")).alias("low"), F.greatest(size, key).alias("high"), ((key * 1_000_003 + size) % F.lit((1 << 61) - 1)).alias("remainder"),
    )


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names with the sizes of their letters: any, all, filters, maps, picks, positions, sorts and sums."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    size = lambda w: F.length(w)
    long_ = F.filter(words, lambda w: size(w) > 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", words.alias("w"), long_.alias("long"))
    at = lambda k: F.get("w", F.lit(k))
    join = lambda a: F.array_join(a, ",")
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(">"), F.get("w", i + 1)))
    return rows.select(
        "p_partkey", F.exists("w", lambda w: w.startswith("c")).alias("any"), F.forall("w", lambda w: size(w) > 3).alias("all"), join("long").alias("filtered"),
        join(F.transform("w", F.upper)).alias("mapped"), join(F.transform("long", F.lower)).alias("filter_mapped"),
        join(F.flatten(F.transform("w", lambda w: F.array(w, F.reverse(w))))).alias("flat"), F.get("long", F.lit(0)).alias("first"),
        join(F.slice("w", 1, 2)).alias("taken"), F.array_position("w", "widget").alias("position"), join(F.transform("w", lambda w, i: F.concat(i, F.lit(":"), w))).alias("enumerated"),
        join(pairs).alias("pairs"), join(F.array_sort(F.array_distinct("w"))).alias("sorted"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda s, w: s + size(w)).alias("sum"), at(9).alias("beyond"),
    )


def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer as maps: groups, counters, keys of another table, the last of each key, largest and smallest."""
    orders = table(spark, sf_dir, "orders")
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = orders.join(known, "o_custkey", "left_semi").withColumn("share", F.col("o_orderkey") % 4)
    one = F.struct("o_totalprice", "o_orderkey")
    return kept.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey"))), ",").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"), F.max_by("o_orderkey", one).alias("largest"), F.min_by("o_orderkey", one).alias("smallest"),
        F.count_distinct("share").alias("shares"),
    )


def null_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents, where there are any: defaults, and tests of values that may be missing."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(
        "doc_id", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("quality"), (F.col("toxic").isNotNull() & (F.col("toxic") > 0)).alias("known_and_toxic"),
        F.col("toxic").eqNullSafe(F.col("quality")).alias("alike"),
    )


# Lockfiles: the suppliers of each nation are the packages of one lockfile.

def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS k", "replace(lower(s_name), '#', '-') AS name", "concat_ws('.', s_nationkey % 7, s_suppkey % 11, s_suppkey % 5) AS version",
        "s_nationkey AS n", "s_suppkey % 6 AS kind",
    )


def _lockfile(rows: DataFrame, name: str, entry: Column, head: str, between: str, tail: str) -> DataFrame:
    """path and text: the entries of each nation in the order of their keys; a copy lies in a folder that is passed over."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda x: x["e"]), between)
    made = rows.groupBy("n").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))
    folders = F.explode(F.array(F.lit("app"), F.lit("app/vendor/x")))
    return made.withColumn("folder", folders).select(F.concat_ws("/", "folder", F.col("n").cast("string"), F.lit(name)).alias("path"), "text")


def _texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = _packages(spark, sf_dir)
    with_name = lambda t: F.expr("concat(" + t + ")")
    made = {
        "package-lock.json": (with_name("""'"', if(kind = 0, 'node_modules/a/', ''), 'node_modules/@s/', name, '": {', if(kind = 1, '"link": true', concat('"version": "', version, '"')), '}'"""), '{"lockfileVersion": 3, "packages": {"": {"version": "9.9.9"}, ', ", ", "}}"),
        "Cargo.lock": (with_name("""'[[package]]\\nname = "', name, '"\\n', if(kind = 1, '', concat('version = "', version, '"\\n'))"""), "version = 3\n\n", "\n", ""),
        "pom.xml": (with_name("""'<dependency><groupId>g', kind, '</groupId><artifactId> ', name, ' </artifactId>', if(kind = 1, '', concat('<version>', version, '</version>')), '</dependency>'"""), '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>', "\n", "</dependencies></project>"),
        "gradle.lockfile": (with_name("""if(kind = 1, '#', ''), 'g', kind, ':', name, ':', version, '=compileClasspath,runtimeClasspath'"""), "# fixed\n", "\n", "\nempty=annotationProcessor\n"),
        "go.sum": (with_name("""'example.com/', name, ' v', version, ' h1:a=\\nexample.com/', name, ' v', version, '/go.mod h1:b=', if(kind = 1, '\\nodd', '')"""), "", "\n", "\n"),
        "requirements.txt": (with_name("""case kind when 0 then '# ' when 1 then '-r ' else '' end, upper(name), case kind when 2 then '[x, y] == ' when 3 then ' >= ' when 4 then '~=' else '==' end, version, if(kind = 3, ',<9', ''), ' ; x'"""), "", "\n", ""),
        "Pipfile.lock": (with_name("""'"', upper(name), '": ', if(kind = 1, '{"git": "x"}', concat('{"version": "==', version, '"}'))"""), '{"_meta": {}, "default": {', ", ", '}, "develop": {"Tool": {"version": "==1.0"}}}'),
        "packages.lock.json": (with_name("""'"', name, '": ', if(kind = 1, '{"type": "Project"}', concat('{"resolved": "', version, '"}'))"""), '{"version": 1, "dependencies": {"net8.0": {', ", ", '}, "net9.0": {"Tool": {"resolved": "1.0"}}}}'),
    }
    return {name: _lockfile(rows, name, *parts) for name, parts in made.items()}


def _lockfile_query(kind: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lockfiles.PARSERS[kind](_texts(spark, sf_dir)[kind]).withColumn("line", F.col("line").cast("bigint"))

    return query


def lockfile_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lockfiles together, by ecosystem."""
    every = None
    for held in _texts(spark, sf_dir).values():
        every = held if every is None else every.unionByName(held)
    return lockfiles.dependencies(every).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("lockfile_path").alias("lockfiles"))


_P = "p AS (SELECT s_suppkey AS k, replace(lower(s_name), '#', '-') AS name, (s_nationkey % 7) || '.' || (s_suppkey % 11) || '.' || (s_suppkey % 5) AS version, s_nationkey AS n, s_suppkey % 6 AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, sum(CASE WHEN s_suppkey % 6 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS odd FROM supplier), nations AS (SELECT DISTINCT n FROM p)"


def _lock_sql(file: str, ecosystem: str, name: str = "name", where: str = "kind <> 1", line: str = "0", more: str = "") -> str:
    path = f"'app/' || n || '/{file}'"
    return f"SELECT {name} AS name, version, '{ecosystem}' AS ecosystem, {path} AS lockfile_path, CAST({line} AS BIGINT) AS line FROM p WHERE {where}" + (f" UNION ALL SELECT {more}, '{ecosystem}', {path}, 0 FROM nations" if more else "")


_LOCKS = {
    "package-lock.json": _lock_sql("package-lock.json", "npm", "'@s/' || name"),
    "Cargo.lock": _lock_sql("Cargo.lock", "cargo"),
    "pom.xml": _lock_sql("pom.xml", "maven", "'g' || kind || ':' || name"),
    "gradle.lockfile": _lock_sql("gradle.lockfile", "maven", "'g' || kind || ':' || name", line="r + 1"),
    "go.sum": _lock_sql("go.sum", "go", "'example.com/' || name", "true", "2 * r - 1 + coalesce(odd, 0)"),
    "requirements.txt": _lock_sql("requirements.txt", "pypi", where="kind IN (2, 3, 5)", line="r"),
    "Pipfile.lock": _lock_sql("Pipfile.lock", "pypi", more="'tool', '1.0'"),
    "packages.lock.json": _lock_sql("packages.lock.json", "nuget", more="'Tool', '1.0'"),
}
_NAMES = {
    "package-lock.json": "lockfile_npm", "Cargo.lock": "lockfile_cargo", "pom.xml": "lockfile_maven", "gradle.lockfile": "lockfile_gradle",
    "go.sum": "lockfile_go", "requirements.txt": "lockfile_requirements", "Pipfile.lock": "lockfile_pipfile", "packages.lock.json": "lockfile_nuget",
}

ORACLES = {
    "string_functions": r"""SELECT page_id, contains(url, 'example') AS has, starts_with(url, 'https') AS starts, ends_with(url, '/') AS ends, strpos(url, '://') AS at,
      CASE WHEN starts_with(url, 'http://') THEN url[8:] ELSE url END AS without_prefix, CASE WHEN ends_with(url, '/') THEN url[:-2] ELSE url END AS without_suffix,
      len(string_split(url, '/')) AS n_parts, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] END AS after_first,
      CASE WHEN len(string_split(url, '/')) >= 4 THEN array_to_string(string_split(url, '/')[4:], '/') END AS fourth_and_on, string_split(url, '/')[-1] AS last_part,
      len(regexp_split_to_array(trim(regexp_replace(url, '[/.]', ' ', 'g'), ' '), '\s+')) AS n_words, url[1:4] || '|' || url[5:] AS parted, url AS trimmed, rtrim(url, '/') AS trimmed_end,
      lower(url) AS low, upper(url) AS up, replace(url, 'example', 'x') AS replaced, replace(url, '/', '\') AS joined, url || '#' || page_id AS formatted, strlen(url) AS n_bytes, right(url, 5) AS tail,
      regexp_full_match(url, '[0-9a-z:/.]+') AS plain, url[1:6] AS first_bytes, url AS unquoted FROM pages""",
    "utf8_functions": """WITH b AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: strlen(c)) AS sizes FROM documents WHERE strlen(text) >= 40),
      u AS (SELECT doc_id, unnest(sizes[1:40]) AS size, generate_subscripts(sizes[1:40], 1) AS i FROM b), s AS (SELECT doc_id, i, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u)
      SELECT doc_id, max(upto) = 40 AS valid, max(i) AS whole_characters FROM s WHERE upto <= 40 GROUP BY doc_id""",
    "path_functions": rf"""WITH t AS (SELECT p_partkey, {_PATH} AS path FROM part JOIN nation ON p_partkey % 25 = n_nationkey)
      SELECT p_partkey, regexp_extract(path, '(\.[^./]+)$', 1) AS extension, string_split(path, '/')[-1] AS file_name, array_to_string(string_split(path, '/')[:-2], '/') AS folder, 'src/' || path AS joined,
      ends_with(path, '.widget') AS deep, len(string_split(path, '/')) = 3 AND starts_with(string_split(path, '/')[3], 'cold.') AS flat,
      string_split(path, '/')[1] LIKE 'N%' AND right(string_split(path, '/')[1], 1) BETWEEN '0' AND '9' AS named,
      starts_with(string_split(path, '/')[-1], 'hot.') OR starts_with(string_split(path, '/')[-1], 'cold.') AS either FROM t""",
    "parse_functions": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS number, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%d.%m.%Y') END AS day, try_cast(o_orderpriority[1] AS BIGINT) AS rank FROM orders",
    "json_functions": """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, props ->> '$.k' AS as_text, props ->> '$.none' AS none, 2 AS items,
      CASE WHEN props ->> '$.k' IS NULL THEN '{"type":"' || event_type || '"}' ELSE '{"type":"' || event_type || '","k":' || (props ->> '$.k') || '}' END AS built,
      CASE WHEN props IS NOT NULL THEN CASE WHEN props ->> '$.k' IS NULL THEN '{"id":' || event_id || '}' ELSE '{"k":' || (CAST(props ->> '$.k' AS BIGINT) + 1) || ',"id":' || event_id || '}' END END AS changed FROM events""",
    "hash_functions": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, lower(hex(source)) AS hexed, to_base64(encode(source)) AS based, source AS back FROM documents",
    "date_functions": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') > 30 AS stale, true AS past FROM orders",
    "math_functions": "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size / (p_partkey % 4) * 100 ELSE 0.0 END AS percent, greatest(p_size - 20, 0) AS rest, least(p_size, 10) AS low, greatest(p_size, p_partkey) AS high, (p_partkey * 1000003 + p_size) % ((1::BIGINT << 61) - 1) AS remainder FROM part",
    "array_functions": """WITH t AS (SELECT p_partkey, string_split(concat_ws(' ', p_name, p_type, p_brand), ' ') AS w FROM part), l AS (SELECT *, list_filter(w, lambda x: length(x) > 4) AS long FROM t)
      SELECT p_partkey, len(list_filter(w, lambda x: starts_with(x, 'c'))) > 0 AS "any", len(list_filter(w, lambda x: length(x) <= 3)) = 0 AS "all", array_to_string(long, ',') AS filtered, array_to_string(list_transform(w, lambda x: upper(x)), ',') AS mapped,
      array_to_string(list_transform(long, lambda x: lower(x)), ',') AS filter_mapped, array_to_string(list_transform(w, lambda x: x || ',' || reverse(x)), ',') AS flat, long[1] AS first, array_to_string(w[1:2], ',') AS taken,
      coalesce(list_position(w, 'widget'), 0) AS position, array_to_string(list_transform(w, lambda x, i: (i - 1) || ':' || x), ',') AS enumerated, array_to_string(list_transform(w[:-2], lambda x, i: x || '>' || w[i + 1]), ',') AS pairs,
      array_to_string(list_sort(list_distinct(w)), ',') AS sorted, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS sum, w[10] AS beyond FROM l""",
    "map_functions": """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, arg_max(o_orderpriority, o_orderkey) AS last_priority,
      first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS largest, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS smallest, count(DISTINCT o_orderkey % 4) AS shares
      FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
    "null_functions": "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic > 0, false) AS known_and_toxic, toxic IS NOT DISTINCT FROM quality AS alike FROM documents LEFT JOIN labels USING (doc_id)",
    "lockfile_dependencies": f"WITH {_P}, a AS (" + " UNION ALL ".join(f"({sql})" for sql in _LOCKS.values()) + ") SELECT ecosystem, count(*) AS n, count(DISTINCT name) AS names, count(DISTINCT lockfile_path) AS lockfiles FROM a GROUP BY ecosystem",
    **{_NAMES[k]: f"WITH {_P} {sql}" for k, sql in _LOCKS.items()},
}
_FUNCTIONS = (string_functions, utf8_functions, path_functions, parse_functions, json_functions, hash_functions, date_functions, math_functions, array_functions, map_functions, null_functions, lockfile_dependencies)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {name: _lockfile_query(kind) for kind, name in _NAMES.items()}
