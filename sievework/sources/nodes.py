"""Syntax trees as tables of nodes, one row a node."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..lineage import bounded

SCHEMA = """path string, node_id long, parent_id long, ordinal int, named_ordinal int, depth int, kind string, is_named boolean,
field_name string, text string, start_byte long, end_byte long, start_row int, start_col int, end_row int, end_col int, path_from_root array<long>"""
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
COLUMNS = [(name, _KINDS[kind]) for name, kind in (x.split() for x in SCHEMA.replace("\n", " ").split(","))]

#: Names of grammar nodes for the classes of Python's own parser.
PYTHON_KINDS = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Return": "return_statement", "Assign": "assignment", "AnnAssign": "assignment",
    "AugAssign": "augmented_assignment", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "If": "if_statement", "With": "with_statement", "AsyncWith": "with_statement", "Raise": "raise_statement",
    "Try": "try_statement", "Assert": "assert_statement", "Import": "import_statement", "ImportFrom": "import_from_statement", "Global": "global_statement", "Expr": "expression_statement", "Pass": "pass_statement",
    "Break": "break_statement", "Continue": "continue_statement", "BoolOp": "boolean_operator", "BinOp": "binary_operator", "UnaryOp": "unary_operator", "Lambda": "lambda", "IfExp": "conditional_expression", "Dict": "dictionary",
    "Set": "set", "ListComp": "list_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "Await": "await", "Yield": "yield", "Compare": "comparison_operator", "Call": "call",
    "JoinedStr": "string", "Attribute": "attribute", "Subscript": "subscript", "Name": "identifier", "List": "list", "Tuple": "tuple", "ExceptHandler": "except_clause", "arguments": "parameters", "arg": "identifier",
    "keyword": "keyword_argument", "Delete": "delete_statement", "Starred": "list_splat", "Match": "match_statement", "match_case": "case_clause", "comprehension": "for_in_clause",
}
FIELDS = {"target": "left", "iter": "right", "test": "condition", "orelse": "alternative", "elts": None, "values": None}
HIDDEN = (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)
#: Operator tokens.
SIGNS = {"Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "Mod": "%", "Pow": "**", "FloorDiv": "//", "BitOr": "|", "BitAnd": "&", "BitXor": "^", "LShift": "<<", "RShift": ">>", "MatMult": "@", "And": "and", "Or": "or", "Not": "not", "USub": "-", "UAdd": "+", "Invert": "~"}
Span = tuple[int, int, int, int]


def _kind(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        v = node.value
        return "string" if isinstance(v, str | bytes) else "true" if v is True else "false" if v is False else "none" if v is None else "integer" if isinstance(v, int) else "float"
    return PYTHON_KINDS.get(type(node).__name__, type(node).__name__.lower())


class _Tree:
    """Rows of one file's nodes, in the order of a walk from the root."""

    def __init__(self, data: bytes):
        self.data, self.rows, self.starts = data, [], [0]
        self.lines = data.split(b"\n")
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def add(self, parent: dict | None, kind: str, field: str | None, span: Span, named: bool = True) -> dict:
        r0, c0, r1, c1 = span
        begin, end = self.starts[r0] + c0, min(len(self.data), self.starts[r1] + c1)
        row = {
            "node_id": len(self.rows), "parent_id": parent and parent["node_id"], "ordinal": parent["_n"] if parent else 0, "named_ordinal": parent["_named"] if parent and named else None, "depth": parent["depth"] + 1 if parent else 0,
            "kind": kind, "is_named": named, "field_name": field, "text": self.data[begin:end].decode(errors="replace"), "start_byte": begin, "end_byte": end, "start_row": r0, "start_col": c0, "end_row": r1, "end_col": c1,
            "path_from_root": [*(parent["path_from_root"] if parent else []), len(self.rows)], "_n": 0, "_named": 0,
        }
        if parent:
            parent["_n"] += 1
            parent["_named"] += named
        self.rows.append(row)
        return row

    @staticmethod
    def span(*nodes: ast.AST) -> Span | None:
        held = [n for node in nodes for n in ([node] if hasattr(node, "lineno") else [x for x in ast.walk(node) if hasattr(x, "lineno")])]
        if not held:
            return None
        first, last = min(held, key=lambda n: (n.lineno, n.col_offset)), max(held, key=lambda n: (n.end_lineno, n.end_col_offset))
        return first.lineno - 1, first.col_offset, last.end_lineno - 1, last.end_col_offset

    def many(self, parent: dict, kind: str, field: str | None, nodes: list[ast.AST], inner: str | None = None) -> None:
        """A node that holds the given ones; nothing for none."""
        if nodes and (span := self.span(*nodes)):
            own = self.add(parent, kind, field, span)
            for n in nodes:
                self.walk(n, own, inner)

    def name(self, parent: dict, field: str, name: str, near: str) -> None:
        """An identifier that the parser gives as plain text: the first whole word of its name after a keyword, or the last."""
        text = parent["text"]
        found = re.search(r"(?:(?:def|class|from)\s+)?" + re.escape(name), text) if near == "first" else None
        at = found.end() - len(name) if found else text.rfind(name)
        before = text[: max(0, at)].encode()
        row, col = parent["start_row"] + before.count(b"\n"), len(before) - before.rfind(b"\n") - 1 if b"\n" in before else parent["start_col"] + len(before)
        self.add(parent, "identifier", field, (row, col, row, col + len(name.encode())))

    def sign(self, parent: dict, operator: ast.AST) -> None:
        self.add(parent, SIGNS.get(type(operator).__name__, type(operator).__name__.lower()), "operator", (parent["start_row"], parent["start_col"], parent["start_row"], parent["start_col"]), named=False)

    def walk(self, node: ast.AST, parent: dict | None, field: str | None) -> None:  # noqa: C901
        span = self.span(node) or (parent["start_row"], parent["start_col"], parent["start_row"], parent["start_col"])
        if isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign):
            parent, field = self.add(parent, "expression_statement", field, span), None
        own = self.add(parent, _kind(node), field, span)
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                self.name(own, "name", node.name, "first")
                if isinstance(node, ast.ClassDef):
                    self.many(own, "argument_list", "superclasses", node.bases)
                else:
                    self.parameters(own, node.args)
                    if node.returns:
                        self.many(own, "type", "return_type", [node.returns])
                self.many(own, "block", "body", node.body)
            case ast.Lambda():
                self.parameters(own, node.args)
                self.walk(node.body, own, "body")
            case ast.Call():
                self.walk(node.func, own, "function")
                end = self.span(node.func)
                held = self.add(own, "argument_list", "arguments", (end[2], end[3], span[2], span[3]))
                for n in sorted([*node.args, *node.keywords], key=lambda n: (n.lineno, n.col_offset)):
                    self.walk(n, held, None)
            case ast.keyword():
                if node.arg:
                    self.name(own, "name", node.arg, "first")
                self.walk(node.value, own, "value")
            case ast.Attribute():
                self.walk(node.value, own, "object")
                self.name(own, "attribute", node.attr, "last")
            case ast.Assign():
                for n in node.targets:
                    self.walk(n, own, "left")
                self.walk(node.value, own, "right")
            case ast.AnnAssign() | ast.AugAssign():
                self.walk(node.target, own, "left")
                if isinstance(node, ast.AugAssign):
                    self.sign(own, node.op)
                if node.value:
                    self.walk(node.value, own, "right")
            case ast.BinOp():
                self.walk(node.left, own, "left")
                self.sign(own, node.op)
                self.walk(node.right, own, "right")
            case ast.If():
                self.walk(node.test, own, "condition")
                self.many(own, "block", "consequence", node.body)
                if node.orelse and (other := self.span(*node.orelse)):
                    held = self.add(own, "elif_clause" if isinstance(node.orelse[0], ast.If) and len(node.orelse) == 1 else "else_clause", "alternative", other)
                    if held["kind"] == "elif_clause":
                        self.walk(node.orelse[0].test, held, "condition")
                        self.many(held, "block", "consequence", node.orelse[0].body)
                        if node.orelse[0].orelse and (last := self.span(*node.orelse[0].orelse)):
                            self.many(self.add(own, "else_clause", "alternative", last), "block", "body", node.orelse[0].orelse)
                    else:
                        self.many(held, "block", "body", node.orelse)
            case ast.For() | ast.AsyncFor() | ast.While():
                if isinstance(node, ast.While):
                    self.walk(node.test, own, "condition")
                else:
                    self.walk(node.target, own, "left")
                    self.walk(node.iter, own, "right")
                self.many(own, "block", "body", node.body)
                if node.orelse:
                    self.many(self.add(own, "else_clause", "alternative", self.span(*node.orelse)), "block", "body", node.orelse)
            case ast.Try():
                self.many(own, "block", "body", node.body)
                for n in node.handlers:
                    self.walk(n, own, None)
                self.many(own, "else_clause", None, node.orelse)
                self.many(own, "finally_clause", None, node.finalbody)
            case ast.ExceptHandler():
                if node.type:
                    self.walk(node.type, own, "type")
                self.many(own, "block", None, node.body)
            case ast.ImportFrom() | ast.Import():
                if isinstance(node, ast.ImportFrom):
                    self.name(own, "module_name", "." * node.level + (node.module or ""), "first")
                for n in node.names:
                    held = self.add(own, "aliased_import" if n.asname else "dotted_name", "name", self.span(n))
                    if n.asname:
                        self.name(held, "name", n.name, "first")
                        self.name(held, "alias", n.asname, "last")
            case _:
                for name, value in ast.iter_fields(node):
                    for child in value if isinstance(value, list) else [value]:
                        if isinstance(child, ast.AST) and not isinstance(child, HIDDEN):
                            self.walk(child, own, FIELDS.get(name, name))

    def parameters(self, parent: dict, args: ast.arguments) -> None:
        every = [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]
        plain = [*args.posonlyargs, *args.args]
        values = dict(zip(map(id, plain[len(plain) - len(args.defaults) :]), args.defaults, strict=True)) | {id(a): d for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True) if d}
        span = self.span(*every) if every else (parent["start_row"], parent["start_col"], parent["start_row"], parent["start_col"])
        held = self.add(parent, "parameters", "parameters", span)
        for a in every:
            around = held
            if id(a) in values:
                around = self.add(held, "default_parameter", None, self.span(a, values[id(a)]))
            elif a.annotation:
                around = self.add(held, "typed_parameter", None, self.span(a))
            line, col = a.lineno - 1, a.col_offset
            self.add(around, "identifier", "name" if around is not held else None, (line, col, line, col + len(a.arg.encode())))
            if id(a) in values:
                self.walk(values[id(a)], around, "value")


def parse_python(source: str) -> list[dict]:
    """Nodes of Python source in the order of a walk from the root, comments last; [] if it can't be parsed."""
    try:
        tree = ast.parse(source)
        made = _Tree(source.encode())
        root = made.add(None, "module", None, (0, 0, len(made.lines) - 1, len(made.lines[-1])))
        for statement in tree.body:
            made.walk(statement, root, None)
        for t in tokenize.generate_tokens(io.StringIO(source).readline) if "#" in source else ():
            if t.type == tokenize.COMMENT:
                made.add(root, "comment", None, (t.start[0] - 1, len(t.line[: t.start[1]].encode()), t.end[0] - 1, len(t.line[: t.end[1]].encode())))
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return []
    for r in made.rows:
        del r["_n"], r["_named"]
    return made.rows


#: Front ends by language; register more, or bring nodes of other parsers as a table.
PARSERS: dict[str, Callable[[str], list[dict]]] = {"Python": parse_python}


def spread(files: DataFrame) -> DataFrame:
    """path and text, dealt to as many tasks as a shuffle has: a small file of a table may hold many sources, and parsing takes long."""
    files = files.select("path", "text")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files if files.isStreaming or files.rdd.getNumPartitions() >= parts else files.repartition(parts, "path")


def folded(files: DataFrame, fold: Callable[[str, list[dict]], list[tuple]], schema: str, language: str = "Python") -> DataFrame:
    """Rows that ``fold`` makes of each file's path and nodes; one narrow pass, in which nodes never leave the parser's process."""
    parse = PARSERS[language]
    names, kinds = zip(*((n, _KINDS[t]) for n, t in (c.split() for c in schema.split(", "))), strict=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for path, source in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in fold(path, parse(source or ""))]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return bounded(spread(files)).mapInArrow(rows, schema)


def nodes_of(files: DataFrame, language: str = "Python") -> DataFrame:
    """Nodes of files (path, text) of a language."""
    parse, kind = PARSERS[language], pa.schema([(n, t) for n, t in COLUMNS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, source in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held += [{"path": path, **r} for r in parse(source or "")]
                if len(held) > 20_000:
                    yield pa.RecordBatch.from_pylist(held, kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)

    return spread(files).mapInArrow(rows, SCHEMA)
