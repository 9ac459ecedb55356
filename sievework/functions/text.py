"""Text of source files: lines, snippets, fingerprints, paths and masks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_LINES = 10
#: Unicode white space at either end, as a pattern that Java and RE2 read alike.
ENDS = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def lines(text: Column) -> Column:
    """Lines without their ends: parted at line feeds, without a carriage return before them, and no empty last line."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def normal_snippet(snippet: Column) -> Column:
    """Lines trimmed, line ends as line feeds, and the whole trimmed."""
    plain = F.replace(snippet, F.lit("\r\n"), F.lit("\n"))
    return trimmed(F.array_join(F.transform(F.split(plain, "\n"), trimmed), "\n"))


def first_lines(snippet: Column, most: int = SNIPPET_LINES) -> Column:
    return F.array_join(F.slice(F.split(snippet, "\n"), 1, most), "\n")


def context(text: Column, line: Column, around: int = 3) -> Column:
    """The line (from 1) with as many lines before and after it."""
    start = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(lines(text), start, line + around + 1 - start), "\n")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def fingerprint(rule_id: Column, path: Column, snippet: Column) -> Column:
    """SHA-256 of rule, path and normalised snippet, one after the other; line numbers don't count."""
    return F.sha2(F.concat(rule_id, normal_path(path), normal_snippet(snippet)), 256)


def resolved_path(path: Column) -> Column:
    """A path without ``.`` and with ``..`` taken back."""
    step = lambda held, part: F.when(part.isin("", "."), held).when((part == "..") & (F.size(held) > 0), F.slice(held, 1, F.size(held) - 1)).when(part == "..", held).otherwise(F.concat(held, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["'`]+|["'`]+$""", "")


def masked(secret: Column) -> Column:
    """First and last four characters around four stars; four stars for what is shorter than eight bytes."""
    return F.when(F.octet_length(secret) < 8, "****").otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4))))


#: Words that aren't masked.
KEYWORDS = (
    "const", "let", "var", "function", "return", "export", "import", "require", "process", "password",
    "api_key", "apikey", "api-key", "secret", "token", "database", "username", "connection", "endpoint",
)

_QUOTED_OR_TOKEN = re.compile(r"""(["'])(?:.*?\1|.*$)|[\w\-/+][\w\-/+.]*""")


def masked_snippet(snippet: str | None) -> str | None:
    """Masks quoted strings and long tokens after the first ``=`` or ``:`` of each line, or in the whole line."""
    if snippet is None:
        return None

    def mask(value: str) -> str:
        return "****" if len(value.encode()) < 8 else f"{value[:4]}****{value[-4:]}"

    def token(m: re.Match) -> str:
        x = m[0]
        if m[1]:
            inner = x[1:-1]
            size = len(inner.encode())
            return x if len(x) <= 2 or size < 4 else m[1] + (mask(inner) if size >= 8 else "****") + m[1]
        return mask(x) if len(x.encode()) >= 8 and x.lower() not in KEYWORDS else x

    out = []
    for line in snippet.splitlines():
        at = re.search("[=:]", line)
        head = line[: at.end()] if at else ""
        out.append(head + _QUOTED_OR_TOKEN.sub(token, line[len(head) :]))
    return "\n".join(out)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def glob_pattern(glob: str) -> str:
    """The pattern of a path glob: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif glob[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif glob[at] == "?":
            out, at = out + "[^/]", at + 1
        elif glob[at] == "[" and "]" in glob[at:]:
            end = glob.index("]", at)
            out, at = out + "[" + glob[at + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif glob[at] == "{" and "}" in glob[at:]:
            end = glob.index("}", at)
            out, at = out + "(?:" + "|".join(glob_pattern(x) for x in glob[at + 1 : end].split(",")) + ")", end + 1
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return out
