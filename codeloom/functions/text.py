"""Text, path and JSON functions as Column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders whose next path segment names a service; fixed value.
SERVICE_FOLDERS = "services|src|apps|microservices"


def service_of(path: Column) -> Column:
    """The segment after a service folder, else the first segment; backslashes count as slashes."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    named = F.regexp_extract(norm, rf"^(?:.*?/)??(?:{SERVICE_FOLDERS})/([^/]+)", 1)
    return F.when(named != "", named).otherwise(F.split_part(norm, F.lit("/"), F.lit(1)))


def utf8(raw: Column) -> Column:
    """Bytes as text; each ill-formed sequence becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def url_path(url: Column) -> Column:
    """A URL without scheme and host."""
    return F.regexp_replace(url, r"^https?://[^/]+", "")


def camel_words(name: Column) -> Column:
    """The words of a camelCase or PascalCase name."""
    return F.regexp_extract_all(name, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$))"), F.lit(1))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def term_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def approx_tokens(text: Column) -> Column:
    """White-space words times 1.3."""
    return F.size(space_tokens(text)) * F.lit(1.3)


def quarter_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def module_key(path: Column) -> Column:
    """A source path as a dotted module: no extension, no trailing __init__ or index, no empty or '.' parts."""
    norm = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+|/+$", "")
    bare = F.regexp_replace(norm, r"(?<=[^/])\.[^./]*$", "")
    parts = F.split(bare, "/")
    kept = F.when(F.element_at(parts, -1).isin("__init__", "index"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(F.filter(kept, lambda p: (p != "") & (p != ".")), ".")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression over a whole string."""
    out = []
    for c in fnmatch_tokens(pattern):
        out.append({"*": ".*", "?": "."}.get(c, c if c.startswith("[") else "\\" + c if not (c.isalnum() or c in "_/") else c))
    return "(?s)^" + "".join(out) + "$"


def fnmatch_tokens(pattern: str) -> list[str]:
    """The parts of a shell pattern: characters, wildcards and bracket sets (with ! as ^)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "]") else i + 1)
            if end > 0:
                body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
                i = end + 1
                continue
        out.append(c)
        i += 1
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches an ignore pattern: as a whole, by its base name, below a `folder/*`, or anywhere for
    patterns with a slash."""
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(norm, "/"), -1)
    hit = F.lit(False)
    for p in patterns:
        p = p.replace("\\", "/")
        hit = hit | norm.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
        if p.endswith("/*"):
            hit = hit | (norm == p[:-2]) | norm.startswith(p[:-1])
        if "/" in p:
            hit = hit | norm.rlike(glob_regex(f"*{p}*"))
    return hit


def is_ignored(path: str, patterns: list[str]) -> bool:
    """ignored() for one path on the driver."""
    norm = path.replace("\\", "/")
    name = norm.rsplit("/", 1)[-1]
    for p in (q.replace("\\", "/") for q in patterns):
        below = p.endswith("/*") and (norm == p[:-2] or norm.startswith(p[:-1]))
        if below or fnmatch.fnmatchcase(norm, p) or fnmatch.fnmatchcase(name, p) or ("/" in p and fnmatch.fnmatchcase(norm, f"*{p}*")):
            return True
    return False


def balanced(text: Column) -> Column:
    """Whether braces and parentheses are equal in number."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (count("{") == count("}")) & (count("(") == count(")"))


def flatten_value(value: Column) -> Column:
    """Nested values as JSON text, for formats with flat attributes."""
    return F.to_json(value)
