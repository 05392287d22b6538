"""Scalar text functions as Column expressions. Character classes are spelled out in ASCII, so that Java,
RE2 and Python regexes agree."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f\\x0B]"


def token_estimate(text: Column) -> Column:
    """Number of words and single marks, at least 1; null counts as empty."""
    count = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+|[^ \\t\\n\\r\\f\\x0BA-Za-z0-9_]"))
    return F.greatest(count, F.lit(1)).cast("bigint")


def identifier_parts(name: Column) -> Column:
    """Lower-cased parts of an identifier: camel case, digits and separators divide; a part in which
    none is found stays as it is."""
    pieces = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), " +"), lambda p: p != "")
    camel = F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit("[A-Z]?[a-z]+|[0-9]+|[A-Z]+(?=[A-Z]|$)"), F.lit(0)))
    whole = F.zip_with(pieces, camel, lambda p, c: F.when(F.size(c) > 0, c).otherwise(F.array(p)))
    return F.transform(F.flatten(whole), lambda p: F.lower(p))


STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "index", "main", "src", "test", "tests", "utils")


def normal_terms(parts: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """The parts without stop words, numbers and single letters."""
    return F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9]+$") & ~p.isin(*stopwords))


def ellipsis(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of a longer text being dots."""
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def compact_signature(signature: Column, limit: int = 80) -> Column:
    """The signature without its return type if it is too long, then shortened."""
    head = F.when(F.length(signature) <= limit, signature).otherwise(F.rtrim(F.substring_index(signature, "->", 1)))
    return ellipsis(head, limit)


def short_path(path: Column, keep: int = 2) -> Column:
    """The last `keep` segments."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), keep), "/")


def normal_path(path: Column) -> Column:
    """The path with . and .. resolved; .. above the start stays."""
    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when((part == "") | (part == "."), done).when((part == "..") & up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def semantic_hash(text: Column, language: Column | None = None) -> Column:
    """SHA-1 of the text without comments (by language: py, or ts, tsx, js, jsx, rs, go) and white space."""
    plain = text
    if language is not None:
        slashes = F.regexp_replace(F.regexp_replace(text, "(?s)/\\*.*?\\*/", ""), "//[^\\n]*", "")
        plain = F.when(language == "py", F.regexp_replace(text, "#[^\\n]*", "")).when(language.isin("ts", "tsx", "js", "jsx", "rs", "go"), slashes).otherwise(text)
    return F.sha1(F.regexp_replace(plain, BLANK + "+", ""))


def url_path(url: Column) -> Column:
    """Path of a URL: no scheme, host, query, fragment; begins with one slash, ends without one."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    rooted = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(F.length(rooted) > 1, F.regexp_replace(rooted, "/+$", "")).otherwise(rooted)


def route_pattern(route: Column) -> Column:
    """Anchored regex of a route; :p, {p} and [p] match one segment."""
    escaped = F.regexp_replace(route, "([.+*?^$()|\\\\])", "\\\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, ":[A-Za-z0-9_]+|\\{[^}/]*\\}|\\[[^\\]/]*\\]", "[^/]+"), F.lit("$"))


def file_route(path: Column) -> Column:
    """Route of a page file: [id] becomes :id, [...x] and [[...x]] become *x, groups in parentheses and
    page, route and index files vanish."""
    bare = F.regexp_replace(F.regexp_replace(path, "^(?:.*/)?(?:src/)?(?:app|pages)/", ""), "\\.[A-Za-z]+$", "")
    bare = F.regexp_replace(bare, "(^|/)(?:page|route|index)$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: (p != "") & ~p.rlike("^\\(.*\\)$"))
    named = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, "^\\[+\\.\\.\\.([^\\]]+)\\]+$", "*$1"), "^\\[([^\\]]+)\\]$", ":$1"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def xml_escape(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset, from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def strip_quotes(literal: Column) -> Column:
    return F.regexp_replace(F.trim(literal), "^[\"'`]|[\"'`]$", "")


def clean_type(name: Column) -> Column:
    """A type's name without generic arguments, brackets and blanks."""
    return F.regexp_replace(F.regexp_replace(name, "<.*$|\\(.*$", ""), "[^A-Za-z0-9_.]", "")


def glob_regex(glob: str) -> str:
    """A glob as a regex over lower-cased paths; * crosses slashes, and a glob without marks is a part
    of the path."""
    if not any(c in glob for c in "*?["):
        return re.escape(glob.lower())
    out = ""
    i, g = 0, glob.lower()
    while i < len(g):
        c = g[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in g[i + 1 :]:
            j = g.index("]", i + 1)
            out += "[" + g[i + 1 : j].replace("!", "^", 1) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the path or its file name."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    test = F.lit(False)
    for g in globs:
        test = test | low.rlike(glob_regex(g)) | name.rlike(glob_regex(g))
    return test


def strip_json_comments(text: str) -> str:
    """JSON without // and /* */ comments and trailing commas; strings stay."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        else:
            out.append(c)
            i += 1
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def split_parameters(text: str) -> list[str]:
    """The parameters of a list, divided at commas outside brackets and strings."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>" and text[i - 1 : i + 1] not in ("=>", "->"):
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    tail = text[start:].strip()
    return [p for p in [*parts, tail] if p]
