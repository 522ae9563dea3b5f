"""Scalar functions: names, and the repair of machine-written JSON."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def capitalise(name: Column | str) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.expr(f"substr({name}, 2)") if isinstance(name, str) else name.substr(F.lit(2), F.length(name))))


def camel(kebab: Column | str) -> Column:
    """kebab-case as camelCase."""
    parts = F.split(kebab, "-")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def safe_name(name: Column | str, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), 1, most)


def repo_of(url: Column | str) -> Column:
    """owner and name of a repository's address; the name ends at its first dot."""
    pattern = r"github\.com[/:]([^/]+)/([^/.]+)"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("name"))


def allowed_url(url: Column | str) -> Column:
    """https with a public host name: no bare IPv4 address and no private or local name."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    local = host.rlike(r"^(localhost|.*\.local|.*\.internal)$") | host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | host.startswith("[")
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & ~local, F.lit(False))


def repaired(text: str | None) -> str | None:
    """JSON of a reply, made valid where its end is missing, as compact text; null if nothing helps. Fences go first, then the
    text is read as it is, then its largest balanced object, then with commas before a closing sign taken out and
    open strings, brackets and braces closed."""
    if text is None:
        return None
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text).strip()

    def read(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    if (out := read(body)) is not None:
        return out
    begin = body.find("{")
    if begin < 0:
        return None
    stack, inside, escaped, whole = [], False, False, []
    tail = body[begin:]
    for k, c in enumerate(tail):
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append((c, k))
        elif c in "}]" and stack:
            _, at = stack.pop()
            whole.append((at, k + 1))
    for a, b in sorted(whole, key=lambda x: x[0] - x[1]):
        if not stack and tail[a] == "{" and (out := read(tail[a:b])) is not None:
            return out
    closed = re.sub(r",\s*$", "", tail + '"' * inside) + "".join("}" if c == "{" else "]" for c, _ in reversed(stack))
    return read(re.sub(r",\s*([}\]])", r"\1", closed))


@F.pandas_udf(StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repaired)


def repaired_loosely(text: str | None) -> str | None:
    """The same, and where nothing makes the text valid the fields title, impact and exploitability that it shows, if it shows one of the
    first two."""
    out = repaired(text)
    if out is not None or text is None:
        return out
    shown = {k: m[1] if (m := re.search(rf'"{k}"\s*:\s*"([^"]+)"', text)) else d for k, d in (("title", ""), ("impact", ""), ("exploitability", "unknown"))}
    return json.dumps(shown, separators=(",", ":"), ensure_ascii=False) if shown["title"] or shown["impact"] else None


@F.pandas_udf(StringType())
def repair_loosely(text: pd.Series) -> pd.Series:
    return text.map(repaired_loosely)


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", lineterm="", n=3)) for a, b in zip(before, after)])


def balanced(text: Column | str) -> Column:
    """Whether braces and parentheses outside of strings match."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), "[^(){}]", "")
    start = F.struct(F.lit(True).alias("ok"), F.lit("").alias("open"))

    def step(s: Column, c: Column) -> Column:
        opens = c.isin("(", "{")
        right = F.when(c == ")", "(").otherwise("{")
        fits = F.substring(s["open"], 1, 1) == right
        return F.struct((s["ok"] & (opens | fits)).alias("ok"), F.when(opens, F.concat(c, s["open"])).otherwise(s["open"].substr(F.lit(2), F.length(s["open"]))).alias("open"))

    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, step, lambda s: s["ok"] & (s["open"] == ""))
