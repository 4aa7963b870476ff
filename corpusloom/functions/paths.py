"""Path expressions.  All are Column → Column and stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def segments(path: Column | str) -> Column:
    """Non-empty path segments, with backslashes read as slashes."""
    return F.filter(F.split(F.translate(_c(path), "\\", "/"), "/"), lambda part: part != "")


def normalize_path(path: Column | str) -> Column:
    """Slashes unified, one leading ``./`` and empty segments removed; an empty path becomes ``.``."""
    unified = F.regexp_replace(F.translate(_c(path), "\\", "/"), r"^\./", "")
    joined = F.array_join(segments(unified), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dir_name(path: Column | str) -> Column:
    """Everything before the last slash, ``.`` at the top level."""
    column = _c(path)
    return F.when(F.contains(column, F.lit("/")), F.regexp_replace(column, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot, empty when the file name has none."""
    name = F.lower(file_name(path))
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def path_prefixes(path: Column | str, include_self: bool = True) -> Column:
    """All leading directories of a path, shortest first (``a``, ``a/b``, …)."""
    parts = F.split(_c(path), "/")
    last = F.size(parts) if include_self else F.size(parts) - 1
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ancestor_dirs(path: Column | str) -> Column:
    """Directories that contain the path, from ``.`` down to its own directory."""
    return F.concat(F.array(F.lit(".")), F.filter(path_prefixes(path, include_self=False), lambda item: (item != "") & (item != ".")))


def path_suffixes(path: Column | str) -> Column:
    """All trailing parts of a path, shortest first (``c``, ``b/c``, ``a/b/c``)."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))


def _fold(parts: Column, strict: bool) -> Column:
    """Resolve ``.`` and ``..`` by folding over the segments; strict folds fail when leaving the root."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        stack, depth = state["stack"], F.size(state["stack"])
        up = part == ".."
        shorter = F.when(depth > 0, F.slice(stack, 1, F.greatest(depth - 1, F.lit(0)))).otherwise(stack)
        grown = F.when(part == ".", stack).otherwise(F.concat(stack, F.array(part)))
        ok = state["ok"] & ~(up & (depth == 0)) if strict else state["ok"]
        return F.struct(F.when(up, shorter).otherwise(grown).alias("stack"), ok.alias("ok"))

    def finish(state: Column) -> Column:
        joined = F.array_join(state["stack"], "/")
        return F.when(state["ok"], F.when(joined == "", F.lit(".")).otherwise(joined))

    return F.aggregate(parts, start, step, finish)


def safe_join(base: Column | str, child: Column | str) -> Column:
    """Join and resolve ``..``; null when the result would leave the root."""
    return _fold(segments(F.concat_ws("/", _c(base), _c(child))), strict=True)


def join_clamped(base: Column | str, child: Column | str) -> Column:
    """Like :func:`safe_join`, but ``..`` at the root stays at the root."""
    return _fold(segments(F.concat_ws("/", _c(base), _c(child))), strict=False)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a literal glob: ``**`` any text, ``*`` within a segment, ``?`` one character."""
    body = re.sub(r"^\./|/$", "", pattern)
    pieces = re.split(r"(\*\*|\*|\?)", body)
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(piece) or re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", piece) for piece in pieces) + "$"


def glob_to_regex(pattern: Column | str) -> Column:
    """Column form of :func:`glob_regex` for pattern tables."""
    out = F.regexp_replace(_c(pattern), r"^\./|/$", "")
    out = F.regexp_replace(out, r"[.+^${}()|\[\]\\]", r"\\$0")
    out = F.replace(out, F.lit("**"), F.lit("\u0001"))
    out = F.replace(out, F.lit("*"), F.lit("[^/]*"))
    out = F.replace(out, F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(out, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def glob_root(pattern: Column | str) -> Column:
    """The directory before the first wildcard segment; a usable equality key for pattern joins."""
    body = F.regexp_replace(_c(pattern), r"^\./|/$", "")
    fixed = F.regexp_extract(body, r"^((?:[^*?/]+/)*)", 1)
    whole = F.when(body.rlike(r"[*?]"), F.regexp_replace(fixed, "/$", "")).otherwise(dir_name(body))
    return F.when(whole == "", F.lit(".")).otherwise(whole)


# Roots that never name an application scope.
NON_APPLICATION_ROOTS = ("script", "scripts", "spec", "specs", "test", "tests", "tool", "tools")


def config_scope_boundary(path: Column | str) -> Column:
    """Scope a configured source path stands for: the part before its first wildcard and before a nested
    ``src``/``source`` segment; null for test and script roots."""
    parts = F.split(normalize_path(path), "/")
    wild = F.array_position(F.transform(parts, lambda part: part.rlike(r"[*?]")), True)
    fixed = F.when(wild > 0, F.slice(parts, 1, F.greatest(wild.cast("int") - 1, F.lit(0)))).otherwise(
        F.when(
            (F.element_at(parts, -1).rlike(r"\.[^/]+$")) & (F.element_at(parts, -1) != "."),
            F.slice(parts, 1, F.size(parts) - 1),
        ).otherwise(parts)
    )
    below_first = F.when(F.size(fixed) > 1, F.slice(fixed, 2, F.size(fixed))).otherwise(F.array().cast("array<string>"))
    source_at = F.array_position(F.transform(below_first, lambda part: F.lower(part).isin("src", "source")), True)
    kept = F.when(source_at > 0, F.slice(fixed, 1, source_at.cast("int"))).otherwise(fixed)
    joined = F.array_join(kept, "/")
    boundary = F.when(joined.isin("", "."), F.lit(".")).otherwise(joined)
    return F.when(~F.lower(F.get(parts, F.lit(0))).isin(*NON_APPLICATION_ROOTS), boundary)
