"""Source positions.  Offsets count Unicode code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c


def _before(text: Column, offset: Column) -> Column:
    return F.substring(text, F.lit(1), offset)


def line_at(text: Column | str, offset: Column | str) -> Column:
    """1-based line of an offset."""
    head = _before(_c(text), _c(offset).cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_at(text: Column | str, offset: Column | str) -> Column:
    """1-based column of an offset."""
    head = _before(_c(text), _c(offset).cast("int"))
    return F.length(F.substring_index(head, "\n", -1)) + 1


def places(text: Column | str, word: str) -> Column:
    """1-based ``line`` and ``col`` of every place of ``word``, in order; null without a text.  One pass over the text, whatever the length of a line."""

    def found(content: str | None) -> list[tuple[int, int]] | None:
        if content is None:
            return None
        out = []
        for number, line in enumerate(content.split("\n"), 1):
            at = line.find(word)
            while at >= 0:
                out.append((number, at + 1))
                at = line.find(word, at + len(word))
        return out

    return F.udf(found, "array<struct<line:int,col:int>>", useArrow=True)(_c(text))


def line_count(text: Column | str) -> Column:
    column = _c(text)
    return F.length(column) - F.length(F.replace(column, F.lit("\n"), F.lit(""))) + 1


def evidence_id(detector: Column | str, path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat_ws(":", F.lit("evidence"), _c(detector), _c(path), _c(start).cast("string"), _c(end).cast("string"))


def relation_id(kind: Column, src: Column, dst: Column, suffix: Column | None = None) -> Column:
    parts = [F.lit("relation"), kind, src, dst]
    return F.concat_ws(":", *parts, *([suffix] if suffix is not None else []))


def evidence_range(text: Column | str, start: Column | str, end: Column | str, padding: int = 2) -> Column:
    """Start/end position of a range plus its context window of ``padding`` lines."""
    text, start, end = _c(text), _c(start), _c(end)
    first, last = line_at(text, start), line_at(text, end)
    return F.struct(
        first.alias("start_line"),
        column_at(text, start).alias("start_col"),
        last.alias("end_line"),
        column_at(text, end).alias("end_col"),
        F.greatest(F.lit(1), first - padding).alias("context_start"),
        F.least(line_count(text), F.greatest(first, last) + padding).alias("context_end"),
    )


def evidence_label(path: Column | str, ranges: Column | str) -> Column:
    """``path:start–end`` over an array of position structs; only the path when there are no ranges."""
    ranges = _c(ranges)
    first = F.array_min(F.transform(ranges, lambda item: item["start_line"]))
    last = F.array_max(F.transform(ranges, lambda item: item["end_line"]))
    span = F.concat(F.lit(":"), first.cast("string"), F.when(last > first, F.concat(F.lit("–"), last.cast("string"))).otherwise(""))
    return F.concat(_c(path), F.coalesce(span, F.lit("")))
