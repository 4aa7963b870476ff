"""Clock, duration and attribute expressions for execution records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# Names that are always hidden.
HIDDEN_KEY = r"(?i)authorization|cookie|password|secret|token|credential|api[_.-]?key"
IGNORED_KEYS = ("__proto__", "constructor", "prototype")
HIDDEN_VALUE = "••••"


def duration_ms(start_ns: Column | str, end_ns: Column | str) -> Column:
    """Milliseconds between two nanosecond clocks kept as text; whole microseconds, null when negative.

    Integer decimals keep every digit; the clocks never pass through a double.
    """
    start, end = _c(start_ns).try_cast("decimal(20,0)"), _c(end_ns).try_cast("decimal(20,0)")
    micros = F.floor((end - start) / F.lit(1000).cast("decimal(20,0)"))
    return F.when(end >= start, micros.cast("bigint") / F.lit(1000.0))


def timing_unit(format: Column | str, has_nano: Column, given: Column | str) -> Column:
    """Clock unit of a record by its format; other formats keep what the record states."""
    format = _c(format)
    return (
        F.when(has_nano, F.lit("nanoseconds"))
        .when(format.isin("Jaeger", "Chrome Trace"), F.lit("microseconds"))
        .otherwise(_c(given))
    )


def timing_origin(format: Column | str, has_nano: Column, given: Column | str) -> Column:
    format = _c(format)
    return (
        F.when(has_nano | (format == "Jaeger"), F.lit("Unix epoch"))
        .when(format == "Chrome Trace", F.lit("trace clock"))
        .otherwise(_c(given))
    )


def duration_unit(format: Column | str, raw: Column | str, given: Column | str) -> Column:
    format = _c(format)
    return F.when(_c(raw).isNotNull(), F.when(format.isin("Jaeger", "Chrome Trace"), F.lit("microseconds")).otherwise(_c(given)))


def clean_attributes(attributes: Column | str) -> Column:
    """All entries with whole values; secret keys hidden."""
    entries = F.map_entries(_c(attributes))
    kept = F.filter(entries, lambda item: (item["key"] != "") & ~item["key"].isin(*IGNORED_KEYS))
    shown = lambda item: F.when(item["key"].rlike(HIDDEN_KEY), F.lit(HIDDEN_VALUE)).otherwise(F.coalesce(item["value"], F.lit("")))
    cleaned = F.transform(kept, lambda item: F.struct(item["key"].alias("key"), shown(item).alias("value")))
    return F.map_from_entries(cleaned)


OTLP_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"


def otlp_attributes(pairs: Column | str) -> Column:
    """OTLP ``[{key, value: {stringValue|intValue|…}}]`` as a map; a repeated key keeps its last value."""
    pairs = F.coalesce(_c(pairs), F.array().cast(f"array<struct<key:string,value:{OTLP_VALUE}>>"))
    entries = F.transform(
        pairs,
        lambda item: F.named_struct(
            F.lit("key"),
            item["key"],
            F.lit("value"),
            F.coalesce(*[item["value"][form] for form in ("stringValue", "intValue", "doubleValue", "boolValue")], F.lit("")),
        ),
    )
    return clean_attributes(last_wins_map(entries))


def last_wins_map(entries: Column) -> Column:
    """Map of an entry array in which the last entry of a key counts; sorts the entries, so long arrays stay cheap."""
    named = lambda **parts: F.named_struct(*[piece for name, part in parts.items() for piece in (F.lit(name), part)])
    by_key = F.sort_array(F.transform(entries, lambda item, index: named(key=item["key"], at=index, value=item["value"])))
    following = F.slice(by_key, F.lit(2), F.greatest(F.size(by_key) - 1, F.lit(0)))
    # The shorter array is filled up with null beside the last entry.
    marked = F.zip_with(by_key, following, lambda this, after: named(at=this["at"], key=this["key"], value=this["value"], last=after.isNull() | (after["key"] != this["key"])))
    in_order = F.sort_array(F.filter(marked, lambda item: item["last"]))
    return F.map_from_entries(F.transform(in_order, lambda item: named(key=item["key"], value=item["value"])))
