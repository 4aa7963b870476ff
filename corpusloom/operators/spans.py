"""Execution spans: duplicates, parents, logs and links to source functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_suffixes
from ..plans import Blocks, cut_lineage, lookup_join, only_value

SPAN_KEY = ("trace_id", "span_id")


def dedupe_spans(spans: DataFrame, by: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """First record of each (trace, span) in input order, with the number of records dropped (each a warning)."""
    rest = [name for name in spans.columns if name not in (*by, *SPAN_KEY)]
    picked = spans.groupBy(*by, *SPAN_KEY).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return picked.select(*by, *SPAN_KEY, "_first.*", "duplicates")


def link_parents(records: DataFrame, spans: DataFrame, parent: str = "parent_span_id", by: Sequence[str] = (), salt: int = 0) -> DataFrame:
    """Attach ``link`` (linked / self / missing, null without a parent) to each record by its explicit parent id.

    One parent may hold a large share of all records; the span side is unique, so ``salt`` can spread it evenly.
    Parents are never inferred from time.
    """
    known = spans.select(*by, "trace_id", F.col("span_id").alias(parent), F.lit(True).alias("_known")).dropDuplicates([*by, "trace_id", parent])
    joined = lookup_join(records, known, [*by, "trace_id", parent], "left", salt)
    has_parent = F.coalesce(F.col(parent), F.lit("")) != "" if dict(records.dtypes)[parent] == "string" else F.col(parent).isNotNull()
    own = F.col(parent) == F.col("span_id") if "span_id" in records.columns and parent != "span_id" else F.lit(False)
    link = F.when(has_parent, F.when(own, "self").when(F.col("_known"), "linked").otherwise("missing"))
    return joined.withColumn("link", link).drop("_known")


def observed_edges(spans: DataFrame, logs: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Parent → child edges of spans and span → log edges, only where both records exist."""
    linked = link_parents(spans, spans, by=by).filter(F.col("link") == "linked")
    out = linked.select(*by, "trace_id", F.col("parent_span_id").alias("src"), F.col("span_id").alias("dst"), F.lit("observed-child").alias("kind"))
    if logs is not None:
        held = link_parents(logs, spans, parent="span_id", by=by).filter(F.col("link") == "linked")
        out = out.unionByName(held.select(*by, "trace_id", F.col("span_id").alias("src"), F.col("seq").cast("string").alias("dst"), F.lit("log-event").alias("kind")))
    return out


def trace_warnings(spans: DataFrame, logs: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts of duplicates and missing parents per trace."""
    firsts = dedupe_spans(spans, by)
    doubled = firsts.groupBy(*by, "trace_id").agg(F.sum("duplicates").alias("n")).filter("n > 0").withColumn("warning", F.lit("duplicate-span"))
    lost = link_parents(firsts, firsts, by=by).filter(F.col("link").isin("missing", "self"))
    out = doubled.unionByName(lost.groupBy(*by, "trace_id").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", F.lit("missing-parent")))
    if logs is not None:
        stray = link_parents(logs, firsts, parent="span_id", by=by).filter(F.col("link") == "missing")
        out = out.unionByName(stray.groupBy(*by, "trace_id").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", F.lit("missing-span")))
    return out


def _pieces(ranges: DataFrame) -> DataFrame:
    """Cut every range of lines [``_from``, ``_to``] into aligned blocks of 1, 4, 16 … lines (``_level``, ``_block``), at most six of a size.

    A line lies in one block of each size, so it meets a range by equality, and ranges that share a block can be aggregated before.
    """
    first = lambda level: f"shiftright(_from + shiftleft(1L, 2 * ({level})) - 1, 2 * ({level}))"
    last = lambda level: f"shiftright(_to + 1, 2 * ({level})) - 1"
    sized = ranges.withColumn("_level", F.expr(f"explode(sequence(0, {TOP_LEVEL}))"))
    sized = sized.selectExpr("*", f"{first('_level')} AS _a", f"{last('_level')} AS _b", f"4 * ({first('_level + 1')}) AS _inner_a", f"4 * ({last('_level + 1')}) + 4 AS _inner_b")
    some = lambda low, high: f"IF({low} <= {high}, sequence({low}, {high}), CAST(array() AS array<bigint>))"
    # Blocks inside a larger one that the range holds as a whole are left to that one.
    blocks = f"IF(_inner_a < _inner_b, concat({some('_a', '_inner_a - 1')}, {some('_inner_b', '_b')}), {some('_a', '_b')})"
    return sized.withColumn("_block", F.explode(F.expr(blocks))).drop("_from", "_to", "_a", "_b", "_inner_a", "_inner_b")


#: The largest block that a range can hold has a quarter of the bits of its length.
TOP_LEVEL = "CAST((length(bin(_to - _from + 1)) - 1) DIV 2 AS INT)"


def bind_spans(spans: DataFrame, functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Source function of each span, only when exactly one fits.

    ``spans``: ``path``, ``function_name``, ``line`` (any may be null); ``functions``: ``fn_id``, ``path``, ``label``,
    ``name``, ``line``, ``end_line``.  A recorded path may carry leading folders the source lacks, so its suffixes are
    joined by equality; lines meet through aligned blocks of lines.  Functions are reduced to their smallest and largest id
    per path, name and block before any span meets them, so no span is paired with all functions that fit it.  The planner takes
    exploded and grouped tables for as small as their source, so their joins are merged, never broadcast by that estimate.  The binding
    is observed when a path was recorded, else inferred.  Functions marked ``initializer`` (the top level of a file) are no candidates.
    """
    if "initializer" in functions.columns:
        functions = functions.filter(~F.coalesce("initializer", F.lit(False)))
    last = F.coalesce("end_line", "line")
    names = F.array_distinct(F.array_compact(F.array("label", "name")))
    defined = functions.select(*by, "fn_id", F.col("path").alias("_path"), names.alias("_names"), F.col("line").cast("long").alias("_from"), last.cast("long").alias("_to"))
    asked = cut_lineage(spans.select(*by, "path", "function_name", "line").distinct())
    key = [*by, "path", "function_name", "line"]
    ends = [F.min("_low").alias("_low"), F.max("_high").alias("_high")]
    ids = [F.col("fn_id").alias("_low"), F.col("fn_id").alias("_high")]
    named = defined.withColumn("function_name", F.explode("_names")).select(*by, "_path", "function_name", "_from", "_to", *ids)
    # A span without a name asks for any function: ``_any`` keeps these apart from an empty name.
    each = named.select(*by, "_path", F.col("function_name").alias("_name"), F.lit(False).alias("_any"), "_from", "_to", "_low", "_high").unionByName(
        defined.select(*by, "_path", F.lit("").alias("_name"), F.lit(True).alias("_any"), "_from", "_to", *ids)
    )
    ranged = each.filter("_from <= _to").groupBy(*by, "_path", "_name", "_any", "_from", "_to").agg(*ends)
    pieces = _pieces(ranged).groupBy(*by, "_path", "_name", "_any", "_level", "_block").agg(*ends)
    longest = F.max(F.when(F.col("_from") <= F.col("_to"), F.expr(TOP_LEVEL))).alias("_top")
    at_levels = lambda rows: rows.withColumn("_level", F.explode(F.sequence(F.lit(0), "_top"))).withColumn("_block", F.expr("shiftright(CAST(line AS BIGINT), 2 * _level)"))

    per_file = defined.select(*by, "_path", "_from", "_to", *ids).groupBy(*by, "_path").agg(*ends, longest)
    located = asked.filter(F.col("path").isNotNull()).withColumn("_path", F.explode(path_suffixes("path"))).join(per_file.hint("merge"), [*by, "_path"])
    by_file = located.filter(F.col("line").isNull() & F.col("function_name").isNull())
    in_file = located.drop("_low", "_high")
    lines = in_file.filter(F.col("line").isNotNull() & F.col("_top").isNotNull())
    lines = at_levels(lines.withColumn("_any", F.col("function_name").isNull()).withColumn("_name", F.coalesce("function_name", F.lit(""))))
    by_line = lines.join(pieces.hint("merge"), [*by, "_path", "_name", "_any", "_level", "_block"])
    per_name_in_file = named.groupBy(*by, "_path", "function_name").agg(*ends)
    by_name = in_file.filter(F.col("line").isNull() & F.col("function_name").isNotNull()).join(per_name_in_file.hint("merge"), [*by, "_path", "function_name"])
    per_name = named.groupBy(*by, "function_name").agg(*ends, longest)
    loose = asked.filter(F.col("path").isNull() & F.col("function_name").isNotNull()).join(per_name.hint("merge"), [*by, "function_name"])
    by_bare = loose.filter(F.col("line").isNull())
    bare_pieces = pieces.filter("not _any").groupBy(*by, F.col("_name").alias("function_name"), "_level", "_block").agg(*ends)
    bare_lines = at_levels(loose.drop("_low", "_high").filter(F.col("line").isNotNull() & F.col("_top").isNotNull()))
    by_bare_line = bare_lines.join(bare_pieces.hint("merge"), [*by, "function_name", "_level", "_block"])

    pairs = by_line.select(*key, "_low", "_high")
    for part in (by_name, by_bare_line, by_file, by_bare):
        pairs = pairs.unionByName(part.select(*key, "_low", "_high"))
    # Null-safe key: absent parts become text markers before grouping and joining.
    marks = [F.to_json(F.struct("path", "function_name", "line")).alias("_asked")]
    best = pairs.select(*by, *marks, "_low", "_high").groupBy(*by, "_asked").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    best = best.select(*by, "_asked", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("fn_id"))
    joined = lookup_join(spans.withColumn("_asked", F.to_json(F.struct("path", "function_name", "line"))), best.hint("merge"), [*by, "_asked"]).drop("_asked")
    return joined.withColumn("confidence", F.when(F.col("fn_id").isNotNull(), F.when(F.col("path").isNotNull(), "observed").otherwise("inferred")))


def boundary_values(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named input/output values of spans (``data.input.name`` / ``data.output.name``) as value nodes and edges."""
    sides = F.array(
        F.struct(F.lit("input").alias("direction"), F.element_at("attributes", "data.input.name").alias("label")),
        F.struct(F.lit("output").alias("direction"), F.element_at("attributes", "data.output.name").alias("label")),
    )
    rows = spans.select("trace_id", "span_id", F.explode(sides).alias("_s")).select("trace_id", "span_id", "_s.*").filter(F.coalesce("label", F.lit("")) != "")
    span = F.concat_ws(":", F.lit("span"), "trace_id", "span_id")
    value = F.concat_ws(":", F.lit("trace-data"), span, "direction")
    nodes = rows.select(value.alias("id"), F.lit("value").alias("kind"), "label", "trace_id", span.alias("owner"), "direction")
    edges = rows.select(
        F.concat(F.lit("observed-data:"), value).alias("id"),
        F.when(F.col("direction") == "input", value).otherwise(span).alias("src"),
        F.when(F.col("direction") == "input", span).otherwise(value).alias("dst"),
        F.lit("observed-data").alias("kind"),
    )
    return nodes, edges


def last_before(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], is_definition: Column, value: Column, out: str = "reaching") -> DataFrame:
    """For every row, the value of the latest definition row at or before it within its key (an as-of join in one pass)."""
    marked = rows.withColumn("_value", F.when(is_definition, value))
    cut = Blocks(marked, keys, order)
    inside = cut.rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(cut.running))
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    carried = cut.carry({"_tail": F.max_by("_value", F.when(F.col("_value").isNotNull(), at))}, {"_before": ("last", "_tail")}, rows=inside)
    return carried.withColumn(out, F.coalesce("_inside", "_before")).drop("_value", "_inside", "_before", "_block")


def bracket_pairs(events: DataFrame, keys: Sequence[str], order: Sequence[Column | str], phase: str = "phase") -> DataFrame:
    """Pair B(egin) and E(nd) events as nested brackets per thread.

    Columns added: ``depth`` (of the bracket), ``orphan`` (an end without a begin).  Depth is the running sum of +1/−1
    minus its running minimum, so it needs no stack and splits over blocks: a block only carries its sum and its lowest
    prefix.  Matching begins and ends are consecutive at their depth (see :func:`complete_brackets`).
    """
    steps = events.withColumn("_step", F.when(F.col(phase) == "B", 1).when(F.col(phase) == "E", -1).otherwise(0))
    cut = Blocks(steps, keys, order)
    summed = cut.rows.withColumn("_sum", F.sum("_step").over(cut.running))
    lows = summed.withColumn("_low", F.min("_sum").over(cut.running))
    totals = lows.groupBy(*keys, "_block").agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_lowest"))
    from pyspark.sql import Window

    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    carry = carry.withColumn("_floor", F.min(F.col("_base") + F.col("_lowest")).over(earlier)).select(*keys, "_block", "_base", "_floor")
    joined = lows.join(carry, [*keys, "_block"])
    height = F.col("_base") + F.col("_sum")
    floor = F.least(F.lit(0), F.coalesce("_floor", F.lit(0)), F.col("_base") + F.col("_low"))
    # An end that sets a new lowest value closes nothing; the floor before it tells.
    before_low = F.least(F.lit(0), F.coalesce("_floor", F.lit(0)), F.coalesce(F.col("_base") + F.min("_sum").over(cut.inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    orphan = (F.col("_step") == -1) & (height < before_low)
    depth = height - floor + F.when(F.col("_step") == -1, 1).otherwise(0)
    return joined.withColumn("orphan", orphan).withColumn("depth", F.when(~orphan, depth)).drop("_step", "_sum", "_low", "_base", "_floor", "_block")


def complete_brackets(paired: DataFrame, keys: Sequence[str], order: Sequence[str], phase: str = "phase", item: str = "event_id") -> DataFrame:
    """One row per begin: its end (null when incomplete) and its parent begin (the open bracket around it)."""
    at = [F.col(o) for o in order]
    inner = paired.filter(~F.col("orphan"))
    cut = Blocks(inner.filter(F.col(phase).isin("B", "E")), [*keys, "depth"], at)
    follow = cut.rows.withColumn("_own", F.lead(F.struct(F.col(phase).alias("phase"), F.col(item).alias("item"))).over(cut.inside))
    first = cut.rows.groupBy(*keys, "depth", "_block").agg(F.min_by(F.struct(F.col(phase).alias("phase"), F.col(item).alias("item")), F.struct(*at)).alias("_first"))
    from pyspark.sql import Window

    later = Window.partitionBy(*keys, "depth").orderBy("_block")
    nxt = first.withColumn("_next_block", F.lead("_first").over(later)).select(*keys, "depth", "_block", "_next_block")
    begins = follow.join(nxt, [*keys, "depth", "_block"]).filter(F.col(phase) == "B")
    after = F.coalesce("_own", "_next_block")
    ends = begins.withColumn("end_item", F.when(after["phase"] == "E", after["item"])).drop("_own", "_next_block", "_block")
    # The parent is the latest begin one level up: an as-of lookup over begins of depth d and d-1.
    up = ends.select(*keys, *order, (F.col("depth")).alias("_level"), F.col(item).alias("_item"), F.lit(True).alias("_is_parent"))
    down = ends.select(*keys, *order, (F.col("depth") - 1).alias("_level"), F.col(item).alias("_item"), F.lit(False).alias("_is_parent"))
    seen = last_before(up.unionByName(down), [*keys, "_level"], [*order, "_item", F.col("_is_parent").cast("int")], F.col("_is_parent"), F.col("_item"), "parent_item")
    parents = seen.filter(~F.col("_is_parent")).select(*keys, F.col("_item").alias(item), "parent_item")
    return lookup_join(ends, parents, [*keys, item])


def attach_instants(events: DataFrame, keys: Sequence[str], order: Sequence[str], paired: DataFrame, item: str = "event_id", phase: str = "phase") -> DataFrame:
    """Open bracket around each instant event (phases i / I): the latest begin at the instant's depth."""
    instants = paired.filter(F.lower(phase) == "i").select(*keys, *order, F.col("depth").alias("_level"), F.col(item).alias("_item"), F.lit(False).alias("_begin"))
    begins = paired.filter(F.col(phase) == "B").select(*keys, *order, F.col("depth").alias("_level"), F.col(item).alias("_item"), F.lit(True).alias("_begin"))
    seen = last_before(begins.unionByName(instants), [*keys, "_level"], [*order, "_item"], F.col("_begin"), F.col("_item"), "span_item")
    found = seen.filter(~F.col("_begin")).select(*keys, F.col("_item").alias(item), F.when(F.col("_level") > 0, F.col("span_item")).alias("span_item"))
    return lookup_join(events.filter(F.lower(phase) == "i"), found, [*keys, item])
