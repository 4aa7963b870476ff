"""Execution records: OTLP, Jaeger, Chrome trace and structured JSON → one span and one log schema.

Inputs are tables with ``source_file`` and ``text`` (one document per row; one record per row for JSON Lines), so the
same parsers serve files, message payloads and streams.  Clocks stay exact strings.

Top-level arrays are exploded with the outer form: the inner form makes the optimizer add a size filter that parses every
document a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.traces import OTLP_VALUE, clean_attributes, duration_ms, duration_unit, last_wins_map, otlp_attributes, timing_origin, timing_unit

_KV = f"array<struct<key:string,value:{OTLP_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV}>"
_LOG = f"struct<traceId:string,spanId:string,timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:{OTLP_VALUE},attributes:{_KV}>"
OTLP = (
    f"resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>,instrumentationLibrarySpans:array<struct<spans:array<{_SPAN}>>>>>, "
    f"resourceLogs array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<logRecords:array<{_LOG}>>>,instrumentationLibraryLogs:array<struct<logRecords:array<{_LOG}>>>>>"
)
_TAG = "array<struct<key:string,value:string>>"
JAEGER = (
    f"data array<struct<processes:map<string,struct<serviceName:string>>,spans:array<struct<traceID:string,spanID:string,operationName:string,"
    f"references:array<struct<refType:string,traceID:string,spanID:string>>,startTime:string,duration:string,processID:string,tags:{_TAG},logs:array<struct<timestamp:string,fields:{_TAG}>>>>>>"
)
CHROME = "traceEvents array<struct<ph:string,name:string,cat:string,pid:string,tid:string,ts:string,dur:string,args:map<string,string>>>"
RECORD = (
    "version string, traceId string, trace_id string, spanId string, span_id string, parentSpanId string, parent_span_id string, "
    "name string, operationName string, message string, body string, service string, severityText string, startTimeUnixNano string, endTimeUnixNano string, "
    "timeUnixNano string, duration string, timeUnit string, timeOrigin string, durationUnit string, attributes map<string,string>, filePath string, line string"
)
SPAN_COLUMNS = ("trace_id", "span_id", "parent_span_id", "name", "service", "start_raw", "end_raw", "duration_raw", "duration_ms", "format", "time_unit", "time_origin", "duration_unit", "path", "line", "function_name", "attributes", "source_file", "seq")
LOG_COLUMNS = ("trace_id", "span_id", "body", "service", "time_raw", "severity", "format", "attributes", "source_file", "seq")


def _empty() -> Column:
    return F.lit(None).cast("string")



def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Trace files as (``source_file``, ``text``): whole documents, or one JSON Lines record per row."""
    raw = spark.read.text(path, wholetext=not lines)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def _spans(rows: DataFrame) -> DataFrame:
    """Columns every format shares, derived from the attributes and raw clocks."""
    pick = lambda *keys: F.coalesce(*[F.element_at("attributes", key) for key in keys])
    nano = F.col("format").isin("OTLP") | F.col("_nano")
    ms = F.coalesce(F.when(nano, duration_ms("start_raw", "end_raw")), F.col("duration_raw").try_cast("double") / 1000)
    own_path = F.col("_path") if "_path" in rows.columns else _empty()
    own_line = F.col("_line") if "_line" in rows.columns else _empty()
    given = lambda name: F.col(name) if name in rows.columns else _empty()
    return rows.select(
        "trace_id", "span_id", "parent_span_id", F.col("name").alias("name"), "service", "start_raw", "end_raw", "duration_raw", ms.alias("duration_ms"), "format",
        timing_unit("format", nano, given("_time_unit")).alias("time_unit"), timing_origin("format", nano, given("_time_origin")).alias("time_origin"),
        duration_unit("format", "duration_raw", given("_duration_unit")).alias("duration_unit"),
        F.translate(F.coalesce(pick("code.file.path", "code.filepath"), own_path), "\\", "/").alias("path"),
        F.coalesce(pick("code.line.number", "code.lineno"), own_line).try_cast("int").alias("line"),
        pick("code.function.name", "code.function").alias("function_name"), "attributes", "source_file", "seq",
    )


def otlp_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans and logs of OTLP JSON; resource attributes are inherited, own attributes win."""
    parsed = documents.select("source_file", F.from_json("text", OTLP).alias("d"))
    resources = parsed.select("source_file", F.posexplode_outer("d.resourceSpans").alias("r", "item")).filter("item is not null")
    scopes = resources.select("source_file", "r", otlp_attributes("item.resource.attributes").alias("inherited"), F.posexplode(F.coalesce("item.scopeSpans", "item.instrumentationLibrarySpans")).alias("s", "scope"))
    spans = scopes.select("source_file", "r", "s", "inherited", F.posexplode("scope.spans").alias("n", "x")).withColumn("own", otlp_attributes("x.attributes"))
    merged = lambda: F.map_concat(F.map_filter("inherited", lambda key, _: ~F.map_contains_key(F.col("own"), key)), "own")
    span_rows = spans.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.coalesce("x.name", F.lit("span")).alias("name"),
        F.coalesce(F.element_at("inherited", "service.name"), F.lit("")).alias("service"), F.col("x.startTimeUnixNano").alias("start_raw"), F.col("x.endTimeUnixNano").alias("end_raw"),
        _empty().alias("duration_raw"), F.lit("OTLP").alias("format"), F.lit(True).alias("_nano"), merged().alias("attributes"), "source_file", F.struct("r", "s", "n").alias("seq"),
    )
    held = parsed.select("source_file", F.posexplode_outer("d.resourceLogs").alias("r", "item")).filter("item is not null")
    held = held.select("source_file", "r", otlp_attributes("item.resource.attributes").alias("inherited"), F.posexplode(F.coalesce("item.scopeLogs", "item.instrumentationLibraryLogs")).alias("s", "scope"))
    logs = held.select("source_file", "r", "s", "inherited", F.posexplode("scope.logRecords").alias("n", "x")).withColumn("own", otlp_attributes("x.attributes"))
    body = F.coalesce("x.body.stringValue", "x.body.intValue", "x.body.doubleValue", "x.body.boolValue", F.lit("log"))
    log_rows = logs.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), body.alias("body"), F.coalesce(F.element_at("inherited", "service.name"), F.lit("")).alias("service"),
        F.coalesce("x.timeUnixNano", "x.observedTimeUnixNano").alias("time_raw"), F.col("x.severityText").alias("severity"), F.lit("OTLP").alias("format"), merged().alias("attributes"), "source_file", F.struct("r", "s", "n").alias("seq"),
    )
    return _spans(span_rows), log_rows


def jaeger_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (parent from CHILD_OF only) and their events as logs."""
    traces = documents.select("source_file", F.posexplode_outer(F.from_json("text", JAEGER)["data"]).alias("r", "t")).filter("t is not null")
    spans = traces.select("source_file", "r", "t.processes", F.posexplode("t.spans").alias("n", "x"))
    service = F.coalesce(F.element_at("processes", F.col("x.processID"))["serviceName"], F.lit(""))
    tags = clean_attributes(last_wins_map(F.coalesce("x.tags", F.array().cast(_TAG))))
    parent = F.get(F.filter("x.references", lambda ref: ref["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    rows = spans.select(
        F.col("x.traceID").alias("trace_id"), F.col("x.spanID").alias("span_id"), parent.alias("parent_span_id"), F.coalesce("x.operationName", F.lit("span")).alias("name"), service.alias("service"),
        F.col("x.startTime").alias("start_raw"), _empty().alias("end_raw"), F.col("x.duration").alias("duration_raw"), F.lit("Jaeger").alias("format"), F.lit(False).alias("_nano"),
        tags.alias("attributes"), "source_file", F.struct("r", F.lit(0).alias("s"), "n").alias("seq"),
    )
    events = spans.select("source_file", "r", "n", service.alias("service"), F.col("x.traceID").alias("trace_id"), F.col("x.spanID").alias("span_id"), F.posexplode("x.logs").alias("k", "e"))
    fields = clean_attributes(last_wins_map(F.coalesce("e.fields", F.array().cast(_TAG))))
    events = events.withColumn("attributes", fields)
    body = F.coalesce(F.element_at("attributes", "event"), F.element_at("attributes", "message"), F.lit("span event"))
    logs = events.select("trace_id", "span_id", body.alias("body"), "service", F.col("e.timestamp").alias("time_raw"), _empty().alias("severity"), F.lit("Jaeger").alias("format"), "attributes", "source_file", F.struct("r", "n", "k").alias("seq"))
    return _spans(rows), logs


def chrome_events(documents: DataFrame) -> DataFrame:
    """Raw trace events with their thread and position."""
    events = documents.select("source_file", F.posexplode_outer(F.from_json("text", CHROME)["traceEvents"]).alias("n", "x")).filter("x is not null")
    thread = F.concat_ws(":", F.coalesce("x.pid", F.lit("")), F.coalesce("x.tid", F.lit("")))
    return events.select("source_file", F.col("n").cast("bigint").alias("n"), thread.alias("thread"), F.col("x.ph").alias("phase"), "x.name", F.coalesce(F.nullif("x.cat", F.lit("")), F.concat(F.lit("process "), F.coalesce("x.pid", F.lit("")))).alias("service"), "x.ts", "x.dur", "x.args")


def chrome_records(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, logs and warning counts of Chrome trace events.

    X events are complete spans without parents (overlap is not parentage); B/E events pair as nested brackets per
    thread in file order; instants become logs of the open span; metadata is ignored, other phases are counted.
    """
    from ..operators.spans import attach_instants, bracket_pairs, complete_brackets
    from ..plans import cut_lineage

    events = cut_lineage(chrome_events(documents))
    keys, order = ["source_file", "thread"], ["n"]
    args = clean_attributes(F.coalesce("args", F.from_json(F.lit("{}"), "map<string,string>")))
    span_id = lambda column: F.concat(F.lit("chrome-"), F.col(column).cast("string"))
    shape = lambda trace, parent, end, duration, attributes: [
        trace.alias("trace_id"), span_id("n").alias("span_id"), parent.alias("parent_span_id"), F.coalesce("name", F.lit("span")).alias("name"), "service", F.col("ts").alias("start_raw"), end.alias("end_raw"),
        duration.alias("duration_raw"), F.lit("Chrome Trace").alias("format"), F.lit(False).alias("_nano"), attributes.alias("attributes"), "source_file", F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"), F.col("n").cast("int").alias("n")).alias("seq"),
    ]
    whole = events.filter("phase = 'X'").select(*shape(F.lit(""), _empty(), _empty(), F.col("dur"), args))
    nested = events.filter("phase in ('B', 'E', 'i', 'I')")
    paired = cut_lineage(bracket_pairs(nested, keys, order))
    spans = complete_brackets(paired, keys, order, item="n")
    ends = nested.filter("phase = 'E'").select("source_file", F.col("n").alias("end_item"), F.col("ts").alias("_end_ts"))
    closed = spans.join(ends, ["source_file", "end_item"], "left")
    duration = (F.col("_end_ts").try_cast("double") - F.col("ts").try_cast("double")).cast("string")
    open_mark = F.map_concat(F.map_filter(args, lambda key, _: key != "incomplete"), F.create_map(F.lit("incomplete"), F.lit("true")))
    marked = F.when(F.col("end_item").isNull(), open_mark).otherwise(args)
    chrome_trace = F.concat(F.lit("chrome:"), "thread")
    parent = F.when(F.col("parent_item").isNotNull(), span_id("parent_item"))
    bracket = closed.select(*shape(chrome_trace, parent, F.col("_end_ts"), duration, marked))
    instants = attach_instants(nested, keys, order, paired, item="n")
    logs = instants.select(
        chrome_trace.alias("trace_id"), F.when(F.col("span_item").isNotNull(), span_id("span_item")).alias("span_id"), F.coalesce("name", F.lit("log")).alias("body"), "service", F.col("ts").alias("time_raw"),
        _empty().alias("severity"), F.lit("Chrome Trace").alias("format"), args.alias("attributes"), "source_file", F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"), F.col("n").cast("int").alias("n")).alias("seq"),
    )
    known = ("X", "B", "E", "i", "I", "M")
    counts = events.filter(~F.col("phase").isin(*known)).groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", F.lit("unsupported-phase"))
    orphans = paired.filter("orphan").groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", F.lit("end-without-begin"))
    unfinished = spans.filter("end_item is null").groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", F.lit("begin-without-end"))
    return _spans(whole.unionByName(bracket)), logs, counts.unionByName(orphans).unionByName(unfinished)


def structured_rows(documents: DataFrame) -> DataFrame:
    """Records of structured JSON: JSON Lines rows, arrays, ``{spans, logs}`` envelopes or single objects."""
    text = F.trim("text")
    listed = F.when(text.startswith("["), F.from_json("text", "array<string>")).otherwise(
        F.when(
            F.get_json_object("text", "$.spans").isNotNull() | F.get_json_object("text", "$.logs").isNotNull(),
            F.concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("spans", "logs")]),
        ).otherwise(F.array("text"))
    )
    return documents.select("source_file", F.posexplode(listed).alias("n", "record")).select(
        # Spellings that differ only in case cannot share one struct.
        "*", F.from_json("record", RECORD).alias("x"), F.get_json_object("record", "$.traceID").alias("_trace"), F.get_json_object("record", "$.spanID").alias("_span")
    )


def record_kind(x: str = "x", other_span: str = "_span") -> Column:
    """log with a message, body or severity; span with a span id, start or operation; else log; null without a name."""
    f = lambda name: F.coalesce(F.col(f"{x}.{name}"), F.lit("")) != ""
    has_name = f("name") | f("message") | f("body") | f("operationName")
    is_log = f("message") | f("body") | f("severityText")
    is_span = f("spanId") | (F.coalesce(F.col(other_span), F.lit("")) != "") | f("startTimeUnixNano") | f("operationName")
    return F.when(has_name, F.when(is_log, "log").when(is_span, "span").otherwise("log"))


def structured_records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = structured_rows(documents).withColumn("kind", record_kind())
    trace, span = F.coalesce("x.traceId", "_trace", "x.trace_id", F.lit("")), F.coalesce("x.spanId", "_span", "x.span_id", F.lit(""))
    attributes = clean_attributes(F.coalesce("x.attributes", F.from_json(F.lit("{}"), "map<string,string>")))
    seq = F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"), "n").alias("seq")
    spans = rows.filter("kind = 'span'").select(
        trace.alias("trace_id"), span.alias("span_id"), F.nullif(F.coalesce("x.parentSpanId", "x.parent_span_id"), F.lit("")).alias("parent_span_id"), F.coalesce("x.name", "x.operationName", F.lit("span")).alias("name"),
        F.coalesce("x.service", F.lit("")).alias("service"), F.col("x.startTimeUnixNano").alias("start_raw"), F.col("x.endTimeUnixNano").alias("end_raw"), F.col("x.duration").alias("duration_raw"),
        F.lit("structured").alias("format"), F.coalesce("x.startTimeUnixNano", "x.endTimeUnixNano", "x.timeUnixNano").isNotNull().alias("_nano"), attributes.alias("attributes"),
        F.col("x.filePath").alias("_path"), F.col("x.line").alias("_line"), F.col("x.timeUnit").alias("_time_unit"), F.col("x.timeOrigin").alias("_time_origin"), F.col("x.durationUnit").alias("_duration_unit"), "source_file", seq,
    )
    logs = rows.filter("kind = 'log'").select(
        trace.alias("trace_id"), span.alias("span_id"), F.coalesce("x.name", "x.operationName", "x.message", "x.body").alias("body"), F.coalesce("x.service", F.lit("")).alias("service"),
        F.col("x.timeUnixNano").alias("time_raw"), F.col("x.severityText").alias("severity"), F.lit("structured").alias("format"), attributes.alias("attributes"), "source_file", seq,
    )
    return _spans(spans), logs


def validate_spans(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good spans, and errors: a span id is always required, a trace id for OTLP and Jaeger."""
    blank = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    error = F.when(blank("span_id"), "missing-span-id").when(F.col("format").isin("OTLP", "Jaeger") & blank("trace_id"), "missing-trace-id")
    marked = spans.withColumn("error", error)
    return marked.filter(F.col("error").isNull()).drop("error"), marked.filter(F.col("error").isNotNull())


def validate_documents(documents: DataFrame) -> DataFrame:
    """One row per document with its ``format`` and ``error`` (null when acceptable), and a warning count for
    FOLLOWS_FROM references."""
    has = lambda key: F.get_json_object("text", f"$.{key}").isNotNull()
    format_ = F.when(has("resourceSpans") | has("resourceLogs"), "OTLP").when(has("traceEvents"), "Chrome Trace").when(has("data"), "Jaeger").otherwise("structured")
    lists = lambda key: F.coalesce(F.get_json_object("text", f"$.{key}"), F.lit("[]")).rlike(r"^\s*\[\s*\]$")
    version = F.get_json_object("text", "$.version")
    kinds = F.regexp_extract_all("text", F.lit(r"\"refType\"\s*:\s*\"([^\"]*)\""), F.lit(1))
    error = (
        F.when(~F.col("text").rlike(r"^\s*[\[{]"), "not-json")
        .when((format_ == "structured") & version.isNotNull() & (version != "1"), "unsupported-version")
        .when(~lists("edges") | ~lists("relations"), "own-relation-list")
        .when(F.exists(kinds, lambda kind: ~kind.isin("CHILD_OF", "FOLLOWS_FROM")), "unsupported-reference")
    )
    follows = F.size(F.filter(kinds, lambda kind: kind == "FOLLOWS_FROM"))
    return documents.select("source_file", format_.alias("format"), error.alias("error"), follows.alias("follows_from"))
