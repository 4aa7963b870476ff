"""Explicit schemas of the tables the jobs exchange.  Every table may carry leading partition columns
(``project_id``) that callers pass to operators as ``by=``."""

FILES = "project_id string, path string, name string, extension string, size bigint, text string"
RELATION = "id string, src string, dst string, kind string, confidence string"
EVIDENCE = (
    "id string, path string, ranges array<struct<start_line:int,start_col:int,end_line:int,end_col:int>>, "
    "kind string, detector_id string, role string, scope_path string, strength string"
)
WARNING = "id string, path string, detector_id string, severity string, message string"
SPAN = (
    "trace_id string, span_id string, parent_span_id string, name string, service string, start_raw string, "
    "end_raw string, duration_raw string, format string, path string, line int, attributes map<string,string>, seq bigint"
)
LOG = (
    "trace_id string, span_id string, body string, service string, time_raw string, severity string, format string, "
    "attributes map<string,string>, seq bigint"
)
