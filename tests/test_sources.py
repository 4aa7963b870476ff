import json

import pytest
from pyspark.sql import functions as F

from conftest import values
from corpusloom.operators import spans as S
from corpusloom.sources import configs as CO
from corpusloom.sources import ddl as DD
from corpusloom.sources import dictionary as DI
from corpusloom.sources import files as FI
from corpusloom.sources import manifests as MA
from corpusloom.sources import store as ST
from corpusloom.sources import traces as TR


def write(root, tree):
    for path, text in tree.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")


def test_scan_select_guard(spark, tmp_path):
    write(
        tmp_path,
        {
            "one/app/package.json": "{}", "one/app/src/A.TS": "x", "one/app/node_modules/p/i.js": "x", "one/app/.env": "S=1", "one/app/build/compile_commands.json": "[]", "one/app/k8s.yaml": "kind: Secret\n", "one/app/note.rst": "n",
            "two/a/x.py": "1", "two/b/y.py": "2",
        },
    )
    files = FI.scan_files(spark, str(tmp_path))
    got = values(files, "project_id", "path", "extension")
    # The shared first folder of a project is removed.
    assert ("one", "src/A.TS", ".ts") in got and ("two", "a/x.py", ".py") in got
    assert not any("node_modules" in row[1] for row in got) and ("one", "build/compile_commands.json", ".json") in got
    chosen = FI.select_inputs(files)
    assert values(chosen, "project_id", "path") == [("one", "build/compile_commands.json"), ("one", "k8s.yaml"), ("one", "package.json"), ("one", "src/A.TS"), ("two", "a/x.py"), ("two", "b/y.py")]
    good, warnings = FI.guard_inputs(chosen)
    assert values(warnings, "path", "reason") == [("k8s.yaml", "secret")] and good.count() == 5


def test_listing_does_not_read_content(spark, tmp_path):
    write(tmp_path, {"p/a.txt": "x"})
    plan = FI.scan_files(spark, str(tmp_path)).select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_follow_references_to_the_end(spark):
    files = spark.createDataFrame([(f"f{i}.props", i) for i in range(20)], "path string, i int")
    # The last file names the first again.
    found = FI.follow_references(files, files.filter("i = 0"), lambda loaded: loaded.select(F.concat(F.lit("f"), ((F.col("i") + 1) % 20).cast("string"), F.lit(".props")).alias("path")))
    assert found.count() == 20


def test_large_inputs_are_read(spark):
    columns = ",\n".join(f"  c{i} decimal(10, 2) not null default (1 + (2))" for i in range(2000))
    tables = spark.createDataFrame([("s.sql", "sql", f"create table big (\n{columns},\n  primary key (c0, c1)\n);")], "path string, language string, text string")
    rows = DD.ddl_rows(tables)
    assert rows["field"].count() == 2000 and values(rows["constraint"], "kind", "columns") == [("primary", ["c0", "c1"])]
    lines = "\n".join(f"    - echo {i}" for i in range(100_000))
    jobs = spark.createDataFrame([(".gitlab-ci.yml", f"build:\n  script:\n{lines}\n\ntest:\n  script:\n    - ok\n")], "path string, text string")
    assert CO.config_resources(jobs)["job"].count() == 100_001
    patterns = "\n".join(f"  - 'apps/a{i}'" for i in range(100_000))
    found, _ = MA.workspace_patterns(spark.createDataFrame([("p", "pnpm-workspace.yaml", f"packages:\n{patterns}\n")], "project_id string, path string, text string"))
    assert found.count() == 100_000
    dependencies = "\n".join(f"  d{i}: ^1.{i}" for i in range(20_000))
    more = ", ".join(f".product(name: \"n{i}\")" for i in range(20_000))
    manifests = [("pubspec.yaml", f"name: x\ndependencies:\n{dependencies}\n"), ("Package.swift", f".package(url: \"https://h/o/kit.git\", from: \"1.0\", traits: [{more}])")]
    listed, _ = MA.manifest_rows(spark.createDataFrame(manifests, "path string, text string"))
    assert listed.filter("ecosystem = 'dart'").count() == 20_000 and values(listed.filter("ecosystem = 'swift'"), "name", "version_range") == [("kit", "1.0")]
    assert FI.guard_inputs(spark.createDataFrame([("a.txt", 5_000_000, "x" * 5_000_000)], "path string, size long, text string"))[0].count() == 1


def test_root_with_pattern_signs(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    write(root, {"one/x.ts": "x", "one/lib/y.ts": "y"})
    assert values(FI.scan_files(spark, str(root)), "project_id", "path") == [("one", "lib/y.ts"), ("one", "x.ts")]


def test_manifest_warnings(spark):
    files = spark.createDataFrame([("a/Cargo.toml", "x = ["), ("b/requirements.txt", "-r more.txt\nflask==1 # web\n\n# c\n"), ("c/pyproject.toml", "[tool.poetry.dependencies]\npython='3'\nrich='^1'")], "path string, text string")
    rows, warnings = MA.manifest_rows(files)
    assert values(rows, "path", "name", "version_range") == [("b/requirements.txt", "flask", "==1"), ("c/pyproject.toml", "rich", "^1")]
    assert values(warnings, "path", "detector_id") == [("a/Cargo.toml", "toml"), ("b/requirements.txt", "requirements-option")]


def test_workspace_config_with_shortest_path_wins(spark):
    files = spark.createDataFrame([("p", "deep/pnpm-workspace.yaml", "packages: ['no']"), ("p", "pnpm-workspace.yaml", "packages:\n  - 'a/*'\n  - '!a/b'\n")], "project_id string, path string, text string")
    patterns, ignored = MA.workspace_patterns(files)
    assert values(patterns, "seq", "pattern") == [(0, "a/*"), (1, "!a/b")] and values(ignored, "path") == [("deep/pnpm-workspace.yaml",)]


def test_config_environments(spark):
    text = '{"name": "w", "account_id": "acc", "r2_buckets": [{"binding": "B", "bucket_name": "b"}], "env": {"dev": {"services": [{"binding": "S", "service": "other"}]}}}'
    rows = CO.config_resources(spark.createDataFrame([("wrangler.json", text)], "path string, text string"))
    assert values(rows["resource"], "type", "binding", "identifier", "account", "environment") == [("R2", "B", "b", "acc", "default"), ("Service binding", "S", "other", "acc", "dev")]


OTLP = {
    "resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}, {"key": "zone", "value": {"stringValue": "eu"}}]}, "scopeSpans": [{"spans": [
        {"traceId": "t", "spanId": "a", "name": "root", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000001250000", "attributes": [{"key": "authorization", "value": {"stringValue": "x"}}, {"key": "code.file.path", "value": {"stringValue": "/srv/src\\app.py"}}, {"key": "code.line.number", "value": {"intValue": "12"}}]},
        {"traceId": "t", "spanId": "b", "parentSpanId": "a", "name": "child", "attributes": [{"key": "zone", "value": {"stringValue": "us"}}]},
    ]}]}],
    "resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"traceId": "t", "spanId": "b", "timeUnixNano": "5", "severityText": "WARN", "body": {"stringValue": "hi"}}]}]}],
}


def documents(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "source_file string, text string")


def test_otlp_spans_logs_and_links(spark):
    spans, logs = TR.otlp_records(documents(spark, OTLP))
    got = {r["span_id"]: r for r in spans.collect()}
    assert len(got) == 2 and got["a"]["duration_ms"] == 1.25 and got["a"]["attributes"]["authorization"] == "••••" and got["a"]["service"] == "shop"
    assert (got["a"]["path"], got["a"]["line"]) == ("/srv/src/app.py", 12)
    assert got["a"]["attributes"]["zone"] == "eu" and got["b"]["attributes"]["zone"] == "us" and got["b"]["duration_ms"] is None
    edges = S.observed_edges(spans.withColumn("seq", F.lit(1)), logs.withColumn("seq", F.lit(7)))
    assert values(edges, "src", "dst", "kind") == [("a", "b", "observed-child"), ("b", "7", "log-event")]
    functions = spark.createDataFrame([("f", "src/app.py", "main", "main", 10, 20), ("g", "src/app.py", "late", "late", 30, 40)], "fn_id string, path string, label string, name string, line int, end_line int")
    bound = S.bind_spans(spans.select("span_id", "path", "function_name", "line"), functions)
    assert values(bound.filter("fn_id is not null"), "span_id", "fn_id", "confidence") == [("a", "f", "observed")]


def test_spans_meet_functions_by_blocks_of_lines_not_one_by_one(spark):
    """Nested, crossing, long and empty ranges under one name against the plain definition; a hot file yields no pairs."""
    import random

    draw = random.Random(5)
    functions = []
    for number in range(300):
        line = draw.choice([draw.randint(1, 40), draw.randint(1, 90_000)])
        functions.append((number, draw.choice(["a.py", "x/a.py", "b.py"]), draw.choice(["f", "g", ""]), draw.choice(["f", "h", None]), draw.choice([line, line, None]), draw.choice([line + draw.randint(-2, 70), line + 50_000, None])))
    spans = [(path, name, draw.choice([None, draw.randint(0, 45), draw.randint(0, 140_000)])) for path in ("/s/x/a.py", "b.py", "none.py", None) for name in ("f", "h", "", None) for _ in range(12)]
    table = spark.createDataFrame(functions, "fn_id long, path string, label string, name string, line int, end_line int")
    asked = spark.createDataFrame(spans, "path string, function_name string, line int").distinct()

    def fits(span, fn):
        path, name, line = span
        end = fn[5] if fn[5] is not None else fn[4]
        in_path = path is None or ("/" + path).endswith("/" + fn[1])
        in_line = line is None or (fn[4] is not None and fn[4] <= line <= end)
        return in_path and in_line and (name is None or name in fn[2:4]) and not (path is None and name is None)

    want = set()
    for span in set(spans):
        found = [fn[0] for fn in functions if fits(span, fn)]
        want.add((*span, found[0] if len(found) == 1 else None))
    got = S.bind_spans(asked, table)
    assert {(r["path"], r["function_name"], r["line"], r["fn_id"]) for r in got.collect()} == want and any(row[3] is not None for row in want)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_log_lines_with_unknown_spans_only_warn(spark):
    lines = documents(spark, {"message": "one", "spanId": "x"}, {"message": "two", "spanId": "y"}, {"nothing": 1})
    spans, logs = TR.structured_records(lines)
    assert spans.count() == 0 and logs.count() == 2
    linked = S.link_parents(logs, spans, parent="span_id")
    assert values(linked, "link") == [("missing",), ("missing",)]


def test_jaeger_child_of(spark):
    doc = {"data": [{"processes": {"p": {"serviceName": "cart"}}, "spans": [
        {"traceID": "t", "spanID": "1", "operationName": "a", "processID": "p", "startTime": 1, "duration": 2500}, {"traceID": "t", "spanID": "2", "operationName": "b", "processID": "p", "references": [{"refType": "FOLLOWS_FROM", "spanID": "9"}, {"refType": "CHILD_OF", "spanID": "1"}]},
    ]}]}
    spans, _ = TR.jaeger_records(documents(spark, doc))
    assert values(spans, "span_id", "parent_span_id", "service", "duration_ms") == [("1", None, "cart", 2.5), ("2", "1", "cart", None)]


def test_overlapping_complete_events_are_not_parents(spark):
    doc = {"traceEvents": [{"ph": "X", "name": "a", "pid": 1, "tid": 1, "ts": 0, "dur": 100}, {"ph": "X", "name": "b", "pid": 1, "tid": 1, "ts": 10, "dur": 20}]}
    spans, logs, warnings = TR.chrome_records(documents(spark, doc))
    assert values(spans, "name", "parent_span_id") == [("a", None), ("b", None)] and logs.count() == 0 and warnings.count() == 0


def test_chrome_begin_end_across_threads(spark):
    event = lambda ph, name, tid, ts: {"ph": ph, "name": name, "pid": 1, "tid": tid, "ts": ts}
    doc = {"traceEvents": [event("B", "a", 1, 0), event("B", "x", 2, 1), event("B", "b", 1, 2), event("E", "", 2, 3), event("i", "note", 1, 4), event("E", "", 1, 5), event("E", "", 2, 6)]}
    spans, logs, warnings = TR.chrome_records(documents(spark, doc))
    assert values(spans, "name", "parent_span_id", "duration_ms") == [("a", None, None), ("b", "chrome-0", 0.003), ("x", None, 0.002)]
    assert values(logs, "body", "span_id") == [("note", "chrome-2")]
    assert values(warnings, "warning", "n") == [("begin-without-end", 1), ("end-without-begin", 1)]


def test_envelope_validation(spark):
    checked = TR.validate_documents(documents(spark, '{"version": 2, "spans": []}', '{"relations": [1]}', '{"data": [{"spans": [{"references": [{"refType": "ODD"}]}]}]}', "text", '{"spans": []}'))
    assert values(checked, "source_file", "error") == [("d0", "unsupported-version"), ("d1", "own-relation-list"), ("d2", "unsupported-reference"), ("d3", "not-json"), ("d4", None)]


def test_store_round_trip_and_dictionary(spark, tmp_path):
    facts = spark.createDataFrame([("p", "1"), ("q", "2")], "project_id string, id string")
    ST.write_store({"fact": facts}, str(tmp_path / "store"))
    assert values(ST.read_store(spark, str(tmp_path / "store"), "fact")["fact"], "project_id", "id") == [("p", "1"), ("q", "2")]
    plan = ST.read_store(spark, str(tmp_path / "store"), "fact")["fact"].filter("project_id = 'p'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan
    # A write that fails in its second table, or is not published, changes nothing; the next one shows both tables at once.
    broken = facts.select("project_id", F.raise_error(F.lit("lost")).cast("string").alias("id"))
    with pytest.raises(Exception, match="lost"):
        ST.write_store({"fact": facts.limit(1), "edge": broken}, str(tmp_path / "store"), version="two")
    assert ST.read_store(spark, str(tmp_path / "store"), "fact")["fact"].count() == 2 and ST.published(spark, str(tmp_path / "store"))[0] == 1
    ST.write_store({"edge": facts.limit(1)}, str(tmp_path / "store"), version="two", keep=True)
    both = ST.read_store(spark, str(tmp_path / "store"), "fact", "edge")
    assert both["fact"].count() == 2 and both["edge"].count() == 1 and ST.published(spark, str(tmp_path / "store"))[0] == 2
    with pytest.raises(FileNotFoundError):
        ST.read_store(spark, str(tmp_path / "none"), "fact")
    write(tmp_path, {"dict/categories/c.json": '{"id": "web", "name": "Web"}\n', "dict/stacks/s.json": '{"id": "vite", "name": "Vite", "category_id": "web", "aliases": ["v"]}\n'})
    categories, stacks = DI.load_dictionary(spark, str(tmp_path / "dict"))
    assert values(DI.map_tree(categories, stacks), "id", "parent_id") == [("category:web", None), ("stack:vite", "category:web")]
