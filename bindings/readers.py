"""Readers and scalar functions on documents, pages and generated project files.

Project files and traces are derived row by row from the driver tables, so the readers' work grows with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import commands as CF
from corpusloom.functions import imports as IF
from corpusloom.functions import names as NF
from corpusloom.functions import paths as PF
from corpusloom.functions import secrets as SF
from corpusloom.functions import text as XF
from corpusloom.operators import imports as IM
from corpusloom.sources import assets as AS
from corpusloom.sources import configs as CO
from corpusloom.sources import ddl as DD
from corpusloom.sources import dictionary as DI
from corpusloom.sources import files as FI
from corpusloom.sources import locks as LO
from corpusloom.sources import manifests as MA
from corpusloom.plans import checkpoint_folder, spread
from corpusloom.sources import traces as TR
from corpusloom.sources.store import read_store, write_store

from .registry import EDGES, NODES, PAGES, edges, nodes, page_paths, query, s

c = F.col


def _kv(**pairs):
    """OTLP key/value list of string (or prepared) values."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value")) for k, v in pairs.items()])


def _otlp(t):
    span = F.struct(
        c("event_type").alias("traceId"), c("event_id").cast("string").alias("spanId"), F.when(c("event_id") % 3 > 0, (c("event_id") - 1).cast("string")).alias("parentSpanId"), c("event_type").alias("name"),
        F.lit("1700000000000000000").alias("startTimeUnixNano"), F.concat(F.lit("17"), F.lpad((c("event_id") * 1000 + 999).cast("string"), 17, "0")).alias("endTimeUnixNano"),
        F.concat(_kv(Authorization=F.lit("x")), _kv(size=c("value"))).alias("attributes"),
    )
    log = F.struct(c("event_type").alias("traceId"), c("event_id").cast("string").alias("spanId"), F.lit("1700000000000000000").alias("timeUnixNano"), F.struct(s("message ", c("user_id")).alias("stringValue")).alias("body"))
    resource = F.struct(F.concat(*[F.array(F.struct(F.lit("service.name").alias("key"), F.struct(s("svc", c("user_id") % 7).alias("stringValue")).alias("value")))]).alias("attributes"))
    doc = F.struct(
        F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"),
        F.when(c("event_id") % 2 == 0, F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(log).alias("logRecords"))).alias("scopeLogs")))).alias("resourceLogs"),
    )
    return t.events.select(s("f", c("event_id") % 10).alias("source_file"), F.to_json(doc).alias("text"))


@query(
    "otlp_spans",
    """SELECT event_id::VARCHAR AS span_id, CASE WHEN event_id % 3 > 0 THEN (event_id - 1)::VARCHAR END AS parent_span_id, 'svc' || (user_id % 7) AS service, event_id / 1000.0 AS duration_ms, '••••' AS hidden, 'nanoseconds' AS time_unit FROM events""",
)
def otlp_spans(t):
    spans, _ = TR.otlp_records(_otlp(t))
    return spans.select("span_id", "parent_span_id", "service", "duration_ms", c("attributes")["Authorization"].alias("hidden"), "time_unit")


@query("otlp_logs", "SELECT event_id::VARCHAR AS span_id, 'message ' || user_id AS body, 'svc' || (user_id % 7) AS service FROM events WHERE event_id % 2 = 0")
def otlp_logs(t):
    _, logs = TR.otlp_records(_otlp(t))
    return logs.select("span_id", "body", "service")


def _jaeger(t):
    kind = F.when(c("event_id") % 4 == 0, "FOLLOWS_FROM").otherwise("CHILD_OF")
    tag = F.array(F.struct(F.lit("password").alias("key"), F.lit("x").alias("value")), F.struct(F.lit("code.lineno").alias("key"), (c("event_id") % 50).cast("string").alias("value")))
    span = F.struct(
        c("event_type").alias("traceID"), c("event_id").cast("string").alias("spanID"), c("event_type").alias("operationName"), F.array(F.struct(kind.alias("refType"), c("event_type").alias("traceID"), (c("event_id") - 1).cast("string").alias("spanID"))).alias("references"),
        F.lit("1000").alias("startTime"), (c("event_id") * 10).cast("string").alias("duration"), F.lit("p1").alias("processID"), tag.alias("tags"),
        F.when(c("event_id") % 5 == 0, F.array(F.struct(F.lit("77").alias("timestamp"), F.array(F.struct(F.lit("event").alias("key"), c("event_type").alias("value"))).alias("fields")))).alias("logs"),
    )
    doc = F.struct(F.array(F.struct(F.create_map(F.lit("p1"), F.struct(s("svc", c("user_id") % 7).alias("serviceName"))).alias("processes"), F.array(span).alias("spans"))).alias("data"))
    return t.events.select(F.lit("j").alias("source_file"), F.to_json(doc).alias("text"))


@query(
    "jaeger_spans",
    """SELECT event_id::VARCHAR AS span_id, CASE WHEN event_id % 4 <> 0 THEN (event_id - 1)::VARCHAR END AS parent_span_id, 'svc' || (user_id % 7) AS service, event_id * 10 / 1000.0 AS duration_ms, (event_id % 50)::INT AS line, 'microseconds' AS duration_unit FROM events""",
)
def jaeger_spans(t):
    spans, _ = TR.jaeger_records(_jaeger(t))
    return spans.select("span_id", "parent_span_id", "service", "duration_ms", "line", "duration_unit")


@query("jaeger_logs", "SELECT event_id::VARCHAR AS span_id, event_type AS body, '77' AS time_raw FROM events WHERE event_id % 5 = 0")
def jaeger_logs(t):
    _, logs = TR.jaeger_records(_jaeger(t))
    return logs.select("span_id", "body", "time_raw")


def _chrome(t):
    at = lambda n: (c("event_id") * 100 + n).cast("string").alias("ts")
    event = lambda ph, name, n: F.struct(F.lit(ph).alias("ph"), F.lit(name).alias("name"), F.lit("1").alias("pid"), F.lit("2").alias("tid"), at(n), F.lit("30").alias("dur"))
    base = [event("B", "outer", 0), event("i", "mark", 5), event("B", "inner", 10), event("E", "inner", 30), event("X", "whole", 40), event("M", "meta", 41), event("Z", "odd", 42)]
    tail = F.when(c("event_id") % 2 == 0, F.array(event("E", "outer", 90), event("E", "extra", 95))).otherwise(F.array(event("i", "late", 91)))
    doc = F.struct(F.concat(F.array(*base), tail).alias("traceEvents"))
    return t.events.select(s("t", c("event_id")).alias("source_file"), F.to_json(doc).alias("text"))


@query(
    "chrome_spans",
    """WITH e AS (SELECT 't' || event_id AS source_file, event_id % 2 = 0 AS done FROM events)
  SELECT source_file, 'outer' AS name, NULL::VARCHAR AS parent_span_id, CASE WHEN done THEN 0.09::DOUBLE END AS duration_ms FROM e
  UNION ALL SELECT source_file, 'inner', 'chrome-0', 0.02 FROM e UNION ALL SELECT source_file, 'whole', NULL, 0.03 FROM e""",
)
def chrome_spans(t):
    spans, _, _ = TR.chrome_records(_chrome(t))
    return spans.select("source_file", "name", "parent_span_id", "duration_ms")


@query(
    "chrome_logs",
    """SELECT 't' || event_id AS source_file, 'mark' AS body, 'chrome-0' AS span_id FROM events
  UNION ALL SELECT 't' || event_id, 'late', 'chrome-0' FROM events WHERE event_id % 2 = 1""",
)
def chrome_logs(t):
    _, logs, _ = TR.chrome_records(_chrome(t))
    return logs.select("source_file", "body", "span_id")


@query(
    "chrome_warnings",
    """WITH e AS (SELECT event_id % 2 = 0 AS done FROM events) SELECT 'unsupported-phase' AS warning, count(*) AS n FROM e
  UNION ALL SELECT 'end-without-begin', count(*) FROM e WHERE done UNION ALL SELECT 'begin-without-end', count(*) FROM e WHERE NOT done""",
)
def chrome_warnings(t):
    _, _, warnings = TR.chrome_records(_chrome(t))
    return warnings.groupBy("warning").agg(F.sum("n").alias("n"))


def _structured(t):
    record = F.struct(
        F.when(c("event_type") == "view", c("event_type")).alias("message"), F.when(c("event_type") != "click", c("event_type")).alias("name"), F.when(c("event_type") == "purchase", c("event_id").cast("string")).alias("spanId"),
        F.when(c("event_type") == "purchase", F.lit("7")).alias("startTimeUnixNano"), F.lit("svc").alias("service"),
    )
    return t.events.select(F.lit("s").alias("source_file"), F.to_json(record).alias("text"))


@query("structured_records", "SELECT CASE WHEN event_type = 'purchase' THEN 'span' ELSE 'log' END AS kind, event_type AS label, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY ALL")
def structured_records(t):
    spans, logs = TR.structured_records(_structured(t))
    both = spans.select(F.lit("span").alias("kind"), c("name").alias("label")).unionByName(logs.select(F.lit("log").alias("kind"), c("body").alias("label")))
    return both.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_documents",
    """SELECT CASE event_type WHEN 'view' THEN 'OTLP' WHEN 'click' THEN 'Jaeger' ELSE 'structured' END AS format, CASE event_type WHEN 'error' THEN 'unsupported-version' WHEN 'signup' THEN 'own-relation-list' END AS error,
  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS follows_from, count(*) AS n FROM events GROUP BY ALL""",
)
def validate_documents(t):
    text = (
        F.when(c("event_type") == "view", '{"resourceSpans": []}').when(c("event_type") == "click", '{"data": [{"spans": [{"references": [{"refType": "FOLLOWS_FROM"}]}]}]}')
        .when(c("event_type") == "error", '{"version": 2, "spans": []}').when(c("event_type") == "signup", '{"edges": [1]}').otherwise('{"version": 1, "name": "x"}')
    )
    checked = TR.validate_documents(t.events.select(F.lit("f").alias("source_file"), text.alias("text")))
    return checked.groupBy("format", "error").agg(F.sum("follows_from").alias("follows_from"), F.count(F.lit(1)).alias("n"))


@query(
    "validate_spans",
    """SELECT CASE WHEN user_id % 5 = 0 THEN 'missing-span-id' WHEN user_id % 5 = 1 AND event_type = 'view' THEN 'missing-trace-id' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1""",
)
def validate_spans(t):
    spans = t.events.select(
        F.when(c("user_id") % 5 == 0, " ").otherwise(c("event_id").cast("string")).alias("span_id"), F.when(c("user_id") % 5 != 1, "t").alias("trace_id"), F.when(c("event_type") == "view", "OTLP").otherwise("structured").alias("format")
    )
    good, bad = TR.validate_spans(spans)
    both = good.select(F.lit("ok").alias("outcome")).unionByName(bad.select(c("error").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _package_files(t):
    """One package.json per part, some with comments and trailing commas."""
    body = F.concat(
        F.lit('{ // package\n "name": "'), c("p_name"), F.lit('", "main": "lib/'), c("p_partkey").cast("string"), F.lit('.js",\n "scripts": {"build": "tsc", "size": "echo '), c("p_size").cast("string"), F.lit('"},\n "dependencies": {"'),
        F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit('": "^'), c("p_size").cast("string"), F.lit('.0.0"},\n "devDependencies": {"https-x": "http://a//b"'), F.when(c("p_size") % 2 == 0, ",").otherwise(""), F.lit("}, /* c */"),
        F.when(c("p_size") % 3 == 0, '"exports": {".": {"import": "./m.js"}, "./sub": "./s.js"}').otherwise('"exports": "./only.js"'), F.lit(", }"),
    )
    text = F.when(c("p_partkey") % 50 == 7, "not json").otherwise(body)
    return spread(t.part).select(s("pkg/", c("p_partkey"), "/package.json").alias("path"), text.alias("text"))


@query(
    "package_dependencies",
    """SELECT 'pkg/' || p_partkey AS package_path, lower(p_type) AS name, '^' || p_size || '.0.0' AS version_range, 'dependency' AS dependency_type FROM part WHERE p_partkey % 50 <> 7
  UNION ALL SELECT 'pkg/' || p_partkey, 'https-x', 'http://a//b', 'devDependency' FROM part WHERE p_partkey % 50 <> 7""",
)
def package_dependencies(t):
    return MA.package_rows(_package_files(t))["dependency"].select("package_path", "name", "version_range", "dependency_type")


@query(
    "package_rows",
    """WITH g AS (SELECT * FROM part WHERE p_partkey % 50 <> 7) SELECT 'package' AS kind, p_name AS value, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'script', 'build=tsc', count(*) FROM g UNION ALL SELECT 'script', 'size=echo ' || p_size, count(*) FROM g GROUP BY 2
  UNION ALL SELECT 'export', v, count(*) FROM (SELECT unnest(CASE WHEN p_size % 3 = 0 THEN ['.=./m.js', './sub=./s.js'] ELSE ['.=./only.js'] END) AS v FROM g) GROUP BY v UNION ALL SELECT 'warning', 'package-json', count(*) FROM part WHERE p_partkey % 50 = 7""",
)
def package_rows(t):
    rows = MA.package_rows(_package_files(t))
    both = lambda a, b: F.concat(a, F.lit("="), b)
    parts = (
        rows["package"].select(F.lit("package").alias("kind"), c("name").alias("value"))
        .unionByName(rows["script"].select(F.lit("script").alias("kind"), both("name", "command").alias("value")))
        .unionByName(rows["export"].select(F.lit("export").alias("kind"), both("subpath", "target").alias("value")))
        .unionByName(rows["warning"].select(F.lit("warning").alias("kind"), c("detector_id").alias("value")))
    )
    return parts.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def _pick(column, *texts):
    """Choose a text by ``column`` modulo the number of texts."""
    out = None
    for i, text in enumerate(texts):
        test = column % len(texts) == i
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def _manifest_files(t):
    k, n = c("p_partkey"), c("p_size").cast("string")
    name = _pick(k, "requirements-dev.txt", "go.mod", "pom.xml", "build.gradle", "Gemfile", "pubspec.yaml", "Cargo.toml", "pyproject.toml", "App.csproj", "composer.json", "Package.swift", "deno.json")
    text = _pick(
        k,
        F.concat(F.lit("# head\nflask[async]>="), n, F.lit(" ; python_version>'3'\n-r other.txt\n")),
        F.concat(F.lit("module x\nrequire (\n\tgithub.com/a/b v1."), n, F.lit(".0\n\tgithub.com/c/d v1.0.0 // indirect\n)\nreplace (\n\tq => ./q v2\n)\n")),
        F.concat(F.lit("<project><dependencyManagement><dependency><artifactId>no</artifactId></dependency></dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>"), n, F.lit("</version><scope>test</scope></dependency></dependencies></project>")),
        F.concat(F.lit("dependencies {\n // implementation 'x:y:1'\n implementation 'g:a:"), n, F.lit("'\n testImplementation(\"h:b\")\n}\n")),
        F.concat(F.lit("source 'x'\ngem 'rails', '~> "), n, F.lit("'\n")),
        F.concat(F.lit("name: x\ndependencies:\n  http: ^"), n, F.lit("\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  test: any\n")),
        F.concat(F.lit("[package]\nname='x'\n[dependencies]\nserde = { version = \""), n, F.lit("\" }\n[dev-dependencies]\nrand = \"1\"\n")),
        F.concat(F.lit("[project]\nname='x'\ndependencies=['httpx>="), n, F.lit("']\n[project.optional-dependencies]\ntest=['pytest']\n")),
        F.concat(F.lit('<Project><ItemGroup><PackageReference Include="Newton" Version="'), n, F.lit('" /></ItemGroup></Project>')),
        F.concat(F.lit('{"require": {"php": "8", "a/b": "^'), n, F.lit('"}, "require-dev": {"c/d": "1"}}')),
        F.concat(F.lit('let p = Package(dependencies: [.package(url: "https://x/y/Zip.git", from: "'), n, F.lit('")])')),
        F.concat(F.lit('{"imports": {"z": "npm:zod@'), n, F.lit('", "l": "./local.ts"}}')),
    )
    return spread(t.part).select(F.concat(s("m/", k, "/"), name).alias("path"), text.alias("text"))


@query(
    "manifest_rows",
    """WITH p AS (SELECT p_partkey % 12 AS f, p_size::VARCHAR AS v FROM part) SELECT ecosystem, name, version_range, dependency_type, count(*) AS n FROM (
  SELECT 'pypi' AS ecosystem, 'flask' AS name, '>=' || v AS version_range, 'dependency' AS dependency_type FROM p WHERE f = 0 UNION ALL SELECT 'go', 'github.com/a/b', 'v1.' || v || '.0', 'dependency' FROM p WHERE f = 1
  UNION ALL SELECT 'maven', 'g:a', v, 'devDependency' FROM p WHERE f = 2 UNION ALL SELECT 'maven', 'g:a', v, 'dependency' FROM p WHERE f = 3 UNION ALL SELECT 'maven', 'h:b', '*', 'devDependency' FROM p WHERE f = 3
  UNION ALL SELECT 'gem', 'rails', '~> ' || v, 'dependency' FROM p WHERE f = 4 UNION ALL SELECT 'dart', 'http', '^' || v, 'dependency' FROM p WHERE f = 5 UNION ALL SELECT 'dart', 'flutter', '*', 'dependency' FROM p WHERE f = 5
  UNION ALL SELECT 'dart', 'test', 'any', 'devDependency' FROM p WHERE f = 5 UNION ALL SELECT 'cargo', 'serde', v, 'dependency' FROM p WHERE f = 6 UNION ALL SELECT 'cargo', 'rand', '1', 'devDependency' FROM p WHERE f = 6
  UNION ALL SELECT 'pypi', 'httpx', '>=' || v, 'dependency' FROM p WHERE f = 7 UNION ALL SELECT 'pypi', 'pytest', '*', 'devDependency' FROM p WHERE f = 7 UNION ALL SELECT 'nuget', 'Newton', v, 'dependency' FROM p WHERE f = 8
  UNION ALL SELECT 'composer', 'a/b', '^' || v, 'dependency' FROM p WHERE f = 9 UNION ALL SELECT 'composer', 'c/d', '1', 'devDependency' FROM p WHERE f = 9 UNION ALL SELECT 'swift', 'Zip', v, 'dependency' FROM p WHERE f = 10
  UNION ALL SELECT 'npm', 'zod', v, 'dependency' FROM p WHERE f = 11) GROUP BY ALL""",
)
def manifest_rows(t):
    rows, _ = MA.manifest_rows(_manifest_files(t))
    return rows.groupBy("ecosystem", "name", "version_range", "dependency_type").agg(F.count(F.lit(1)).alias("n"))


def _project_files(t):
    """One manifest per part in a form that declares projects, commands or members; names and commands come from the part."""
    k, name, n = c("p_partkey"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), c("p_size").cast("string")
    file = _pick(k, "pyproject.toml", "Cargo.toml", "go.work", "settings.gradle", "setup.cfg", "build.sbt", "All.sln", "New.slnx", "kit.gemspec", "composer.json", "pom.xml", "package.json", "deno.json", "gradle/libs.versions.toml")
    text = _pick(
        k,
        F.concat(F.lit("[project]\nname = \""), name, F.lit("\" # own\ndependencies = [\n  \"httpx["), n, F.lit("]>=1\",\n]\n[project.scripts]\nrun = \"pkg."), n, F.lit(":main\"\n[tool.uv.workspace]\nmembers = [\"libs/*\", 'apps/"), n, F.lit("']\n")),
        F.concat(F.lit("[package]\nname='"), name, F.lit("'\n[workspace]\nmembers = [\n  \"a"), n, F.lit("\", # first\n]\n[dependencies.tokio]\nversion = \""), n, F.lit("\"\n[target.'cfg(unix)'.dependencies]\nnix = { path = \"../nix\", version = \"1\" }\n")),
        F.concat(F.lit("go 1.22\nuse (\n\t./api"), n, F.lit(" // x\n\t\"./web\"\n)\n")),
        F.concat(F.lit("include(':core:p"), n, F.lit("', \":web\")\ntasks.register(\"t"), n, F.lit("\") {}\n")),
        F.concat(F.lit("[metadata]\nname = "), name, F.lit("\n[options]\ninstall_requires =\n    requests>="), n, F.lit(" ; python_version<'3'\n    six\nzip_safe = no\n")),
        F.concat(F.lit("name := \""), name, F.lit("\"\nlibraryDependencies += \"org.a\" %% \"b\" % \"1."), n, F.lit("\"\n")),
        F.concat(F.lit('Project("{F}") = "App", "App'), n, F.lit('\\App.csproj", "{1}"\nEndProject\n')),
        F.concat(F.lit('<Solution><Project Path="App'), n, F.lit('/App.csproj" /></Solution>')),
        F.concat(F.lit("Gem::Specification.new do |s|\n  s.name = '"), name, F.lit("'\n  s.add_dependency 'rack', '>= "), n, F.lit("'\n  s.add_development_dependency 'rake'\nend\n")),
        F.concat(F.lit('{"name": "v/'), name, F.lit('", "scripts": {"check": ["lint '), n, F.lit('", "test"]}}')),
        F.concat(F.lit("<project><artifactId>"), name, F.lit("</artifactId><properties><v>"), n, F.lit("</v></properties><modules><module>core</module></modules><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>")),
        F.concat(F.lit('{"name": "'), name, F.lit('", "packageManager": "pnpm@9", "scripts": {"build": "tsc -p '), n, F.lit('"}, "workspaces": ["libs/*"]}')),
        F.concat(F.lit('{"tasks": {"dev": "run '), n, F.lit('"}, "workspace": ["a"], "lock": "d.lock", "imports": {"l": "../l.ts"}}')),
        F.concat(F.lit("[versions]\nv = \""), n, F.lit("\"\n[libraries]\njson-core = { module = \"org.j:core\", version.ref = \"v\" }\n")),
    )
    return spread(t.part).select(F.lit("p").alias("project_id"), F.concat(s("m", k, "/"), file).alias("path"), text.alias("text"))


_PARTS = "WITH p AS (SELECT p_partkey AS k, p_partkey % 14 AS f, lower(replace(p_type, ' ', '-')) AS name, p_size::VARCHAR AS n FROM part)"


@query(
    "manifest_projects",
    f"""{_PARTS} SELECT 'm' || k || CASE WHEN f = 2 THEN '/go.work' WHEN f = 3 THEN '/settings.gradle' WHEN f = 6 THEN '/All.sln' WHEN f = 7 THEN '/New.slnx' WHEN f = 12 THEN '/deno.json' ELSE
  '/' || ['pyproject.toml', 'Cargo.toml', '', '', 'setup.cfg', 'build.sbt', '', '', 'kit.gemspec', 'composer.json', 'pom.xml', 'package.json'][f + 1] END AS path, 'm' || k AS directory,
  ['pypi', 'cargo', 'go', 'maven', 'pypi', 'maven', 'nuget', 'nuget', 'gem', 'composer', 'maven', 'npm', 'npm'][f + 1] AS ecosystem,
  CASE WHEN f IN (2, 3, 12) THEN 'm' || k WHEN f = 6 THEN 'All' WHEN f = 7 THEN 'New' WHEN f = 9 THEN 'v/' || name ELSE name END AS name FROM p WHERE f < 13""",
)
def manifest_projects(t):
    return MA.manifest_facts(_project_files(t)).filter("fact = 'project'").select("path", "directory", "ecosystem", "name")


@query(
    "manifest_commands",
    f"""{_PARTS} SELECT 'm' || k AS directory, 'run' AS name, 'pkg.' || n || ':main' AS command, 'entry-point' AS purpose FROM p WHERE f = 0 UNION ALL SELECT 'm' || k, 't' || n, 'gradle t' || n, 'build-task' FROM p WHERE f = 3
  UNION ALL SELECT 'm' || k, 'check', 'lint ' || n, NULL FROM p WHERE f = 9 UNION ALL SELECT 'm' || k, 'check:1', 'test', NULL FROM p WHERE f = 9 UNION ALL SELECT 'm' || k, 'build', 'tsc -p ' || n, NULL FROM p WHERE f = 11
  UNION ALL SELECT 'm' || k, 'dev', 'run ' || n, NULL FROM p WHERE f = 12""",
)
def manifest_commands(t):
    return MA.manifest_facts(_project_files(t)).filter("fact = 'command'").select("directory", "name", c("value").alias("command"), c("kind").alias("purpose"))


@query(
    "manifest_members",
    f"""{_PARTS} SELECT 'm' || k AS directory, 'member' AS fact, v AS value FROM (SELECT k, unnest(CASE f WHEN 0 THEN ['libs/*', 'apps/' || n] WHEN 1 THEN ['a' || n] WHEN 2 THEN ['./api' || n, './web'] WHEN 3 THEN ['core/p' || n, 'web']
    WHEN 6 THEN ['App' || n || '/App.csproj'] WHEN 7 THEN ['App' || n || '/App.csproj'] WHEN 10 THEN ['core'] WHEN 11 THEN ['libs/*'] WHEN 12 THEN ['a'] ELSE [] END) AS v FROM p)
  UNION ALL SELECT 'm' || k, 'reference', CASE f WHEN 1 THEN '../nix' ELSE '../l.ts' END FROM p WHERE f IN (1, 12)
  UNION ALL SELECT 'm' || k, 'tool', v FROM (SELECT k, unnest(CASE f WHEN 0 THEN ['uv'] WHEN 1 THEN ['cargo'] WHEN 3 THEN ['gradle'] WHEN 6 THEN ['dotnet'] WHEN 7 THEN ['dotnet'] WHEN 9 THEN ['composer'] WHEN 10 THEN ['maven'] WHEN 11 THEN ['pnpm'] WHEN 12 THEN ['deno'] ELSE [] END) AS v FROM p)""",
)
def manifest_members(t):
    return MA.manifest_facts(_project_files(t)).filter("fact in ('member', 'reference', 'tool')").select("directory", "fact", "value")


@query(
    "manifest_forms",
    f"""{_PARTS} SELECT ecosystem, name, version_range, dependency_type, count(*) AS n FROM (
  SELECT 'pypi' AS ecosystem, 'httpx' AS name, '>=1' AS version_range, 'dependency' AS dependency_type FROM p WHERE f = 0 UNION ALL SELECT 'cargo', 'tokio', n, 'dependency' FROM p WHERE f = 1 UNION ALL SELECT 'cargo', 'nix', '1', 'dependency' FROM p WHERE f = 1
  UNION ALL SELECT 'pypi', 'requests', '>=' || n, 'dependency' FROM p WHERE f = 4 UNION ALL SELECT 'pypi', 'six', '*', 'dependency' FROM p WHERE f = 4 UNION ALL SELECT 'maven', 'org.a:b', '1.' || n, 'dependency' FROM p WHERE f = 5
  UNION ALL SELECT 'gem', 'rack', '>= ' || n, 'dependency' FROM p WHERE f = 8 UNION ALL SELECT 'gem', 'rake', '*', 'devDependency' FROM p WHERE f = 8 UNION ALL SELECT 'maven', 'g:a', n, 'dependency' FROM p WHERE f = 10) GROUP BY ALL""",
)
def manifest_forms(t):
    rows, _ = MA.manifest_rows(_project_files(t))
    return rows.groupBy("ecosystem", "name", "version_range", "dependency_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "store_roundtrip",
    f"""WITH {EDGES}, {NODES} SELECT "group" AS project_id, 'fact' AS kind, count(*) AS n, min(id) AS low, max(id) AS high FROM n GROUP BY ALL
  UNION ALL SELECT e.kind, 'relation', count(*), min(id), max(id) FROM e GROUP BY ALL""",
)
def store_roundtrip(t):
    """Facts and relations as a store gives them back; a version that was never published lies beside them."""
    path = f"{checkpoint_folder(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    facts, relations = nodes(t).withColumnRenamed("group", "project_id"), edges(t).withColumn("project_id", c("kind"))
    write_store({"fact": facts}, path)
    write_store({"relation": relations}, path, keep=True)
    facts.limit(1).write.parquet(f"{path}/version-unpublished/fact")
    held = read_store(t.spark, path, "fact", "relation")
    counted = lambda name: held[name].groupBy("project_id", F.lit(name).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    return counted("fact").unionByName(counted("relation"))


def _lock_files(t):
    k, n = c("p_partkey"), F.concat(c("p_size").cast("string"), F.lit(".1.0"))
    name = _pick(k, "package-lock.json", "yarn.lock", "Cargo.lock", "uv.lock", "composer.lock", "packages.lock.json", "bun.lock", "deno.lock", "pubspec.lock", "Package.resolved", "yarn.lock")
    text = _pick(
        k,
        F.concat(F.lit('{"packages": {"": {"version": "0"}, "node_modules/a": {"version": "'), n, F.lit('"}, "node_modules/l": {"link": true}, "node_modules/x/node_modules/@s/b": {"version": "git+x"}}}')),
        F.concat(F.lit('# yarn lockfile v1\n\n\na@^1, a@^2:\n  version "'), n, F.lit('"\n  resolved "x"\n\n"@s/b@~1":\n  version "2.0.0"\n')),
        F.concat(F.lit('version = 3\n\n[[package]]\nname = "serde"\nversion = "'), n, F.lit('"\nsource = "registry+x"\n')),
        F.concat(F.lit('version = 1\n\n[[package]]\nname = "flask"\nversion = "'), n, F.lit('"\nsource = { registry = "https://p" }\n')),
        F.concat(F.lit('{"packages": [{"name": "a/b", "version": "v'), n, F.lit('"}], "packages-dev": [{"name": "c/d", "version": "dev-main"}]}')),
        F.concat(F.lit('{"version": 1, "dependencies": {"net8.0": {"Newton": {"type": "Direct", "resolved": "'), n, F.lit('"}, "own": {"type": "Project"}}}}')),
        F.concat(F.lit('{"lockfileVersion": 1, "packages": {"a": ["a@'), n, F.lit('", "", {}, "sha"], "q/a": ["a@9.9.9", "", {}],}}')),
        F.concat(F.lit('{"version": "4", "specifiers": {"npm:zod@3": "'), n, F.lit('", "jsr:x@1": "1.0.0"}}')),
        F.concat(F.lit('packages:\n  http:\n    dependency: direct\n    version: "'), n, F.lit('"\nsdks:\n  dart: x\n')),
        F.concat(F.lit('{"pins": [{"identity": "zip", "state": {"version": "'), n, F.lit('"}}], "version": 2}')),
        F.concat(F.lit('__metadata:\n  version: 6\n\n"a@npm:^1, a@npm:^2":\n  version: '), n, F.lit('\n  resolution: "a@npm:1"\n')),
    )
    return spread(t.part).select(F.concat(s("m/", k, "/"), name).alias("path"), text.alias("text"))


@query(
    "lock_rows",
    """WITH p AS (SELECT p_partkey % 11 AS f, p_size || '.1.0' AS v FROM part) SELECT ecosystem, name, version, descriptor, unsupported, count(*) AS n FROM (
  SELECT 'npm' AS ecosystem, 'a' AS name, v AS version, NULL AS descriptor, FALSE AS unsupported FROM p WHERE f = 0 UNION ALL SELECT 'npm', '@s/b', 'git+x', NULL, TRUE FROM p WHERE f = 0
  UNION ALL SELECT 'npm', 'a', v, d, FALSE FROM p, (SELECT unnest(['^1', '^2']) AS d) WHERE f IN (1, 10) UNION ALL SELECT 'npm', '@s/b', '2.0.0', '~1', FALSE FROM p WHERE f = 1
  UNION ALL SELECT 'cargo', 'serde', v, NULL, FALSE FROM p WHERE f = 2 UNION ALL SELECT 'pypi', 'flask', v, NULL, FALSE FROM p WHERE f = 3 UNION ALL SELECT 'composer', 'a/b', 'v' || v, NULL, FALSE FROM p WHERE f = 4
  UNION ALL SELECT 'composer', 'c/d', 'dev-main', NULL, FALSE FROM p WHERE f = 4 UNION ALL SELECT 'nuget', 'Newton', v, NULL, FALSE FROM p WHERE f = 5 UNION ALL SELECT 'npm', 'a', v, NULL, FALSE FROM p WHERE f = 6
  UNION ALL SELECT 'npm', 'zod', v, '3', FALSE FROM p WHERE f = 7 UNION ALL SELECT 'dart', 'http', v, NULL, FALSE FROM p WHERE f = 8 UNION ALL SELECT 'swift', 'zip', v, NULL, FALSE FROM p WHERE f = 9) GROUP BY ALL""",
)
def lock_rows(t):
    return LO.lock_rows(_lock_files(t)).groupBy("ecosystem", "name", "version", "descriptor", "unsupported").agg(F.count(F.lit(1)).alias("n"))


@query(
    "workspace_patterns",
    """SELECT 'r' || n_regionkey AS project_id, (CASE WHEN k % 2 = 0 THEN ['packages/*', '!packages/' || k, 'apps/**'] ELSE ['libs/*', 'x' || k] END)[i + 1] AS pattern, i::INT AS seq
  FROM (SELECT n_regionkey, min(n_nationkey) AS k FROM nation GROUP BY 1), (SELECT unnest([0, 1, 2]) AS i) WHERE k % 2 = 0 OR i < 2""",
)
def workspace_patterns(t):
    k = c("n_nationkey").cast("string")
    block = F.concat(F.lit("packages:\n  # all\n  - 'packages/*'\n  - \"!packages/"), k, F.lit('"\n\n  - apps/** # deep\nother: x\n'))
    inline = F.concat(F.lit("packages: ['libs/*', \"x"), k, F.lit('"]\n'))
    files = t.nation.select(
        s("r", c("n_regionkey")).alias("project_id"), F.concat(F.repeat(F.lit("d/"), (c("n_nationkey") / 5).cast("int")), F.lit("pnpm-workspace.yaml")).alias("path"), F.when(c("n_nationkey") % 2 == 0, block).otherwise(inline).alias("text")
    )
    patterns, _ = MA.workspace_patterns(files)
    return patterns.select("project_id", "pattern", "seq")


def _config_files(t):
    k = c("s_suppkey")
    name = _pick(k, "wrangler.jsonc", "firebase.json", "template.json", "nginx.conf", ".gitlab-ci.yml")
    worker = F.concat(F.lit('{"name": "w'), k.cast("string"), F.lit('", "main": "src/i.ts", // x\n "d1_databases": [{"binding": "DB", "database_id": "id'), k.cast("string"), F.lit('"}], "env": {"prod": {"kv_namespaces": [{"binding": "KV", "id": "kv"}]}}}'))
    firebase = F.concat(F.lit('{"hosting": {"site": "s'), k.cast("string"), F.lit('", "public": "dist"}, "emulators": {"auth": {"port": 9100}, "firestore": {}, "ui": {"enabled": true}}}'))
    template = F.concat(F.lit('{"Resources": {"Cdn": {"Type": "AWS::CloudFront::Distribution", "Properties": {"DistributionConfig": {"Origins": [{"Id": "o", "DomainName": "h'), k.cast("string"), F.lit('.example"}]}}}, "B": {"Type": "AWS::S3::Bucket"}}}'))
    nginx = F.concat(F.lit("upstream app { server 10.0.0."), k.cast("string"), F.lit(":80; server b; }\nserver { location / { proxy_pass http://app/x; } # proxy_pass http://no;\n}\n"))
    ci = F.concat(F.lit("stages: [a]\nbuild:\n  script:\n    - make "), k.cast("string"), F.lit("\n    - make all\n.hidden:\n  script:\n    - no\ntest:\n  needs: [build]\n  script:\n    - pytest\n"))
    return t.supplier.select(F.concat(s("c/", k, "/"), name).alias("path"), _pick(k, worker, firebase, template, nginx, ci).alias("text"))


@query(
    "config_resources",
    """WITH p AS (SELECT s_suppkey AS k, s_suppkey % 5 AS f FROM supplier) SELECT 'D1' AS type, 'DB' AS binding, 'id' || k AS identifier, 'default' AS environment, NULL AS endpoint FROM p WHERE f = 0 UNION ALL SELECT 'KV', 'KV', 'kv', 'prod', NULL FROM p WHERE f = 0
  UNION ALL SELECT 'emulator', 'auth', NULL, 'local', 'http://127.0.0.1:9100' FROM p WHERE f = 1 UNION ALL SELECT 'emulator', 'firestore', NULL, 'local', 'http://127.0.0.1:8080' FROM p WHERE f = 1
  UNION ALL SELECT 'hosting', 's' || k, 's' || k, 'cloud', 'dist' FROM p WHERE f = 1 UNION ALL SELECT 'cdn-distribution', 'Cdn', 'o', 'cloud', 'h' || k || '.example' FROM p WHERE f = 2
  UNION ALL SELECT 'proxy-pass', 'app', NULL, 'configured', 'http://app/x' FROM p WHERE f = 3 UNION ALL SELECT 'upstream-server', 'app', NULL, 'configured', '10.0.0.' || k || ':80' FROM p WHERE f = 3 UNION ALL SELECT 'upstream-server', 'app', NULL, 'configured', 'b' FROM p WHERE f = 3""",
)
def config_resources(t):
    return CO.config_resources(_config_files(t))["resource"].select("type", "binding", "identifier", "environment", "endpoint")


@query(
    "ci_jobs",
    """WITH p AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 = 4) SELECT 'build' AS job, 'make ' || k AS command, NULL AS needs FROM p UNION ALL SELECT 'build', 'make all', NULL FROM p UNION ALL SELECT 'test', 'pytest', NULL FROM p UNION ALL SELECT 'test', NULL, 'build' FROM p""",
)
def ci_jobs(t):
    rows = CO.config_resources(_config_files(t))
    none = F.lit(None).cast("string")
    return rows["job"].select("job", "command", none.alias("needs")).unionByName(rows["need"].select("job", none.alias("command"), "needs"))


@query("worker_runtimes", "SELECT 'w' || s_suppkey AS name, 'src/i.ts' AS main, 'default' AS environment FROM supplier WHERE s_suppkey % 5 = 0")
def worker_runtimes(t):
    return CO.config_resources(_config_files(t))["runtime"].select("name", "main", "environment")


@query(
    "asset_refs",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'unpkg' ELSE 'jsdelivr' END AS stack_id, CASE page_id % 3 WHEN 0 THEN 'lib' || page_id WHEN 1 THEN '@s/p' END AS package_name,
  CASE page_id % 3 WHEN 0 THEN 'https://unpkg.com/lib' || page_id || '@1/x.js?token=[redacted]' WHEN 1 THEN 'https://cdn.jsdelivr.net/npm/@s/p@2' ELSE 'https://cdn.jsdelivr.net/gh/u/r' END AS href FROM pages""",
)
def asset_refs(t):
    k = c("page_id")
    extra = _pick(
        k, F.concat(F.lit('<script src="https://unpkg.com/lib'), k.cast("string"), F.lit('@1/x.js?token=abc"></script><img src="https://evil.unpkg.com/a">')),
        F.lit("<link rel='stylesheet' href='//cdn.jsdelivr.net/npm/@s/p@2'><script src=\"https://u:p@unpkg.com/a\"></script>"), F.lit("<style>@import url('https://cdn.jsdelivr.net/gh/u/r');</style>"),
    )
    return AS.asset_refs(t.pages.select("page_id", F.concat("html", extra).alias("text"))).select("page_id", "stack_id", "package_name", "href")


@query(
    "resolve_links",
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS t FROM pages), k AS (SELECT DISTINCT t FROM h),
  a AS (SELECT page_id, t, count(DISTINCT CASE WHEN k IN (SELECT t FROM k) THEN k END) AS n, min(CASE WHEN k IN (SELECT t FROM k) THEN k END) AS hit FROM (SELECT page_id, t, unnest([t, t || ',', t || '.']) AS k FROM h) GROUP BY ALL)
  SELECT t AS specifier, CASE WHEN n = 1 THEN hit END AS resolved_path, CASE WHEN n = 0 THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' END AS reason, count(*) AS pages FROM a GROUP BY ALL""",
)
def resolve_links(t):
    links = t.pages.select("page_id", F.explode(AS.anchors("html")).alias("specifier"))
    known = links.select(c("specifier").alias("path")).distinct()
    asked = links.select("page_id", "specifier").distinct()
    pages = asked.groupBy("specifier").agg(F.count(F.lit(1)).alias("pages"))
    variants = F.array("specifier", F.concat("specifier", F.lit(",")), F.concat("specifier", F.lit(".")))
    answers = IM.resolve_candidates(pages.select("specifier", variants.alias("candidates")), known, ["specifier"])
    return answers.join(pages, "specifier")


def _schema_files(t):
    k = c("p_partkey")
    n = k.cast("string")
    sql = F.concat(
        F.lit("-- CREATE TABLE no (x int);\nCREATE TABLE IF NOT EXISTS \"t"), n, F.lit("\" (\n id INTEGER PRIMARY KEY, amount DECIMAL(10, 2) NOT NULL DEFAULT 0,\n owner_id INT REFERENCES owner"), (k % 5).cast("string"), F.lit("(id), note TEXT,\n UNIQUE (owner_id, note), CHECK (amount > (1 + 2)),\n FOREIGN KEY (owner_id, id) REFERENCES other (a, b)\n);"),
        F.when(k % 4 == 0, "\nALTER TABLE x ADD y int;").otherwise(""),
    )
    prisma = F.concat(F.lit("model U"), n, F.lit(" {\n id Int @id @default(autoincrement())\n post P? @relation(fields: [pid], references: [id])\n pid Int? // c\n}\nmodel P {\n id Int @id\n}\n"))
    graphql = F.concat(F.lit("type Q"), n, F.lit(" {\n me(id: ID!): U!\n n: Int\n}\ntype U { \n id: ID!\n}\n"))
    return spread(t.part).select(s("db/", k).alias("path"), _pick(k, "sql", "prisma", "graphql").alias("language"), _pick(k, sql, prisma, graphql).alias("text"))


@query(
    "ddl_fields",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS f FROM part) SELECT label, name, type, nullable, key, target, default_value, count(*) AS n FROM (
  SELECT 't' || k AS label, 'id' AS name, 'INTEGER' AS type, FALSE AS nullable, 'primary' AS key, NULL AS target, NULL AS default_value FROM p WHERE f = 0 UNION ALL SELECT 't' || k, 'amount', 'DECIMAL(10, 2)', FALSE, NULL, NULL, '0' FROM p WHERE f = 0
  UNION ALL SELECT 't' || k, 'owner_id', 'INT', TRUE, 'foreign', 'owner' || (k % 5), NULL FROM p WHERE f = 0 UNION ALL SELECT 't' || k, 'note', 'TEXT', TRUE, NULL, NULL, NULL FROM p WHERE f = 0
  UNION ALL SELECT 'U' || k, 'id', 'Int', FALSE, 'primary', NULL, 'autoincrement()' FROM p WHERE f = 1 UNION ALL SELECT 'U' || k, 'post', 'P?', TRUE, 'foreign', 'P', NULL FROM p WHERE f = 1 UNION ALL SELECT 'U' || k, 'pid', 'Int?', TRUE, NULL, NULL, NULL FROM p WHERE f = 1
  UNION ALL SELECT 'P', 'id', 'Int', FALSE, 'primary', NULL, NULL FROM p WHERE f = 1 UNION ALL SELECT 'Q' || k, 'me', 'U!', FALSE, NULL, 'U', NULL FROM p WHERE f = 2 UNION ALL SELECT 'Q' || k, 'n', 'Int', TRUE, NULL, NULL, NULL FROM p WHERE f = 2 UNION ALL SELECT 'U', 'id', 'ID!', FALSE, NULL, NULL, NULL FROM p WHERE f = 2) GROUP BY ALL""",
)
def ddl_fields(t):
    rows = DD.ddl_rows(_schema_files(t))["field"]
    return rows.groupBy("label", "name", "type", "nullable", "key", "target", "default_value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ddl_constraints",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS f FROM part) SELECT kind, cols, target, target_cols, count(*) AS n FROM (
  SELECT 'unique' AS kind, 'owner_id,note' AS cols, NULL AS target, '' AS target_cols FROM p WHERE f = 0 UNION ALL SELECT 'check', '', NULL, '' FROM p WHERE f = 0 UNION ALL SELECT 'foreign', 'owner_id,id', 'other', 'a,b' FROM p WHERE f = 0
  UNION ALL SELECT 'primary', 'id', NULL, '' FROM p WHERE f = 0 UNION ALL SELECT 'foreign', 'owner_id', 'owner' || (k % 5), '' FROM p WHERE f = 0 UNION ALL SELECT 'orm-relation', 'pid', 'P', 'id' FROM p WHERE f = 1) GROUP BY ALL""",
)
def ddl_constraints(t):
    rows = DD.ddl_rows(_schema_files(t))["constraint"]
    return rows.groupBy("kind", F.array_join("columns", ",").alias("cols"), "target", F.array_join("target_columns", ",").alias("target_cols")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ddl_models",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS f FROM part) SELECT coverage, count(*) AS n FROM (SELECT CASE WHEN k % 4 = 0 THEN 'partial' ELSE 'complete' END AS coverage FROM p WHERE f = 0 UNION ALL SELECT 'complete' FROM p, (SELECT unnest([1, 2])) WHERE f > 0) GROUP BY 1""",
)
def ddl_models(t):
    return DD.ddl_rows(_schema_files(t))["model"].groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


def _paths(t):
    """Documents as paths in ordinary, excluded and sensitive places."""
    k = c("doc_id")
    folder = _pick(k, "src", "node_modules/x", "Build", "lib/tmp", "app")
    name = _pick(k % 7, s("m", k, ".ts"), ".env.local", s("secret-", k, ".json"), "compile_commands.json", s("key", k, ".PEM"), "package.json", s("doc", k, ".rst"))
    return t.documents.select("doc_id", c("lang").alias("project_id"), F.concat("lang", F.lit("/"), folder, F.lit("/"), name).alias("path"), "text", (c("n_chars") * 100).alias("size"))


PATHS = """d AS (SELECT doc_id, lang, text, n_chars * 100 AS size, (['src', 'node_modules/x', 'Build', 'lib/tmp', 'app'])[doc_id % 5 + 1] AS folder,
  CASE doc_id % 7 WHEN 0 THEN 'm' || doc_id || '.ts' WHEN 1 THEN '.env.local' WHEN 2 THEN 'secret-' || doc_id || '.json' WHEN 3 THEN 'compile_commands.json' WHEN 4 THEN 'key' || doc_id || '.PEM' WHEN 5 THEN 'package.json' ELSE 'doc' || doc_id || '.rst' END AS name FROM documents),
  fp AS (SELECT *, lang || '/' || folder || '/' || name AS path, folder IN ('src', 'app') OR (name = 'compile_commands.json' AND folder = 'Build') AS kept, doc_id % 7 IN (1, 2, 4) AS sensitive FROM d)"""


@query("path_predicates", f"WITH {PATHS} SELECT doc_id, kept, sensitive FROM fp")
def path_predicates(t):
    return _paths(t).select("doc_id", FI.not_excluded("path").alias("kept"), FI.is_sensitive("path").alias("sensitive"))


@query(
    "select_inputs",
    f"WITH {PATHS} SELECT doc_id, doc_id % 7 IN (3, 5) AS is_config, doc_id % 7 = 0 AS is_usage, doc_id % 7 = 0 AS is_semantic FROM fp WHERE kept AND doc_id % 7 IN (0, 3, 5)",
)
def select_inputs(t):
    return FI.select_inputs(_paths(t)).select("doc_id", "is_config", "is_usage", "is_semantic")


@query(
    "guard_inputs",
    f"WITH {PATHS} SELECT project_id, 'secret' AS reason, count(*) AS n FROM (SELECT lang AS project_id, * FROM fp) WHERE doc_id % 7 IN (2, 3, 5) AND doc_id % 3 = 0 GROUP BY ALL",
)
def guard_inputs(t):
    marked = _paths(t).withColumn("text", F.when(c("doc_id") % 3 == 0, F.concat(F.lit("a: b\nkind: Secret\n"), "text")).otherwise(F.regexp_replace("text", "Secret", "secret")))
    _, warnings = FI.guard_inputs(marked)
    return warnings.groupBy("project_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("strip_common_root", f"WITH {PATHS} SELECT doc_id, folder || '/' || name AS path FROM fp")
def strip_common_root(t):
    return FI.strip_common_root(_paths(t).select("doc_id", "project_id", "path"), ["project_id"]).select("doc_id", "path")


@query(
    "follow_references",
    """WITH RECURSIVE r(id, n) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 99 UNION SELECT id // 3, n + 1 FROM r WHERE n < 8) SELECT DISTINCT 'f' || id AS path FROM r WHERE id IN (SELECT p_partkey FROM part)""",
)
def follow_references(t):
    files = t.part.select(s("f", c("p_partkey")).alias("path"), c("p_partkey").alias("id"))
    start = files.filter("id % 100 = 99")
    return FI.follow_references(files, start, lambda loaded: loaded.select(s("f", F.floor(c("id") / 3)).alias("path"))).select("path").distinct()


@query(
    "map_tree",
    """SELECT 'category:' || r_name AS id, NULL AS parent_id, 'category' AS kind FROM region UNION ALL SELECT 'category:' || n_name, 'category:' || r_name, 'category' FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'stack:' || s_name, 'category:' || n_name, 'stack' FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def map_tree(t):
    world = t.region.select(c("r_name").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nations = t.nation.join(t.region, c("r_regionkey") == c("n_regionkey")).select(c("n_name").alias("id"), c("r_name").alias("parent_id"))
    stacks = t.supplier.join(t.nation, c("n_nationkey") == c("s_nationkey")).select(c("s_name").alias("id"), c("n_name").alias("category_id"))
    return DI.map_tree(world.unionByName(nations), stacks)


@query(
    "line_col",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents),
  p AS (SELECT doc_id, line, lines, string_split(row, 'the') AS pieces, unnest(range(1, len(string_split(row, 'the')))) AS k FROM l WHERE contains(row, 'the'))
  SELECT doc_id, line::INT AS line, (length(array_to_string(pieces[:k], 'the')) + 1)::INT AS col, lines FROM p""",
)
def line_col(t):
    """Every place of a word in every document."""
    found = t.documents.select("doc_id", XF.line_count("text").alias("lines"), F.explode(XF.places("text", "the")).alias("p"))
    return found.select("doc_id", "p.line", "p.col", "lines")


@query(
    "evidence_label",
    """WITH x AS (SELECT doc_id, source, text, strpos(text, 'the') - 1 AS p, length(text) - length(regexp_extract(text, '(?s)^.*the')) AS rest FROM documents),
  y AS (SELECT *, length(text[:p]) - length(replace(text[:p], chr(10), '')) + 1 AS a, length(text[:length(text) - rest]) - length(replace(text[:length(text) - rest], chr(10), '')) + 1 AS b FROM x)
  SELECT doc_id, source || CASE WHEN p < 0 THEN '' ELSE ':' || a || CASE WHEN b > a THEN '–' || b ELSE '' END END AS label, CASE WHEN p >= 0 THEN greatest(1, a - 2) END AS context_start FROM y""",
)
def evidence_label(t):
    """The range from the first to the last place of a word in every document; documents without it are named alone."""
    first, last = F.instr("text", "the") - 1, F.length(F.regexp_extract("text", "(?s)^.*the", 0))
    found = t.documents.withColumn("p", F.when(first >= 0, first)).withColumn("e", F.when(first >= 0, XF.evidence_range("text", "p", last)))
    return found.select("doc_id", XF.evidence_label("source", F.array_compact(F.array("e"))).alias("label"), c("e.context_start").alias("context_start"))


_KEYED = r"""(?:["'']?)(?:B2_[A-Z0-9_]+|(?:API|AUTH|ACCESS|SECRET|PRIVATE|PASSWORD|TOKEN|CREDENTIAL)[A-Z0-9_]*)(?:["'']?)\s*[:=]\s*"""
_HELD = r"""(?:"(?:\\.|[^"\\])*(?:"|\\?$)|''(?:\\.|[^''\\])*(?:''|\\?$)|[^,}\r\n]*)"""


@query(
    "mask_secrets",
    rf"""WITH d AS (SELECT doc_id, text || chr(10) || 'API_KEY' || (doc_id % 7) || ' = v' || doc_id || ' , kept' || chr(10) || '''password'': ''a ' || doc_id || chr(10) || 'b'' left' AS t FROM documents WHERE text IS NOT NULL),
  x AS (SELECT doc_id, string_split_regex(t, '(?is){_KEYED}{_HELD}') AS pieces, regexp_extract_all(t, '(?is){_KEYED}{_HELD}') AS found FROM d),
  y AS (SELECT doc_id, pieces, list_transform(found, lambda m: [regexp_extract(m, '(?is)^{_KEYED}'), m[length(regexp_extract(m, '(?is)^{_KEYED}')) + 1:]]) AS found FROM x),
  z AS (SELECT doc_id, pieces, list_transform(found, lambda f: f[1] || CASE WHEN regexp_matches(f[2], '^["'']') THEN regexp_replace(f[2], '[^\r\n]', '•', 'g') ELSE regexp_replace(regexp_replace(f[2], '\s+$', ''), '[^\r\n]', '•', 'g') || regexp_extract(f[2], '\s+$') END) AS shown FROM y)
  SELECT doc_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(shown[i], '')), '') AS masked FROM z""",
)
def mask_secrets(t):
    """Every whole text, with two more assignments behind it."""
    k = c("doc_id").cast("string")
    added = F.concat("text", F.lit("\nAPI_KEY"), (c("doc_id") % 7).cast("string"), F.lit(" = v"), k, F.lit(" , kept\n'password': 'a "), k, F.lit("\nb' left"))
    return t.documents.filter("text is not null").select("doc_id", SF.mask_source(added).alias("masked"))


@query("public_urls", r"SELECT page_id, regexp_replace(regexp_replace(url, '://', '://'), '(token=)[^&#]*', '\1[redacted]') AS url FROM (SELECT page_id, url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&token=abc' ELSE '?token=abc&x=1' END AS url FROM pages)")
def public_urls(t):
    extra = F.when(F.contains("url", F.lit("#")), "").when(F.contains("url", F.lit("?")), "&token=abc").otherwise("?token=abc&x=1")
    with_user = F.regexp_replace(F.concat("url", extra), "://", "://user:pw@")
    return t.pages.select("page_id", SF.public_url(with_user).alias("url"))


@query(
    "mask_urls",
    """WITH x AS (SELECT page_id, regexp_extract(url, '^[^#]*') AS base, regexp_extract(url, '#.*$') AS rest FROM pages WHERE url IS NOT NULL)
  SELECT page_id, 'see ' || replace(base, '://', '://•••••••@') || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'sig=•••&plain=4' || rest || ' end' AS masked FROM x""",
)
def mask_urls(t):
    base, rest = F.regexp_extract("url", "^[^#]*", 0), F.regexp_extract("url", "#.*$", 0)
    secret = F.concat(F.lit("see "), F.replace(base, F.lit("://"), F.lit("://user:pw@")), F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("sig=123&plain=4"), rest, F.lit(" end"))
    return t.pages.filter("url is not null").select("page_id", SF.mask_url_source(secret).alias("masked"))


@query(
    "classify_responsibility",
    r"""WITH f AS (SELECT doc_id, lower(source) || (['/tests/', '/auth/', '/models/', '/api/', '/components/', '/services/', '/infra/', '/misc/', '/db/'])[doc_id % 9 + 1] || doc_id || '.' || (['ts', 'py', 'vue', 'md'])[doc_id % 4 + 1] AS path FROM documents)
  SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Tests' WHEN 1 THEN 'Authentication' WHEN 8 THEN 'Persistence' WHEN 2 THEN 'Data models' WHEN 3 THEN 'API' WHEN 4 THEN 'UI' WHEN 5 THEN CASE WHEN doc_id % 4 = 2 THEN 'UI' ELSE 'Domain services' END
  WHEN 6 THEN CASE WHEN doc_id % 4 = 2 THEN 'UI' ELSE 'Infrastructure' END ELSE CASE WHEN doc_id % 4 = 2 THEN 'UI' ELSE 'Shared logic' END END AS responsibility, (['typescript', 'python', 'vue', NULL])[doc_id % 4 + 1] AS language FROM f""",
)
def classify_responsibility(t):
    folder = _pick(c("doc_id"), *[f"/{name}/" for name in ("tests", "auth", "models", "api", "components", "services", "infra", "misc", "db")])
    path = F.concat(F.lower("source"), folder, c("doc_id").cast("string"), F.lit("."), _pick(c("doc_id"), "ts", "py", "vue", "md"))
    return t.documents.select("doc_id", NF.responsibility(path).alias("responsibility"), NF.language_of(path).alias("language"))


@query(
    "imports_from_source",
    """SELECT kind, specifier, computed, count(*) AS n FROM (SELECT 'import' AS kind, './m' || source AS specifier, FALSE AS computed FROM documents UNION ALL SELECT 'require', 'pkg' || (doc_id % 5), FALSE FROM documents UNION ALL SELECT 're-export', '../x', FALSE FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'dynamic-import', NULL, TRUE FROM documents WHERE doc_id % 2 = 1) GROUP BY ALL""",
)
def imports_from_source(t):
    tail = F.when(c("doc_id") % 2 == 0, 'export { q } from "../x";').otherwise("await import(where);")
    text = F.concat(F.lit("import a, {b} from './m"), "source", F.lit("'; // import no from 'comment'\nconst s = \"require('string')\";\nconst p = require('pkg"), (c("doc_id") % 5).cast("string"), F.lit("');\nobj.require('member');\n"), tail)
    found = t.documents.select(F.explode(IF.module_references(text)).alias("r")).select("r.*")
    return found.groupBy("kind", "specifier", "computed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "command_lines",
    """SELECT fragment, tool, purpose, config, count(*) AS n FROM (SELECT 'npm run build' AS fragment, 'npm' AS tool, 'start' AS purpose, NULL AS config FROM part UNION ALL SELECT 'vite build --config=c' || (p_size % 4) || '.ts', 'vite', 'build', 'c' || (p_size % 4) || '.ts' FROM part
  UNION ALL SELECT 'echo "a && b"', 'echo', 'tool', NULL FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'kubectl apply -f x', 'kubectl', 'deploy', NULL FROM part WHERE p_partkey % 2 = 1) GROUP BY ALL""",
)
def command_lines(t):
    tail = F.when(c("p_partkey") % 2 == 0, '; echo "a && b"').otherwise("|| kubectl apply -f x")
    line = F.concat(F.lit("npm run build && vite build --config=c"), (c("p_size") % 4).cast("string"), F.lit(".ts "), tail)
    pieces = t.part.select(F.explode(CF.command_fragments(line)).alias("fragment")).withColumn("words", CF.argv("fragment"))
    rows = pieces.select("fragment", CF.executable("words").alias("tool"), CF.command_purpose("words").alias("purpose"), CF.option("words", ["--config", "-c"]).alias("config"))
    return rows.groupBy("fragment", "tool", "purpose", "config").agg(F.count(F.lit(1)).alias("n"))


@query(
    "path_functions",
    rf"""WITH {PAGES} SELECT page_id, path AS normalized, regexp_extract(path, '([^/]*)$', 1) AS file, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '(\.[^.]*)$', 1) AS extension,
  split_part(path, '/', 1) || '/x' AS joined, CASE WHEN split_part(path, '/', 2) = 'en' THEN NULL ELSE '.' END AS escaped FROM pg""",
)
def path_functions(t):
    raw = page_paths(t).withColumn("raw", F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("//"))).withColumn("p", PF.normalize_path("raw"))
    # Steps up from the folder of the page to its host, and one more under "en", which leaves the root.  A host alone is its own folder.
    names = F.split("path", "/")
    folder, ups = F.when(F.size(names) == 1, c("p")).otherwise(PF.dir_name("p")), F.greatest(F.size(names) - 2, F.lit(0))
    out = F.concat(F.repeat(F.lit("../"), ups), F.lit(".."), F.when(F.get(names, F.lit(1)) == "en", "/..").otherwise(""))
    return raw.select(
        "page_id", c("p").alias("normalized"), PF.file_name("p").alias("file"), folder.alias("dir"), PF.extension("p").alias("extension"), PF.safe_join(folder, F.concat(F.repeat(F.lit("../"), ups), F.lit("x"))).alias("joined"),
        PF.safe_join(folder, out).alias("escaped"),
    )


@query(
    "name_functions",
    """SELECT p_partkey, '@' || lower(p_type) || '/pkg' AS root, lower(replace(p_name, ' ', '-')) AS pypi, '/u/:id' AS route, 'used-by' AS inverse, CASE WHEN p_size % 2 = 0 THEN 'web' END AS scope FROM part""",
)
def name_functions(t):
    return spread(t.part).select(
        "p_partkey", NF.npm_root(F.concat(F.lit("@"), F.lower("p_type"), F.lit("/pkg/deep"))).alias("root"), NF.normalize_identifier(F.lit("pypi"), F.replace("p_name", F.lit(" "), F.lit("_."))).alias("pypi"),
        NF.file_route(F.concat(F.lit("app/(grp)/u/[id]/route.ts"), F.lit(""))).alias("route"), NF.inverse_relation(F.lit("uses")).alias("inverse"),
        PF.config_scope_boundary(F.when(c("p_size") % 2 == 0, "web/src/**/*.ts").otherwise("tests/**")).alias("scope"),
    )
