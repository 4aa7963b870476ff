"""Package manifests → project, dependency, command, member and workspace-pattern rows.

JSON manifests go through ``from_json``, all others through regular expressions that cut a text into sections, blocks or
lines.  Every file is read once, by the expression of its kind; every result is one row per declaration.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dir_name, file_name

# Package.json dependency sections.
NPM_SECTIONS = {"dependencies": "dependency", "devDependencies": "devDependency", "peerDependencies": "peerDependency", "optionalDependencies": "optionalDependency"}
NPM_SCHEMA = (
    "name string, packageManager string, main string, module string, types string, typings string, exports string, scripts map<string,string>, "
    "workspaces string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
)

# A comment outside strings, or a comma before a closing bracket: what JSON with comments adds to JSON.
_JSONC = r"(\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\")|//[^\n]*|/\*[\s\S]*?\*/"


def plain_json(text: Column | str) -> Column:
    """JSON with comments and trailing commas as plain JSON."""
    bare = F.regexp_replace(text, _JSONC, "$1")
    return F.regexp_replace(bare, r",(\s*[}\]])", "$1")


def package_rows(files: DataFrame) -> dict[str, DataFrame]:
    """Rows of every ``package.json``: ``package``, ``script``, ``dependency``, ``export``, ``workspace`` and ``warning``."""
    keep = [c for c in files.columns if c == "project_id"]
    found = files.filter(F.lower(file_name("path")) == "package.json").select(*keep, "path", plain_json("text").alias("_json"))
    parsed = found.withColumn("p", F.from_json("_json", NPM_SCHEMA)).withColumn("package_path", dir_name("path"))
    good = F.col("_json").rlike(r"^\s*\{") & F.col("p").isNotNull()
    base = parsed.filter(good)
    package = base.select(*keep, "path", "package_path", "p.name", "p.packageManager", F.array_compact(F.array("p.types", "p.typings", "p.module", "p.main")).alias("entries"))
    script = base.select(*keep, "path", "package_path", F.explode("p.scripts").alias("name", "command"))
    sections = None
    for section, kind in NPM_SECTIONS.items():
        part = base.select(*keep, "path", "package_path", F.explode(f"p.{section}").alias("name", "version_range"), F.lit(kind).alias("dependency_type"))
        sections = part if sections is None else sections.unionByName(part)
    exports = base.filter(F.col("p.exports").isNotNull())
    as_map = F.from_json("p.exports", "map<string,string>")
    entry = F.explode(F.when(F.col("p.exports").rlike(r"^\s*\{"), as_map).otherwise(F.create_map(F.lit("."), F.col("p.exports"))))
    export = exports.select(*keep, "path", "package_path", entry.alias("subpath", "_target"))
    # A conditional target is an object; its import/default/require entry names the file.
    picked = F.coalesce(*[F.get_json_object("_target", f"$.{condition}") for condition in ("types", "import", "default", "require")])
    export = export.select(*keep, "path", "package_path", "subpath", F.when(F.col("_target").rlike(r"^\s*\{"), picked).otherwise(F.col("_target")).alias("target"))
    listed = F.coalesce(F.from_json("p.workspaces", "array<string>"), F.from_json(F.get_json_object("p.workspaces", "$.packages"), "array<string>"))
    workspace = base.select(*keep, "path", F.explode(listed).alias("pattern"))
    warning = parsed.filter(~F.coalesce(good, F.lit(False))).select(*keep, "path", F.lit("package-json").alias("detector_id"))
    return {"package": package, "script": script, "dependency": sections, "export": export, "workspace": workspace, "warning": warning}


# File kinds by name, and the ecosystem of each.
KINDS = {
    "package": (r"^package\.json$", "npm"),
    "pyproject": (r"^pyproject\.toml$", "pypi"),
    "requirements": (r"^requirements[^/]*\.txt$", "pypi"),
    "setup": (r"^setup\.cfg$", "pypi"),
    "cargo": (r"^cargo\.toml$", "cargo"),
    "composer": (r"^composer\.json$", "composer"),
    "gomod": (r"^go\.mod$", "go"),
    "gowork": (r"^go\.work$", "go"),
    "pom": (r"^pom\.xml$", "maven"),
    "gradle": (r"^(?:build|settings)\.gradle(?:\.kts)?$", "maven"),
    "sbt": (r"^build\.sbt$", "maven"),
    "catalog": (r"^libs\.versions\.toml$", "maven"),
    "csproj": (r"\.csproj$", "nuget"),
    "solution": (r"\.slnx?$", "nuget"),
    "gem": (r"^gemfile$|\.gemspec$", "gem"),
    "pubspec": (r"^pubspec\.yaml$", "dart"),
    "swift": (r"^package\.swift$", "swift"),
    "deno": (r"^deno\.jsonc?$", "npm"),
}
_JSON = (
    "name string, packageManager string, scripts map<string,string>, tasks map<string,string>, imports map<string,string>, workspace array<string>, workspaces string, lock string, "
    "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>, require map<string,string>, `require-dev` map<string,string>"
)
_FACT = "struct<fact:string,name:string,value:string,kind:string,condition:string>"

# TOML as regular expressions: strings, arrays and inline tables to a depth of four, statements and sections.  Runs are
# possessive: the matcher loops over them instead of recursing, whatever the length of a file.
_STR = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]++|\\.)*+\"|'[^'\n]*+'"
_NOTE = r"#[^\n]*+"
_VALUE = rf"[^\[\]{{}}\"'#]++|{_STR}|{_NOTE}"
_TABLE = _LIST = None
for _ in range(4):
    _inner = _VALUE if _LIST is None else f"{_VALUE}|{_LIST}|{_TABLE}"
    _LIST, _TABLE = rf"\[(?:{_inner})*+\]", rf"\{{(?:{_inner})*+\}}"
_KEY = r"(?:[A-Za-z0-9_-]++|\"[^\"\n]*+\"|'[^'\n]*+')"
_PATH = rf"{_KEY}(?:[ \t]*+\.[ \t]*+{_KEY})*+"
_HEAD = rf"^[ \t]*+\[\[?[ \t]*+{_PATH}[ \t]*+\]\]?"
_SET = rf"^[ \t]*+{_PATH}[ \t]*+=[ \t]*+(?:{_LIST}|{_TABLE}|{_STR}|[^\s#\[\]{{}}\"'][^\n#]*+)"
_SECTION = rf"(?m)(?:{_HEAD})(?:\s++|{_NOTE}|{_SET})*+|(?:{_SET})(?:\s++|{_NOTE}|{_SET})*+"


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n"))


def toml_sections(text: Column) -> Column:
    """Sections of a TOML text in order: ``head`` (key parts) and ``sets`` (``keys``: key parts, ``value``: as written)."""
    parts = lambda path: F.transform(F.regexp_extract_all(path, F.lit(_KEY), F.lit(0)), lambda key: F.regexp_replace(key, r"^[\"']|[\"']$", ""))
    head = lambda section: parts(F.regexp_extract(section, rf"(?m)\A{_HEAD}", 0))
    sets = lambda section: F.transform(
        F.regexp_extract_all(section, F.lit(f"(?m){_SET}"), F.lit(0)),
        lambda line: F.struct(parts(F.regexp_extract(line, rf"^\s*+({_PATH})", 1)).alias("keys"), _strip(F.regexp_replace(line, rf"^\s*+{_PATH}[ \t]*+=[ \t]*+", "")).alias("value")),
    )
    return F.transform(F.regexp_extract_all(text, F.lit(_SECTION), F.lit(0)), lambda section: F.struct(head(section).alias("head"), sets(section).alias("sets")))


def toml_unread(text: Column) -> Column:
    """The first line of a TOML text that is no statement and no comment; null when all can be read."""
    left = F.regexp_replace(text, rf"(?m){_HEAD}|{_SET}|{_NOTE}", "")
    return F.nullif(F.regexp_extract(left, r"(\S[^\n]*)", 1), F.lit(""))


def _string(value: Column) -> Column:
    """A quoted value without its quotes; null for other values."""
    bare = F.regexp_replace(value, r"^(?:\"\"\"|'''|\"|')\n?|(?:\"\"\"|'''|\"|')$", "")
    return F.when(value.rlike(r"^[\"']"), F.when(value.startswith('"'), F.regexp_replace(bare, r"\\([\"\\])", "$1")).otherwise(bare))


def _strings(value: Column) -> Column:
    """Strings of a list, without those inside its tables and comments."""
    flat = F.regexp_replace(value, _TABLE, "")
    listed = F.filter(F.regexp_extract_all(flat, F.lit(f"{_NOTE}|{_STR}"), F.lit(0)), lambda item: ~item.startswith("#"))
    return F.when(value.startswith("["), F.transform(listed, _string)).otherwise(F.array(_string(value)))


def _entry(table: Column, key: str) -> Column:
    """A string of an inline table."""
    return _string(F.nullif(F.regexp_extract(table, rf"[{{,]\s*{key}\s*=\s*({_STR})", 1), F.lit("")))


def _fact(fact: str, name: Column | None = None, value: Column | None = None, kind: Column | None = None, condition: Column | None = None) -> Column:
    text = lambda part: (F.lit(None) if part is None else part).cast("string")
    return F.struct(F.lit(fact).alias("fact"), text(name).alias("name"), text(value).alias("value"), text(kind).alias("kind"), text(condition).alias("condition"))


def _dependency(name: Column, version: Column, kind: Column, condition: Column | None = None) -> Column:
    return _fact("dependency", name, F.when(F.coalesce(version, F.lit("")) == "", "*").otherwise(version), kind, condition)


def _requirement(line: Column, kind: Column) -> Column:
    """``name[extra] version ; condition`` of Python."""
    rest = F.regexp_extract(line, r"^\s*[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?(.*)$", 1)
    version, condition = _strip(F.regexp_replace(rest, ";.*$", "")), F.nullif(_strip(F.regexp_extract(rest, ";(.*)$", 1)), F.lit(""))
    name = F.regexp_extract(line, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when(name != "", _dependency(name, version, kind, condition)).otherwise(_fact("warning", F.lit("requirement"), _strip(line)))


def _facts(items: Column, one) -> Column:
    return F.transform(items, one)


def _none() -> Column:
    return F.array().cast(f"array<{_FACT}>")


def _all(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, _none()) for a in arrays])


def _if(test: Column, *facts: Column) -> Column:
    return F.when(test, F.array(*facts)).otherwise(_none())


def _found(text: Column, rule: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rule), F.lit(group))


def _first(text: Column, rule: str, group: int = 1) -> Column:
    return F.nullif(_strip(F.regexp_extract(text, rule, group)), F.lit(""))


def _toml_dependencies(section: Column, kind: Column, condition: Column | None = None) -> Column:
    """Rows of a section of dependencies: ``name = "1"``, ``name = { version = "1" }`` and ``name.version = "1"``."""

    def one(item: Column) -> Column:
        value, name = item["value"], F.element_at(item["keys"], 1)
        table = value.startswith("{")
        version = F.when(table, F.coalesce(_entry(value, "version"), _entry(value, "git"), _entry(value, "path"))).otherwise(_string(value))
        return _dependency(F.coalesce(F.when(table, _entry(value, "package")), name), version, kind, condition)

    listed = F.filter(section["sets"], lambda item: (F.size(item["keys"]) == 1) | (F.element_at(item["keys"], -1) == "version"))
    return F.concat(_facts(listed, one), _references(section))


def _references(section: Column) -> Column:
    paths = F.filter(F.transform(section["sets"], lambda item: _entry(item["value"], "path")), lambda path: path.isNotNull())
    return _facts(paths, lambda path: _fact("reference", value=path))


def _set(section: Column, key: str) -> Column:
    """The first value of a key of a section."""
    return F.get(F.transform(F.filter(section["sets"], lambda item: F.array_join(item["keys"], ".") == key), lambda item: item["value"]), F.lit(0))


def _toml_dependency(section: Column, kind: Column, condition: Column | None = None) -> Column:
    """The row of a section that is one dependency: ``[dependencies.name]``."""
    field = lambda key: _string(_set(section, key))
    row = _dependency(F.coalesce(field("package"), F.element_at(section["head"], -1)), F.coalesce(field("version"), field("git"), field("path")), kind, condition)
    return F.concat(F.array(row), _if(field("path").isNotNull(), _fact("reference", value=field("path"))))


def _cargo(section: Column) -> Column:
    head, size = section["head"], F.size(section["head"])
    at = lambda i: F.get(head, F.lit(i))
    kinds = {"dependencies": (F.lit("dependency"), None), "dev-dependencies": (F.lit("devDependency"), None), "build-dependencies": (F.lit("devDependency"), F.lit("build"))}
    rows = F.when(F.lit(False), _none())
    for table, (kind, condition) in kinds.items():
        rows = rows.when((at(0) == table) & (size == 1), _toml_dependencies(section, kind, condition)).when((at(0) == table) & (size == 2), _toml_dependency(section, kind, condition))
    target = (at(0) == "target") & (at(2) == "dependencies")
    rows = rows.when(target & (size == 3), _toml_dependencies(section, F.lit("dependency"), at(1))).when(target & (size == 4), _toml_dependency(section, F.lit("dependency"), at(1)))
    rows = rows.when((at(0) == "package") & (size == 1), _if(_set(section, "name").isNotNull(), _fact("project", _string(_set(section, "name")))))
    members = _facts(F.coalesce(_strings(_set(section, "members")), F.array().cast("array<string>")), lambda member: _fact("member", value=member))
    return rows.when((at(0) == "workspace") & (size == 1), F.concat(F.array(_fact("attribute", F.lit("workspaceRoot"), F.lit("true"))), members)).otherwise(_none())


def _pyproject(section: Column) -> Column:
    head = F.array_join(section["head"], ".")
    empty = F.array().cast("array<string>")
    listed = lambda key: F.coalesce(_strings(_set(section, key)), empty)
    group = lambda item: F.element_at(item["keys"], 1)
    optional = lambda item: F.when(group(item).rlike("test|dev"), "devDependency").otherwise("optionalDependency")
    each = lambda kind: F.flatten(F.transform(section["sets"], lambda item: _facts(_strings(item["value"]), lambda line: _requirement(line, kind(item)))))
    project = F.concat(
        _if(_set(section, "name").isNotNull(), _fact("project", _string(_set(section, "name")))),
        _facts(listed("dependencies"), lambda line: _requirement(line, F.lit("dependency"))),
    )
    poetry = F.filter(_toml_dependencies(section, F.lit("dependency")), lambda row: F.coalesce(row["name"], F.lit("")) != "python")
    scripts = _facts(section["sets"], lambda item: _fact("command", group(item), _string(item["value"]), F.lit("entry-point")))
    pytest = F.concat(F.array(_fact("tool", value=F.lit("pytest"))), _facts(listed("testpaths"), lambda path: _fact("attribute", F.lit("pytestTestpaths"), path)))
    uv = _facts(listed("members"), lambda member: _fact("member", value=member))
    return (
        F.when(head == "project", project)
        .when(head == "project.optional-dependencies", each(optional))
        .when(head == "dependency-groups", each(lambda item: F.lit("devDependency")))
        .when(head == "tool.poetry.dependencies", poetry)
        .when(head.rlike(r"^tool\.poetry\.dependencies\."), _toml_dependency(section, F.lit("dependency")))
        .when(head == "project.scripts", scripts)
        .when(head == "tool.pytest.ini_options", pytest)
        .when(head == "tool.uv", F.array(_fact("tool", value=F.lit("uv"))))
        .when(head == "tool.uv.workspace", F.concat(F.array(_fact("tool", value=F.lit("uv"))), uv))
        .otherwise(_none())
    )


def _catalog(section: Column) -> Column:
    """Aliases of a version catalog: name of the alias, coordinate, and version or a reference to one."""
    head = F.array_join(section["head"], ".")
    alias = lambda item: F.regexp_replace(F.element_at(item["keys"], 1), "[-_]", ".")

    def library(item: Column) -> Column:
        value = item["value"]
        both = F.concat_ws(":", _entry(value, "group"), _entry(value, "name"))
        text = F.split(_string(value), ":")
        coordinate = F.coalesce(_entry(value, "module"), F.nullif(both, F.lit("")), F.concat_ws(":", F.get(text, F.lit(0)), F.get(text, F.lit(1))))
        # version.ref names an entry of [versions]; it is looked up when all aliases of the catalog are known.
        named = F.coalesce(_string(_first(value, rf"[{{,]\s*version\.ref\s*=\s*({_STR})")), _string(_first(value, rf"\bref\s*=\s*({_STR})")))
        return _fact("library", alias(item), coordinate, F.coalesce(_entry(value, "version"), F.get(text, F.lit(2))), named)

    return F.when(head == "versions", _facts(section["sets"], lambda item: _fact("version", F.element_at(item["keys"], 1), _string(item["value"])))).when(head == "libraries", _facts(section["sets"], library)).otherwise(_none())


def _requirements(lines: Column) -> Column:
    wanted = F.filter(F.transform(lines, lambda line: _strip(F.regexp_replace(line, r"(^|\s)#.*$", ""))), lambda line: line != "")
    return _facts(wanted, lambda line: F.when(line.startswith("-"), _fact("warning", F.lit("requirements-option"), line)).otherwise(_requirement(line, F.lit("dependency"))))


def _setup(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?:^|\n)install_requires\s*=([^\n]*+(?:\n(?:[ \t][^\n]*+)?+)*+)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), _strip), lambda line: (line != "") & ~line.startswith("#"))
    name = _first(text, r"(?:^|\n)name\s*=\s*([^\n]+)")
    return F.concat(_if(name.isNotNull(), _fact("project", name)), _facts(lines, lambda line: _requirement(line, F.lit("dependency"))))


def _gomod(text: Column) -> Column:
    plain = F.regexp_replace(text, r"(?s)\b(?:replace|exclude|retract)\s*\([^)]*\)|(?m)^(?:replace|exclude|retract)\s+[^\n(]+$", "")
    lines = F.filter(F.split(plain, "\n"), lambda line: ~line.rlike(r"//\s*indirect\b") & line.rlike(r"^\s*(?:require\s+)?[^\s(]+\s+v\S"))
    rule = r"^\s*(?:require\s+)?([^\s(]+)\s+(v\S+)"
    name = _first(text, r"(?m)^module\s+(\S+)")
    return F.concat(
        _if(name.isNotNull(), _fact("project", name), _fact("attribute", F.lit("modulePath"), name)),
        _facts(lines, lambda line: _dependency(F.regexp_extract(line, rule, 1), F.regexp_extract(line, rule, 2), F.lit("dependency"))),
        _facts(_found(text, r"(?m)=>\s+(\.\.?/[^\s]+)"), lambda path: _fact("reference", value=path)),
    )


def _gowork(text: Column) -> Column:
    block = F.flatten(F.transform(_found(text, r"(?s)\buse\s*\(([^)]*)\)"), lambda inside: F.split(inside, "\n")))
    lines = F.transform(F.concat(block, _found(text, r"(?m)^use\s+([^\n(]+)")), lambda line: F.regexp_replace(_strip(F.regexp_replace(line, r"//.*$", "")), r"^\"|\"$", ""))
    return _facts(F.filter(lines, lambda line: line != ""), lambda member: _fact("member", value=member))


def _pom(text: Column) -> Column:
    dev, plain = F.lit("devDependency"), F.lit("dependency")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    managed = F.regexp_extract(text, r"(?s)<dependencyManagement>(.*?)</dependencyManagement>", 1)
    properties = F.regexp_extract(text, r"(?s)<properties>(.*?)</properties>", 1)
    own = F.regexp_replace(text, r"(?s)<dependencyManagement>.*?</dependencyManagement>", "")
    tag = lambda inside, name: _strip(F.regexp_extract(inside, rf"(?s)<{name}>(.*?)</{name}>", 1))
    coordinate = lambda inside: F.concat_ws(":", tag(inside, "groupId"), tag(inside, "artifactId"))
    listed = lambda inside: _found(inside, r"(?s)<dependency>(.*?)</dependency>")
    # A version that is not written is that of the managed dependency; a property stands for its text.
    fallback = lambda d: F.get(F.transform(F.filter(listed(managed), lambda m: coordinate(m) == coordinate(d)), lambda m: tag(m, "version")), F.lit(0))
    value = lambda key: F.call_function("regexp_extract", properties, F.concat(F.lit(r"(?s)<(\Q"), key, F.lit(r"\E)>\s*([^<]*?)\s*</")), F.lit(2))
    resolve = lambda v: F.aggregate(_found(v, r"\$\{([^}]+)\}"), v, lambda acc, key: F.when(value(key) != "", F.replace(acc, F.concat(F.lit("${"), key, F.lit("}")), value(key))).otherwise(acc))
    version = lambda d: F.when(tag(d, "version") != "", tag(d, "version")).otherwise(F.coalesce(fallback(d), F.lit("")))
    rows = _facts(listed(own), lambda d: _dependency(coordinate(d), resolve(version(d)), F.when(tag(d, "scope") == "test", dev).otherwise(plain), F.nullif(tag(d, "scope"), F.lit(""))))
    name = _first(F.regexp_replace(own, r"(?s)<(parent|dependencies|build|profiles|modules|properties|reporting)>.*?</\1>", ""), r"(?s)<artifactId>(.*?)</artifactId>")
    return F.concat(
        _if(name.isNotNull(), _fact("project", name)),
        rows,
        _facts(_found(own, r"<module>\s*([^<]+?)\s*</module>"), lambda member: _fact("member", value=member)),
        F.array(_fact("tool", value=F.lit("maven"))),
        _if(own.rlike(r"<groupId>\s*org\.springframework\.boot\s*</groupId>"), _fact("tool", value=F.lit("spring-boot"))),
    )


def _gradle(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)(?<![:\"'])//[^\n]*$", "")
    dev = lambda call: F.when(call.rlike(r"^(?:test|annotation)"), "devDependency").otherwise("dependency")
    call = r"\b((?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor)\s*\(?\s*[\"'][^\"':]+:[^\"']+)[\"']"
    pieces = lambda d: F.split(F.regexp_replace(d, r"^\w+\s*\(?\s*[\"']", ""), ":")
    written = _facts(_found(text, call), lambda d: _dependency(F.concat_ws(":", F.get(pieces(d), F.lit(0)), F.get(pieces(d), F.lit(1))), F.get(pieces(d), F.lit(2)), dev(d)))
    aliases = _facts(_found(text, r"\b((?:implementation|api|testImplementation)\s*\(\s*libs\.[\w.]+)\s*\)"), lambda d: _fact("alias", F.regexp_extract(d, r"libs\.(.*)$", 1), kind=dev(d)))
    label = lambda name: F.replace(F.regexp_replace(name, "^:", ""), F.lit(":"), F.lit("/"))
    included = F.flatten(F.transform(_found(text, r"\binclude\s*\(?\s*([^\n)]+)"), lambda line: _found(line, r"[\"']([^\"']+)[\"']")))
    tasks = _found(text, r"\btasks\.(?:register|create)(?:<[^>]+>)?\(\s*[\"']([^\"']+)[\"']")
    return F.concat(
        written,
        aliases,
        _facts(included, lambda name: _fact("member", value=label(name))),
        _facts(_found(text, r"\bproject\s*\(\s*[\"']([^\"']+)[\"']"), lambda name: _fact("reference", value=label(name))),
        _facts(tasks, lambda name: _fact("command", name, F.concat(F.lit("gradle "), name), F.lit("build-task"))),
        F.array(_fact("tool", value=F.lit("gradle"))),
        _if(text.rlike(r"\b(?:java|jvmToolchain|jvmTarget|kotlin\s*\(\s*[\"']jvm)\b"), _fact("attribute", F.lit("jvmTarget"), F.lit("true"))),
        _if(text.rlike(r"[\"']org\.springframework\.boot[\"']"), _fact("tool", value=F.lit("spring-boot"))),
    )


def _sbt(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)(?<![:\"])//[^\n]*$", "")
    rule = r"\"([^\"]+)\"\s*%%?%?\s*\"([^\"]+)\"\s*%\s*\"([^\"]+)\""
    part = lambda d, i: F.regexp_extract(d, rule, i)
    name = _first(text, r"(?m)^\s*name\s*:=\s*\"([^\"]+)\"")
    return F.concat(
        _if(name.isNotNull(), _fact("project", name)),
        _facts(_found(text, rule + r"(?:\s*%\s*(?:Test|\"test\"))?", 0), lambda d: _dependency(F.concat_ws(":", part(d, 1), part(d, 2)), part(d, 3), F.when(d.rlike(r"%\s*(?:Test|\"test\")$"), "devDependency").otherwise("dependency"))),
        F.array(_fact("attribute", F.lit("jvmTarget"), F.lit("true"))),
    )


def _csproj(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    field = lambda d, name: F.regexp_extract(d, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)
    version = lambda d: F.when(field(d, "Version") != "", field(d, "Version")).otherwise(_strip(F.regexp_extract(d, r"(?is)<Version>(.*?)</Version>", 1)))
    kind = lambda d: F.when(field(d, "Include").rlike(r"(?i)test|xunit|nunit"), "devDependency").otherwise("dependency")
    packages = _found(text, r"(?is)(<PackageReference\b[^>]*/>|<PackageReference\b[^>]*>(?:(?!</PackageReference>)[\s\S])*+</PackageReference>)")
    setting = lambda name: _first(text, rf"(?is)<{name}>(.*?)</{name}>")
    frameworks = F.coalesce(setting("TargetFramework"), setting("TargetFrameworks"))
    return F.concat(
        _facts(packages, lambda d: _dependency(field(d, "Include"), version(d), kind(d), F.nullif(field(d, "Condition"), F.lit("")))),
        _facts(_found(text, r"(?is)(<ProjectReference\b[^>]*>)"), lambda d: _fact("reference", value=F.translate(field(d, "Include"), "\\", "/"))),
        F.array(_fact("tool", value=F.lit("dotnet"))),
        _if(F.size(packages) > 0, _fact("tool", value=F.lit("nuget"))),
        _if(frameworks.isNotNull(), _fact("attribute", F.lit("targetFramework"), frameworks)),
        _if(setting("OutputType").isNotNull(), _fact("attribute", F.lit("outputType"), setting("OutputType"))),
        _if(setting("NuGetLockFilePath").isNotNull(), _fact("attribute", F.lit("lockPath"), setting("NuGetLockFilePath"))),
        _if(text.rlike(r"<Project\b[^>]*Sdk\s*=\s*[\"']Microsoft\.NET\.Sdk\.Web[\"']"), _fact("tool", value=F.lit("aspnet-core"))),
    )


def _solution(text: Column) -> Column:
    members = F.concat(_found(text, r"Project\([^\n]*?=\s*\"[^\"]*\",\s*\"([^\"\n]+\.csproj)\""), _found(text, r"(?is)<Project\b[^>]*\bPath\s*=\s*\"([^\"]+)\""))
    return F.concat(F.array(_fact("tool", value=F.lit("dotnet")), _fact("attribute", F.lit("solution"), F.lit("true"))), _facts(members, lambda m: _fact("member", value=F.translate(m, "\\", "/"))))


def _gem(text: Column) -> Column:
    """Lines outside groups, and groups as a whole: what is in a development or test group is a development dependency."""
    pieces = _found(text, r"(?m)^[ \t]*+group\s[^\n]*?\sdo\b[^\n]*+\n(?:(?![ \t]*+end\b)[^\n]*+\n)*+[ \t]*+end\b|^[^\n]++", 0)
    rule = r"(?m)^[ \t]*(?:gem|\w+\.add_(?:development_|runtime_)?dependency)[ \t(]+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?"
    group = lambda piece: _strip(F.regexp_extract(piece, r"^[ \t]*group\s+([^\n]*?)\s+do\b", 1))

    def lines(piece: Column) -> Column:
        dev = lambda d: F.when(d.contains("add_development_dependency") | group(piece).rlike(r"\b(?:development|test)\b"), "devDependency").otherwise("dependency")
        return _facts(_found(piece, rule, 0), lambda d: _dependency(F.regexp_extract(d, rule, 1), F.regexp_extract(d, rule, 2), dev(d), F.nullif(group(piece), F.lit(""))))

    name = _first(text, r"\.name\s*=\s*[\"']([^\"']+)[\"']")
    return F.concat(_if(name.isNotNull(), _fact("project", name)), F.flatten(F.transform(pieces, lines)))


def _pubspec(text: Column) -> Column:
    arrays = [_if(_first(text, r"(?m)^name:\s*(\S+)").isNotNull(), _fact("project", _first(text, r"(?m)^name:\s*(\S+)")))]
    for section, kind in (("dependencies", "dependency"), ("dev_dependencies", "devDependency")):
        block = F.regexp_extract(text, rf"(?m)^{section}:[^\n]*\n((?:[ \t#][^\n]*+(?:\n|$)|\n)*+)", 1)
        entries = _found(block, r"(?m)(^  [A-Za-z_]\w*:[^\n]*+(?:\n    [^\n]*+)*+)")
        field = lambda e, key: _first(e, rf"\n\s+{key}:\s*[\"']?([^\s\"'#]+)")
        version = lambda e: F.coalesce(_first(e, r"^  \w+:[ \t]*[\"']?([^\s\"'#]+)"), field(e, "version"), F.when(field(e, "git").isNotNull(), field(e, "git")), field(e, "path"))
        of_kind = partial(lambda type_, e: _dependency(F.regexp_extract(e, r"^  (\w+):", 1), version(e), F.lit(type_)), kind)
        arrays.append(_facts(entries, lambda e: of_kind(e)))
        arrays.append(_facts(F.filter(F.transform(entries, lambda e: field(e, "path")), lambda path: path.isNotNull()), lambda path: _fact("reference", value=path)))
    return F.concat(*arrays)


def _swift(text: Column) -> Column:
    packages = _found(F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)(?<![:\"])//[^\n]*$", ""), r"(?s)\.package\s*\(((?:[^()]++|\([^()]*+\))*+)\)")
    address = lambda d: F.regexp_extract(d, r"url:\s*\"([^\"]+)\"", 1)
    name = _first(text, r"\bname:\s*\"([^\"]+)\"")
    return F.concat(
        _if(name.isNotNull(), _fact("project", name)),
        _facts(F.filter(packages, lambda d: address(d) != ""), lambda d: _dependency(F.regexp_replace(F.element_at(F.split(address(d), "/"), -1), r"\.git$", ""), F.regexp_extract(d, r"(?:from:|exact:)\s*\"([^\"]+)\"", 1), F.lit("dependency"))),
        _facts(_found(text, r"\.package\s*\(\s*(?:name:\s*\"[^\"]*\"\s*,\s*)?path:\s*\"([^\"]+)\""), lambda path: _fact("reference", value=path)),
        _facts(_found(text, r"\.(?:target|executableTarget|testTarget)\s*\(\s*name\s*:\s*\"([^\"]+)\""), lambda target: _fact("attribute", F.lit("swiftTarget"), target)),
    )


def _entries(column: Column) -> Column:
    return F.coalesce(F.map_entries(column), F.array().cast("array<struct<key:string,value:string>>"))


def _json_facts(kind: str) -> Column:
    j = F.col("_json")
    name = _if(F.coalesce(j["name"], F.lit("")) != "", _fact("project", j["name"]))
    commands = lambda column: _facts(F.filter(_entries(column), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: _fact("command", e["key"], e["value"]))
    dependencies = lambda column, kind: _facts(_entries(column), lambda e: _dependency(e["key"], e["value"], F.lit(kind)))
    members = lambda column: _facts(F.coalesce(column, F.array().cast("array<string>")), lambda m: _fact("member", value=m))
    if kind == "package":
        listed = F.coalesce(F.from_json(j["workspaces"], "array<string>"), F.from_json(F.get_json_object(j["workspaces"], "$.packages"), "array<string>"))
        manager = F.substring_index(j["packageManager"], "@", 1)
        return F.concat(name, *[dependencies(j[section], type_) for section, type_ in NPM_SECTIONS.items()], commands(j["scripts"]), members(listed), _if(F.coalesce(manager, F.lit("")) != "", _fact("tool", value=manager)))
    if kind == "composer":
        wanted = lambda column, type_: F.filter(dependencies(column, type_), lambda row: row["name"].contains("/"))
        listed = lambda e: F.when(e["value"].rlike(r"^\s*\["), F.from_json(e["value"], "array<string>")).otherwise(F.array(e["value"]))
        numbered = lambda e: F.transform(listed(e), lambda command, i: _fact("command", F.when(i > 0, F.concat(e["key"], F.lit(":"), i.cast("string"))).otherwise(e["key"]), command))
        return F.concat(name, wanted(j["require"], "dependency"), wanted(j["require-dev"], "devDependency"), F.flatten(F.transform(_entries(j["scripts"]), numbered)), F.array(_fact("tool", value=F.lit("composer"))))
    spec = lambda e: F.regexp_replace(e["value"], "^(?:npm|jsr):/?", "")
    imports = lambda e: (
        F.when(e["value"].rlike("^(?:npm|jsr):"), _dependency(F.regexp_extract(spec(e), r"^(@?[^@]+)", 1), F.regexp_extract(spec(e), r"^@?[^@]+@(.+)$", 1), F.lit("dependency")))
        .when(e["value"].rlike(r"^\.\.?/"), _fact("reference", value=e["value"])).otherwise(_fact("warning", F.lit("remote-import"), e["key"]))
    )
    lock = F.when(j["lock"].rlike(r"^\s*\{"), F.get_json_object(j["lock"], "$.path")).when(~j["lock"].isin("true", "false"), j["lock"])
    return F.concat(
        name, _facts(_entries(j["imports"]), imports), commands(j["tasks"]), members(j["workspace"]), F.array(_fact("tool", value=F.lit("deno"))),
        _if(lock.isNotNull(), _fact("attribute", F.lit("lockPath"), lock)), _if(j["lock"] == "false", _fact("attribute", F.lit("lockDisabled"), F.lit("true"))),
    )


def manifest_facts(files: DataFrame) -> DataFrame:
    """Everything the manifests of ``files`` (``path``, ``text``) declare, in one pass over their texts.

    ``project_id``, ``path``, ``directory``, ``form``, ``ecosystem``, ``fact``, ``name``, ``value``, ``kind``, ``condition``; ``fact`` is
    ``project`` (name), ``dependency`` (name, version range, type, condition), ``command`` (name, command, purpose), ``member`` (pattern),
    ``reference`` (path), ``tool``, ``attribute`` (name, value), ``alias`` (of a version catalog, dependency type), ``library`` (alias,
    coordinate, version, named version) and ``version`` of a catalog, and ``warning`` (detector, message).
    Each file is read by the expression of its kind alone; its rows are one array, exploded once.
    """
    if "project_id" not in files.columns:
        files = files.withColumn("project_id", F.lit(""))
    name = F.lower(file_name("path"))
    form = F.when(F.lit(False), F.lit(""))
    for kind, (rule, _) in KINDS.items():
        form = form.when(name.rlike(rule), kind)
    found = files.filter(name.rlike("|".join(rule for rule, _ in KINDS.values()))).select("project_id", "path", form.alias("form"), F.coalesce("text", F.lit("")).alias("text"))
    is_ = lambda *kinds: F.col("form").isin(*kinds)
    toml, json = is_("cargo", "pyproject", "catalog"), is_("package", "composer", "deno")
    found = found.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))
    found = found.withColumn("_unread", F.when(toml, toml_unread(F.col("text"))).when(json, F.when(~F.col("text").rlike(r"^\s*(?:/[/*][\s\S]*)?\{"), F.lit("not an object"))))
    found = found.withColumn("_sections", F.when(toml & F.col("_unread").isNull(), toml_sections(F.col("text"))))
    found = found.withColumn("_json", F.when(json & F.col("_unread").isNull(), F.from_json(plain_json("text"), _JSON)))
    per_section = lambda reader: F.flatten(F.transform("_sections", reader))
    text = F.col("text")
    readers = {
        "pyproject": per_section(_pyproject), "cargo": F.concat(F.array(_fact("tool", value=F.lit("cargo"))), per_section(_cargo)), "catalog": per_section(_catalog),
        "requirements": _requirements(F.split(text, "\n")), "setup": _setup(text), "gomod": _gomod(text), "gowork": _gowork(text), "pom": _pom(text), "gradle": _gradle(text),
        "sbt": _sbt(text), "csproj": _csproj(text), "solution": _solution(text), "gem": _gem(text), "pubspec": _pubspec(text), "swift": _swift(text),
        "package": _json_facts("package"), "composer": _json_facts("composer"), "deno": _json_facts("deno"),
    }
    rows = F.when(F.col("_unread").isNotNull(), F.array(_fact("warning", F.when(toml, "toml").otherwise("json"), F.col("_unread"))))
    for kind, reader in readers.items():
        rows = rows.when(is_(kind), reader)
    # A catalog belongs to the folder above its own; a project without a name has that of its folder.
    directory = F.when(is_("catalog"), dir_name(dir_name("path"))).otherwise(dir_name("path"))
    listed = found.select("project_id", "path", directory.alias("directory"), "form", _all(rows).alias("_rows"))
    named = F.exists("_rows", lambda row: row["fact"] == "project")
    fallback = F.when(is_("csproj", "solution"), F.regexp_replace(file_name("path"), r"(?i)\.(?:csproj|slnx?)$", "")).otherwise(F.when(F.col("directory").isin("", "."), F.lit(None).cast("string")).otherwise(file_name("directory")))
    ecosystem = F.when(F.lit(False), F.lit(""))
    for kind, (_, owner) in KINDS.items():
        ecosystem = ecosystem.when(is_(kind), owner)
    project = _fact("project", F.coalesce(fallback, ecosystem))
    unread = F.exists("_rows", lambda row: (row["fact"] == "warning") & row["name"].isin("toml", "json"))
    whole = F.when(named | unread | is_("catalog"), F.col("_rows")).otherwise(F.concat(F.array(project), F.col("_rows")))
    exploded = listed.select("project_id", "path", "directory", "form", ecosystem.alias("ecosystem"), F.explode(whole).alias("r"))
    return exploded.select("project_id", "path", "directory", "form", "ecosystem", "r.*").filter((F.col("fact") != "dependency") | (F.coalesce("name", F.lit("")) != ""))


def catalog_dependencies(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies named by an alias of the version catalog of their folder, and the aliases that no catalog has (warnings)."""
    key = ["project_id", "directory"]
    library = facts.filter("fact = 'library'").select(*key, F.col("name").alias("alias"), F.col("value").alias("coordinate"), F.col("kind").alias("version"), F.col("condition").alias("named"))
    version = facts.filter("fact = 'version'").groupBy(*key, F.col("name").alias("named")).agg(F.min("value").alias("_value"))
    known = library.join(version, [*key, "named"], "left").groupBy(*key, "alias").agg(F.min(F.struct("coordinate", F.coalesce("version", "_value", F.lit("*")).alias("version"))).alias("l"))
    used = facts.filter("fact = 'alias'").select(*key, "path", "ecosystem", F.col("name").alias("alias"), F.col("kind").alias("dependency_type"))
    joined = used.join(known, [*key, "alias"], "left")
    rows = joined.filter("l.coordinate is not null").select("project_id", "path", "ecosystem", F.col("l.coordinate").alias("name"), F.col("l.version").alias("version_range"), "dependency_type")
    return rows, joined.filter("l.coordinate is null").select("project_id", "path", F.lit("catalog-alias").alias("detector_id"), F.concat(F.lit("libs."), F.col("alias")).alias("message"))


def manifest_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies of the other ecosystems (one schema for all), and warnings for what cannot be read.

    Columns: ``path``, ``ecosystem``, ``name``, ``version_range``, ``dependency_type`` (plus ``project_id``).
    """
    facts = manifest_facts(files).filter("form <> 'package'")
    rows = facts.filter("fact = 'dependency'").select("project_id", "path", "ecosystem", "name", F.col("value").alias("version_range"), F.col("kind").alias("dependency_type"))
    return rows, facts.filter("fact = 'warning'").select("project_id", "path", F.col("name").alias("detector_id"), F.col("value").alias("message"))


def workspace_patterns(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns of the workspace config with the shortest path per project, in order; the other configs (warnings)."""
    if "project_id" not in files.columns:
        files = files.withColumn("project_id", F.lit(""))
    configs = files.filter(F.lower(file_name("path")).rlike(r"^pnpm-workspace\.ya?ml$")).select("project_id", "path", "text")
    best = configs.groupBy("project_id").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("_best"))
    chosen = configs.join(best, "project_id")
    ignored = chosen.filter("path <> _best").select("project_id", "path", F.lit("workspace-config").alias("detector_id"))
    clean = F.regexp_replace("text", r"(?m)(^|\s)#[^\n]*$", "$1")
    inline = F.split(F.regexp_extract(clean, r"(?m)^\s*packages\s*:\s*\[([^\]]*)\]", 1), ",")
    block = F.regexp_extract(clean, r"(?m)^\s*packages\s*:[ \t]*\r?\n((?:\s*+-[^\n]*+(?:\n|$)|[ \t]*+\r?\n)*+)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s*-\s*(.+?)\s*$"), F.lit(1)), lambda item: item)
    listed = F.when(F.size(items) > 0, items).otherwise(inline)
    unquoted = F.filter(F.transform(listed, lambda item: F.regexp_replace(F.trim(item), r"^([\"'])(.*)\1$", "$2")), lambda item: item != "")
    return chosen.filter("path = _best").select("project_id", "path", F.posexplode(unquoted).alias("seq", "pattern")), ignored
