"""Manifest forms, in one pass: projects, dependencies, commands, members and references."""

import tomllib

import pytest
from pyspark.sql import functions as F

from conftest import values
from corpusloom.sources import manifests as MA

PYPROJECT = """
# head
[project]
name = "tool # not a comment"
dependencies = [
  "httpx[http2]>=1 ; python_version>'3'",  # why ["x"]
  'rich',
]
[project.optional-dependencies]
test = ["pytest"]
docs = ["sphinx~=7"]
[project.scripts]
run = "pkg.cli:main"
[dependency-groups]
lint = ["ruff", {include-group = "test"}]
[tool.poetry.dependencies]
python = "^3.12"
attrs = { version = "^23", extras = ["a", "b"] }
own = {path = "../own"}
[tool.poetry.dependencies.deep]
version = "2"
[tool.uv.workspace]
members = ["packages/*"]
[tool.pytest.ini_options]
testpaths = ["tests"]
"""
CARGO = """
[package]
name = 'crate'
[workspace]
members = ["a", "b/*"]
[dependencies]
serde = { version = "1.0", features = ["derive"] }
json = { package = "serde_json", version = "2" }
near = { path = "../near" }
rand.version = "0.8"
text = '''lit'''
[dependencies.tokio]
version = "1.3"
features = ["full"]
[dev-dependencies]
quick = "1"
[build-dependencies]
cc = "1.1"
[target.'cfg(unix)'.dependencies]
nix = "0.29"
"""
FILES = {
    "py/pyproject.toml": PYPROJECT,
    "rs/Cargo.toml": CARGO,
    "old/setup.cfg": "[metadata]\nname = olden\n[options]\ninstall_requires =\n    requests>=2 ; python_version<'3'\n    # note\n    six\nzip_safe = no\n",
    "go/go.mod": "module example.org/m\n\nrequire github.com/a/b v1.2.0\nreplace github.com/a/b => ../b\n",
    "go/go.work": 'go 1.22\nuse (\n\t./api // first\n\t"./web"\n)\nuse ./tool\n',
    "jvm/pom.xml": "<project><parent><artifactId>up</artifactId></parent><artifactId>shop</artifactId><properties><v.x>7.1</v.x></properties><modules><module>core</module></modules>"
    "<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>3</version></dependency></dependencies></dependencyManagement>"
    "<dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency><dependency><groupId>h</groupId><artifactId>n</artifactId><version>${v.x}</version><scope>test</scope></dependency></dependencies></project>",
    "g/build.gradle.kts": 'plugins { kotlin("jvm") }\ndependencies {\n  implementation("a:b:1")\n  implementation(libs.json.core)\n  testImplementation(libs.absent)\n  implementation(project(":core:api"))\n  // api("no:no:1")\n}\ntasks.register("seed") {}\n',
    "g/settings.gradle.kts": 'include(":core:api", ":web")\n',
    "g/gradle/libs.versions.toml": '[versions]\njson = "2.9"\n[libraries]\njson-core = { module = "org.j:core", version.ref = "json" }\nplain = "x:y:1"\n',
    "s/build.sbt": 'name := "scala-app"\nlibraryDependencies += "org.a" %% "b" % "1.0"\nlibraryDependencies += "org.t" % "c" % "2.0" % Test\n',
    "n/App.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFramework>net9.0</TargetFramework></PropertyGroup><ItemGroup><PackageReference Include="Newton" Version="13" /><PackageReference Include="xunit"><Version>2</Version></PackageReference><ProjectReference Include="..\\Lib\\Lib.csproj" /></ItemGroup></Project>',
    "n/All.sln": 'Project("{FAE}") = "App", "App\\App.csproj", "{1}"\nEndProject\n',
    "n/New.slnx": '<Solution><Project Path="App/App.csproj" /></Solution>',
    "r/Gemfile": "source 'x'\ngem 'rails', '~> 7'\ngroup :development, :test do\n  gem \"rspec\"\nend\ngem 'puma'\n",
    "r/kit.gemspec": "Gem::Specification.new do |s|\n  s.name = 'kit'\n  s.add_dependency 'rack', '>= 2'\n  s.add_development_dependency 'rake'\nend\n",
    "d/pubspec.yaml": "name: app\ndependencies:\n  http: ^1\n  flutter:\n    sdk: flutter\n  own:\n    path: ../own\ndev_dependencies:\n  test: any\n",
    "w/Package.swift": 'let package = Package(name: "Kit", dependencies: [.package(url: "https://h/o/Zip.git", from: "2.1"), .package(path: "../Near")], targets: [.target(name: "Kit")])',
    "e/deno.json": '{"imports": {"z": "npm:zod@3", "l": "./l.ts", "r": "https://x/y"}, "tasks": {"dev": "deno run"}, "workspace": ["a"], "lock": {"path": "d.lock"}}',
    "p/composer.json": '{"name": "v/app", "require": {"php": "8", "a/b": "^1"}, "scripts": {"check": ["one", "two"]}}',
    "j/package.json": '{"name": "web", "packageManager": "pnpm@9", "scripts": {"build": "tsc"}, "workspaces": {"packages": ["libs/*"]}, "devDependencies": {"vite": "^5"}}',
    "bad/package.json": "nothing",
    "bad/Cargo.toml": "[package\nname = 1",
    "none/readme.md": "x",
}


@pytest.fixture(scope="module")
def facts(spark):
    return MA.manifest_facts(spark.createDataFrame([("p", path, text) for path, text in FILES.items()] + [("p", "empty/go.mod", None)], "project_id string, path string, text string")).cache()


def of(facts, path, fact, *columns):
    return values(facts.filter((F.col("path") == path) & (F.col("fact") == fact)), *(columns or ("name", "value", "kind")))


def test_python(facts):
    path = "py/pyproject.toml"
    assert of(facts, path, "dependency") == sorted(
        [("httpx", ">=1", "dependency"), ("rich", "*", "dependency"), ("pytest", "*", "devDependency"), ("sphinx", "~=7", "optionalDependency"), ("ruff", "*", "devDependency"), ("attrs", "^23", "dependency"), ("own", "../own", "dependency"), ("deep", "2", "dependency")]
    )
    assert of(facts, path, "project", "name") == [("tool # not a comment",)] and of(facts, path, "command") == [("run", "pkg.cli:main", "entry-point")]
    assert of(facts, path, "member", "value") == [("packages/*",)] and of(facts, path, "reference", "value") == [("../own",)] and of(facts, path, "attribute", "name", "value") == [("pytestTestpaths", "tests")]
    assert values(facts.filter("name = 'httpx'"), "condition") == [("python_version>'3'",)]
    assert of(facts, "old/setup.cfg", "dependency") == [("requests", ">=2", "dependency"), ("six", "*", "dependency")] and of(facts, "old/setup.cfg", "project", "name") == [("olden",)]


def test_cargo_and_go(facts):
    assert of(facts, "rs/Cargo.toml", "dependency", "name", "value", "kind", "condition") == sorted(
        [
            ("serde", "1.0", "dependency", None), ("serde_json", "2", "dependency", None), ("near", "../near", "dependency", None), ("rand", "0.8", "dependency", None), ("text", "lit", "dependency", None),
            ("tokio", "1.3", "dependency", None), ("quick", "1", "devDependency", None), ("cc", "1.1", "devDependency", "build"), ("nix", "0.29", "dependency", "cfg(unix)"),
        ],
        key=repr,
    )
    assert of(facts, "rs/Cargo.toml", "member", "value") == [("a",), ("b/*",)] and of(facts, "rs/Cargo.toml", "project", "name") == [("crate",)] and of(facts, "rs/Cargo.toml", "reference", "value") == [("../near",)]
    assert of(facts, "go/go.mod", "dependency") == [("github.com/a/b", "v1.2.0", "dependency")] and of(facts, "go/go.mod", "reference", "value") == [("../b",)]
    assert of(facts, "go/go.work", "member", "value") == [("./api",), ("./tool",), ("./web",)] and of(facts, "empty/go.mod", "project", "name") == [("empty",)]


def test_jvm(facts):
    assert of(facts, "jvm/pom.xml", "dependency", "name", "value", "kind", "condition") == [("g:m", "3", "dependency", None), ("h:n", "7.1", "devDependency", "test")]
    assert of(facts, "jvm/pom.xml", "project", "name") == [("shop",)] and of(facts, "jvm/pom.xml", "member", "value") == [("core",)]
    assert of(facts, "g/build.gradle.kts", "dependency") == [("a:b", "1", "dependency")] and of(facts, "g/build.gradle.kts", "command") == [("seed", "gradle seed", "build-task")]
    assert of(facts, "g/build.gradle.kts", "reference", "value") == [("core/api",)] and of(facts, "g/settings.gradle.kts", "member", "value") == [("core/api",), ("web",)]
    rows, missing = MA.catalog_dependencies(facts)
    assert values(rows, "path", "name", "version_range", "dependency_type") == [("g/build.gradle.kts", "org.j:core", "2.9", "dependency")] and values(missing, "message") == [("libs.absent",)]
    assert of(facts, "s/build.sbt", "dependency") == [("org.a:b", "1.0", "dependency"), ("org.t:c", "2.0", "devDependency")] and of(facts, "s/build.sbt", "project", "name") == [("scala-app",)]


def test_other_forms(facts):
    assert of(facts, "n/App.csproj", "dependency") == [("Newton", "13", "dependency"), ("xunit", "2", "devDependency")] and of(facts, "n/App.csproj", "reference", "value") == [("../Lib/Lib.csproj",)]
    assert of(facts, "n/All.sln", "member", "value") == [("App/App.csproj",)] and of(facts, "n/New.slnx", "member", "value") == [("App/App.csproj",)]
    assert of(facts, "r/Gemfile", "dependency") == [("puma", "*", "dependency"), ("rails", "~> 7", "dependency"), ("rspec", "*", "devDependency")]
    assert of(facts, "r/kit.gemspec", "dependency") == [("rack", ">= 2", "dependency"), ("rake", "*", "devDependency")] and of(facts, "r/kit.gemspec", "project", "name") == [("kit",)]
    assert of(facts, "d/pubspec.yaml", "dependency") == [("flutter", "*", "dependency"), ("http", "^1", "dependency"), ("own", "../own", "dependency"), ("test", "any", "devDependency")]
    assert of(facts, "w/Package.swift", "dependency") == [("Zip", "2.1", "dependency")] and of(facts, "w/Package.swift", "reference", "value") == [("../Near",)]
    assert of(facts, "e/deno.json", "dependency") == [("zod", "3", "dependency")] and of(facts, "e/deno.json", "warning", "name", "value") == [("remote-import", "r")]
    assert of(facts, "e/deno.json", "attribute", "name", "value") == [("lockPath", "d.lock")] and of(facts, "e/deno.json", "command", "name", "value") == [("dev", "deno run")]
    assert of(facts, "p/composer.json", "dependency") == [("a/b", "^1", "dependency")] and of(facts, "p/composer.json", "command", "name", "value") == [("check", "one"), ("check:1", "two")]
    assert of(facts, "j/package.json", "dependency") == [("vite", "^5", "devDependency")] and of(facts, "j/package.json", "member", "value") == [("libs/*",)] and of(facts, "j/package.json", "tool", "value") == [("pnpm",)]
    assert of(facts, "bad/package.json", "warning", "name") == [("json",)] and of(facts, "bad/Cargo.toml", "warning", "name", "value") == [("toml", "[package")] and of(facts, "none/readme.md", "project") == []


def test_sections_agree_with_the_standard_reader(spark):
    def flat(table, path=()):
        for key, value in table.items():
            if isinstance(value, dict):
                yield from flat(value, (*path, key))
            elif not isinstance(value, list):
                yield ".".join((*path, key)), str(value)

    for text in (PYPROJECT, CARGO, FILES["g/gradle/libs.versions.toml"]):
        row = spark.createDataFrame([(text,)], "text string").select(MA.toml_sections(F.col("text")).alias("s"), MA.toml_unread(F.col("text")).alias("u")).head()
        got = {".".join([*s["head"], *item["keys"]]): item["value"].strip("'\"") for s in row["s"] for item in s["sets"] if item["value"][0] not in "[{"}
        want = dict(flat(tomllib.loads(text)))
        assert row["u"] is None and got.items() <= want.items() and {k for k in want if "." not in k.split("dependencies.")[-1]} - {"x"} >= set(k for k in got if "." not in k.split("dependencies.")[-1])


def test_long_files_and_one_scan(spark):
    n = 100_000
    cargo = "[dependencies]\n" + "\n".join(f'd{i} = "{i}"' for i in range(n)) + "\n[workspace]\nmembers = [" + ",\n".join(f'"m{i}"' for i in range(n)) + "]\n"
    files = spark.createDataFrame([("a/Cargo.toml", cargo), ("a/requirements.txt", "\n".join(f"r{i}==1" for i in range(n))), ("a/Gemfile", "\n".join(f"gem 'g{i}'" for i in range(n)))], "path string, text string")
    facts = MA.manifest_facts(files)
    assert values(facts.filter("fact in ('dependency', 'member')").groupBy("path", "fact").count()) == [("a/Cargo.toml", "dependency", n), ("a/Cargo.toml", "member", n), ("a/Gemfile", "dependency", n), ("a/requirements.txt", "dependency", n)]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan and "Python" not in plan and "MapInPandas" not in plan


def test_importers_of_locks(spark):
    from corpusloom.operators.lookups import lock_asks, resolve_versions
    from corpusloom.sources.locks import lock_rows

    cargo = """version = 4
[[package]]
name = "api"
version = "0.1.0"
dependencies = [
 "serde 1.0.0",
 "rand 0.8.0 (registry+x)",
]

[[package]]
name = "web"
version = "0.1.0"
dependencies = [
 "serde 2.0.0",
]

[[package]]
name = "serde"
version = "1.0.0"
source = "registry+x"

[[package]]
name = "serde"
version = "2.0.0"
source = "registry+x"

[[package]]
name = "rand"
version = "0.8.0"
source = "registry+x"

[[package]]
name = "rand"
version = "0.8.0"
source = "git+y"
"""
    uv = '[[package]]\nname = "tool"\nversion = "1.0"\nsource = { editable = "packages/tool" }\ndependencies = [\n    { name = "httpx", version = "2.0" },\n]\n\n[[package]]\nname = "httpx"\nversion = "1.0"\nsource = { registry = "https://p" }\n\n[[package]]\nname = "httpx"\nversion = "2.0"\nsource = { registry = "https://p" }\n'
    locks = lock_rows(spark.createDataFrame([("rs/Cargo.lock", cargo), ("py/uv.lock", uv)], "path string, text string"))
    assert values(locks.filter("importer is not null"), "name", "importer") == [("tool", "py/packages/tool")]
    wanted = [("rs/api", "api", "cargo", "serde"), ("rs/web", "web", "cargo", "serde"), ("rs/web", "web", "cargo", "rand"), ("rs/api", "api", "cargo", "rand"), ("rs/new", "new", "cargo", "serde"), ("py/packages/tool", "tool", "pypi", "httpx"), ("py/other", "tool", "pypi", "httpx")]
    dependencies = spark.createDataFrame([(*w, "*") for w in wanted], "project_dir string, project_name string, ecosystem string, name string, version_range string")
    members = spark.createDataFrame([(d.split("/")[0], e, d) for d, _, e, _ in wanted], "lock_dir string, ecosystem string, project_dir string")
    got = resolve_versions(dependencies, locks, members, asks=lock_asks(locks))
    assert values(got, "project_dir", "name", "status", "resolved_version") == sorted(
        [
            ("rs/api", "serde", "resolved", "1.0.0"), ("rs/web", "serde", "resolved", "2.0.0"), ("rs/web", "rand", "unlocked", None), ("rs/api", "rand", "resolved", "0.8.0"),
            ("rs/new", "serde", "ambiguous", None), ("py/packages/tool", "httpx", "resolved", "2.0"), ("py/other", "httpx", "ambiguous", None),
        ],
        key=repr,
    )
