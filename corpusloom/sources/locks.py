"""Lock files → locked version rows: ``path``, ``lock_dir``, ``ecosystem``, ``name``, ``version``, ``descriptor``,
``source_identity``, ``framework``, ``unsupported``, and who asks for what in the lock: ``importer``, ``asks``.

Every lock is read once, by the expression of its kind; its rows are one array, exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dir_name, file_name, normalize_path
from ..operators.lookups import valid_version
from .manifests import plain_json

# File names, and the ecosystem of each.
LOCKS = {
    "cargo.lock": "cargo", "uv.lock": "pypi", "package-lock.json": "npm", "yarn.lock": "npm", "bun.lock": "npm", "deno.lock": "npm",
    "composer.lock": "composer", "packages.lock.json": "nuget", "package.resolved": "swift", "pubspec.lock": "dart",
}
_ASK = "struct<name:string,version:string,source_identity:string>"
_ROW = f"struct<name:string,version:string,descriptor:string,source_identity:string,framework:string,importer:string,asks:array<{_ASK}>>"
_PIN = "array<struct<identity:string,package:string,state:struct<version:string>>>"
_JSON = (
    "packages string, `packages-dev` array<struct<name:string,version:string>>, specifiers map<string,string>, "
    f"dependencies map<string,map<string,struct<type:string,resolved:string>>>, pins {_PIN}, object struct<pins:{_PIN}>"
)


def _locked(name: Column, version: Column, **more: Column) -> Column:
    text = lambda key: more.get(key, F.lit(None)).cast("string").alias(key)
    asks = more.get("asks", F.lit(None)).cast(f"array<{_ASK}>").alias("asks")
    return F.struct(name.cast("string").alias("name"), version.cast("string").alias("version"), text("descriptor"), text("source_identity"), text("framework"), text("importer"), asks)


def _empty() -> Column:
    return F.array().cast(f"array<{_ROW}>")


def _found(text: Column, rule: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rule), F.lit(group))


def _blank_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _ask(name: Column, version: Column, source: Column) -> Column:
    return F.struct(name.alias("name"), _blank_null(version).alias("version"), _blank_null(source).alias("source_identity"))


def _package_blocks(text: Column, table_source: bool) -> Column:
    """``[[package]]`` blocks of Cargo and uv locks, with what each package asks for."""
    pieces = F.split(text, r"(?m)^\[\[package\]\][ \t]*$")
    field = lambda b, key: F.nullif(F.regexp_extract(b, rf"(?m)^{key}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    source = lambda b: _blank_null(F.regexp_extract(b, r"(?m)^source\s*=\s*(.+)$", 1))
    listed = lambda b: F.regexp_extract(b, r"(?m)^dependencies\s*=\s*\[((?:[^\[\]\"]++|\"[^\"]*+\"|\[[^\]]*+\])*+)\]", 1)
    if table_source:
        item = lambda i, key: F.regexp_extract(i, rf"\b{key}\s*=\s*\"([^\"]*)\"", 1)
        asks = lambda b: F.transform(_found(listed(b), r"(\{(?:[^{}]++|\{[^{}]*+\})*+\})"), lambda i: _ask(item(i, "name"), item(i, "version"), F.regexp_extract(i, r"\bsource\s*=\s*(\{[^{}]*\})", 1)))
        # A package of this workspace names its own folder.
        local = lambda b: F.coalesce(*[F.nullif(F.regexp_extract(b, rf"(?m)^source\s*=\s*\{{[^}}\n]*\b{key}\s*=\s*\"([^\"]*)\"", 1), F.lit("")) for key in ("editable", "virtual", "directory")])
    else:
        rule = r"^(\S+)(?:\s+([^\s(]+))?(?:\s+\(([^)]+)\))?$"
        asks = lambda b: F.transform(_found(listed(b), r"\"([^\"]*)\""), lambda i: _ask(F.regexp_extract(i, rule, 1), F.regexp_extract(i, rule, 2), F.regexp_extract(i, rule, 3)))
        # A Cargo source is written in quotes and asked for without.
        source = lambda b: F.nullif(F.regexp_extract(b, r"(?m)^source\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
        local = lambda b: F.lit(None).cast("string")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda b: _locked(field(b, "name"), field(b, "version"), source_identity=source(b), importer=local(b), asks=asks(b)))


def _npm(packages: Column) -> Column:
    entries = F.map_entries(F.from_json(packages, "map<string,struct<name:string,version:string,link:boolean>>"))
    kept = F.filter(entries, lambda e: F.contains(e["key"], F.lit("node_modules/")) & ~F.coalesce(e["value"]["link"], F.lit(False)))
    holder = lambda e: F.regexp_replace(F.regexp_extract(e["key"], r"^(.*)node_modules/", 1), "/$", "")
    return F.transform(kept, lambda e: _locked(F.coalesce(e["value"]["name"], F.substring_index(e["key"], "node_modules/", -1)), e["value"]["version"], importer=holder(e)))


def _yarn(text: Column) -> Column:
    """Both forms: descriptors before a colon, entries between blank lines."""
    # The gap between two entries is a blank line.
    entries = F.split(text, r"\r?\n\r?\n")
    header = lambda b: F.split(F.regexp_extract(b, r"(?m)^([^\s#][^\n]*):\s*$", 1), r",\s*")
    version = lambda b: F.regexp_extract(b, r"(?m)^\s+version\s+\"([^\"]+)\"", 1)
    bare = lambda d: F.regexp_replace(d, '^"|"$', "")
    old = F.flatten(F.transform(F.filter(entries, lambda b: version(b) != ""), lambda b: F.transform(header(b), lambda d: _locked(F.regexp_extract(bare(d), r"^(.+)@[^@]*$", 1), version(b), descriptor=F.regexp_extract(bare(d), r"@([^@]*)$", 1)))))
    berry = F.filter(entries, lambda b: b.rlike(r"(?m)^\s+version:\s*\"?[^\s\"]+") & b.rlike(r"(?m)^\s+resolution:\s*\"[^\"]*@npm:"))
    keys = lambda b: F.filter(F.split(F.regexp_extract(b, r"(?m)^\"([^\"]+)\":\s*$", 1), r",\s*"), lambda d: F.contains(d, F.lit("@npm:")))
    number = lambda b: F.regexp_extract(b, r"(?m)^\s+version:\s*\"?([^\s\"]+)", 1)
    new = F.flatten(F.transform(berry, lambda b: F.transform(keys(b), lambda d: _locked(F.regexp_extract(d, r"^(.+)@npm:", 1), number(b), descriptor=F.regexp_extract(d, r"@npm:(.*)$", 1)))))
    return F.when(text.rlike(r"(?m)^__metadata:"), new).otherwise(old)


def _bun(packages: Column) -> Column:
    resolved = lambda e: F.regexp_extract(e["value"], r"^\[\s*\"([^\"]+)\"", 1)
    kept = F.filter(F.map_entries(F.from_json(packages, "map<string,string>")), lambda e: F.regexp_extract(resolved(e), r"^(.+)@[^@]*$", 1) == e["key"])
    return F.transform(kept, lambda e: _locked(e["key"], F.regexp_extract(resolved(e), r"@([^@]*)$", 1)))


def lock_rows(files: DataFrame) -> DataFrame:
    if "project_id" not in files.columns:
        files = files.withColumn("project_id", F.lit(""))
    name = F.lower(file_name("path"))
    found = files.filter(name.isin(*LOCKS)).select("project_id", "path", name.alias("_name"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.withColumn("_json", F.when(F.col("_name").rlike(r"\.json$|\.resolved$|^(?:bun|deno|composer)\.lock$"), F.from_json(plain_json("text"), _JSON)))
    text, j = F.col("text"), F.col("_json")
    deno = F.transform(F.filter(F.map_entries(j["specifiers"]), lambda e: e["key"].startswith("npm:")), lambda e: F.struct(F.regexp_replace(e["key"], "^npm:", "").alias("d"), e["value"].alias("v")))
    listed = lambda column: F.coalesce(column, F.array().cast("array<struct<name:string,version:string>>"))
    composer = F.concat(listed(F.from_json(j["packages"], "array<struct<name:string,version:string>>")), listed(j["packages-dev"]))
    nuget = F.flatten(
        F.transform(
            F.map_entries(j["dependencies"]),
            lambda f: F.transform(F.filter(F.map_entries(f["value"]), lambda r: F.coalesce(r["value"]["type"], F.lit("")) != "Project"), lambda r: _locked(r["key"], r["value"]["resolved"], framework=f["key"])),
        )
    )
    dart = _found(text, r"(?m)(^  \w+:[ \t]*\r?\n(?:    [^\n]*(?:\n|$))+)")
    readers = {
        "cargo.lock": _package_blocks(text, table_source=False),
        "uv.lock": _package_blocks(text, table_source=True),
        "package-lock.json": _npm(j["packages"]),
        "yarn.lock": _yarn(text),
        "bun.lock": _bun(j["packages"]),
        "deno.lock": F.transform(deno, lambda e: _locked(F.regexp_extract(e["d"], r"^(.+)@[^@]*$", 1), e["v"], descriptor=F.regexp_extract(e["d"], r"@([^@]*)$", 1))),
        "composer.lock": F.transform(composer, lambda e: _locked(e["name"], e["version"])),
        "packages.lock.json": nuget,
        "package.resolved": F.transform(F.coalesce(j["pins"], j["object"]["pins"]), lambda e: _locked(F.coalesce(e["identity"], e["package"]), e["state"]["version"])),
        "pubspec.lock": F.transform(dart, lambda b: _locked(F.regexp_extract(b, r"^  (\w+):", 1), F.regexp_extract(b, r"(?m)^    version:\s*\"?([^\s\"]+)", 1))),
    }
    rows = F.when(F.lit(False), _empty())
    ecosystem = F.when(F.lit(False), F.lit(""))
    for file, reader in readers.items():
        rows, ecosystem = rows.when(F.col("_name") == file, reader), ecosystem.when(F.col("_name") == file, LOCKS[file])
    out = found.select("project_id", "path", ecosystem.alias("ecosystem"), F.explode(F.coalesce(rows, _empty())).alias("r")).select("project_id", "path", "ecosystem", "r.*")
    out = out.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("version", F.lit("")) != ""))
    importer = F.when(F.col("importer").isNotNull() & (F.col("ecosystem") == "pypi"), normalize_path(F.concat_ws("/", F.nullif(dir_name("path"), F.lit(".")), "importer"))).otherwise(F.col("importer"))
    return out.withColumn("importer", importer).withColumn("lock_dir", dir_name("path")).withColumn("unsupported", ~valid_version(F.col("ecosystem"), F.col("version")))
