"""Corpus scan, input selection and guards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import language_of
from ..functions.paths import _c, extension, file_name, normalize_path
from ..plans import cut_lineage, lookup_join

# Directories never read, sensitive names, and the files a scan is interested in.
EXCLUDED_DIRECTORIES = (
    ".git", "node_modules", "dist", "build", "coverage", ".wrangler", ".next", ".vite", ".cache", ".venv", "venv",
    "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", "tmp", "temp", "bin", "obj",
)
COMPILATION_DATABASE = "compile_commands.json"
SENSITIVE_EXTENSIONS = (".pem", ".key", ".p12", ".pfx", ".jks")
SENSITIVE_NAME = r"(?:^|[-_.])(?:credentials?|secrets?|kubeconfig)(?:$|[-_.])|\.tfstate(?:\.|$)"
CONFIG_NAMES = (
    "package.json", "pnpm-workspace.yaml", "pnpm-workspace.yml", "firebase.json", ".firebaserc", ".vscodeignore", "readme.md",
    "wrangler.json", "wrangler.jsonc", "wrangler.toml", "gemfile.lock", "pubspec.lock", "package.resolved",
)
CONFIG_NAME_RULES = (
    r"^(?:vite|vitest)\.config\.", r"^tsconfig.*\.json$", r"\.(?:slnx|sln|csproj)$",
    r"^(?:pyproject\.toml|requirements[^/]*\.txt|setup\.cfg|uv\.lock|pip\.(?:conf|ini)|pytest\.ini|pom\.xml|(?:build|settings)\.gradle(?:\.kts)?"
    r"|build\.sbt|libs\.versions\.toml|directory\.(?:build|packages)\.props|global\.json|nuget\.config|go\.(?:mod|work)|cargo\.(?:toml|lock)"
    r"|composer\.(?:json|lock)|gemfile|pubspec\.yaml|package\.swift|deno\.(?:jsonc?|lock)|bun\.(?:lock|lockb)|bunfig\.toml|yarn\.lock"
    r"|\.yarnrc\.yml|netlify\.toml|nginx\.conf|httpd\.conf|apache2\.conf|\.gitlab-ci\.yml)$",
    r"\.(?:gemspec|tf|json|jsonc|ya?ml|xaml|html|astro|vue|svelte|css)$", r"^(?:webpack|jest|cypress|nuxt|astro|svelte)\.config\.",
)
USAGE_EXTENSIONS = (".cjs", ".cts", ".js", ".jsx", ".mjs", ".mts", ".ts", ".tsx", ".vue", ".svelte", ".astro", ".html", ".xaml")
SECRET_MANIFEST = r"(?:^|\n)\s*kind\s*:\s*[\"']?Secret\b|\"kind\"\s*:\s*\"Secret\""


def scan_files(spark: SparkSession, root: str, by_project: bool = True) -> DataFrame:
    """Files below ``root``: ``project_id`` (first folder), normalised ``path``, ``name``, ``extension``, ``size``, ``text``.

    The content column is only read when ``text`` is used: column pruning reaches the file source.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    below = F.substr("path", F.locate(base, "path") + len(base))
    if by_project:
        project, local = F.substring_index(below, "/", 1), F.regexp_replace(below, "^[^/]*/", "")
    else:
        project, local = F.lit(""), below
    files = raw.select(project.alias("project_id"), normalize_path(local).alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    return describe(strip_common_root(files, ["project_id"])).filter(not_excluded("path"))


def describe(files: DataFrame) -> DataFrame:
    return files.withColumn("name", file_name("path")).withColumn("extension", extension("path"))


def strip_common_root(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Remove the first path segment where all files of a project share it (a lone top-level file stays)."""
    first = F.substring_index("path", "/", 1)
    roots = files.groupBy(*by).agg(F.min(first).alias("_low"), F.max(first).alias("_high"), F.max(F.contains("path", F.lit("/"))).alias("_deep"), F.count(F.lit(1)).alias("_n"))
    shared = roots.filter((F.col("_low") == F.col("_high")) & (F.col("_deep") | (F.col("_n") > 1))).select(*by, F.col("_low").alias("_root"))
    joined = lookup_join(files, shared, by)
    cut = F.substring("path", F.length("_root") + 2, F.length("path"))
    path = F.when(F.col("_root").isNull(), F.col("path")).when(cut == "", F.lit(".")).otherwise(cut)
    return joined.withColumn("path", path).drop("_root")


def not_excluded(path: Column | str) -> Column:
    """No directory of the path is excluded; a compilation database may sit below ``build``."""
    parts = F.split(normalize_path(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hits = F.filter(F.transform(folders, lambda part: F.lower(part)), lambda part: part.isin(*EXCLUDED_DIRECTORIES))
    database = (F.element_at(parts, -1) == COMPILATION_DATABASE) & F.forall(hits, lambda part: part == "build")
    return (F.size(hits) == 0) | database


def is_sensitive(path: Column | str) -> Column:
    name = F.lower(file_name(path))
    return name.startswith(".env") | extension(path).isin(*SENSITIVE_EXTENSIONS) | name.rlike(SENSITIVE_NAME)


def is_config(path: Column | str) -> Column:
    name = F.lower(file_name(path))
    return not_excluded(path) & ~is_sensitive(path) & (name.isin(*CONFIG_NAMES) | name.rlike("|".join(CONFIG_NAME_RULES)))


def is_usage_source(path: Column | str) -> Column:
    return not_excluded(path) & ~is_sensitive(path) & extension(path).isin(*USAGE_EXTENSIONS)


def is_semantic_source(path: Column | str) -> Column:
    return not_excluded(path) & ~is_sensitive(path) & language_of(path).isNotNull()


def select_inputs(files: DataFrame) -> DataFrame:
    """Files worth reading, with the classes that select them; a pure path filter, so texts stay unread until here."""
    return (
        files.withColumn("is_config", is_config("path")).withColumn("is_usage", is_usage_source("path")).withColumn("is_semantic", is_semantic_source("path"))
        .filter("is_config or is_usage or is_semantic")
    )


def guard(path: Column | str, text: Column | str) -> Column:
    """Reason an input is left out, whatever its size: ``unreadable`` or ``secret``; null when it may be used."""
    secret = _c(path).rlike(r"(?i)\.(?:ya?ml|json)$") & _c(text).rlike(SECRET_MANIFEST)
    return F.when(_c(text).isNull(), "unreadable").when(secret, "secret")


def guard_inputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable inputs, and one warning per input left out."""
    marked = files.withColumn("_reason", guard("path", "text"))
    warning = marked.filter(F.col("_reason").isNotNull()).select(
        *[c for c in files.columns if c == "project_id"], "path", F.col("_reason").alias("reason"),
        F.when(F.col("_reason") == "unreadable", "error").otherwise("warning").alias("severity"),
    )
    return marked.filter(F.col("_reason").isNull()).drop("_reason"), warning


def follow_references(files: DataFrame, loaded: DataFrame, references: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Add files named by files already loaded, until nothing new is named; a file is read once, so cycles end.

    ``references`` maps newly loaded files to the paths they name (``path``).
    """
    key = [*by, "path"]
    allowed = files.filter(not_excluded("path") & ~is_sensitive("path"))
    fresh = loaded = cut_lineage(loaded)
    while True:
        named = references(fresh).select(*key).distinct().join(loaded.select(*key), key, "left_anti")
        fresh = cut_lineage(allowed.join(named, key, "left_semi"))
        if fresh.isEmpty():
            return loaded
        loaded = cut_lineage(loaded.unionByName(fresh, allowMissingColumns=True))
