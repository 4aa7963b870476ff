"""Plain command lines: splitting, arguments, purpose.  No shell grammar beyond quotes and ``&& || ;``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# One fragment: text up to (and then past) an operator outside quotes.
_QUOTED = r"\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'[^']*+'"
_FRAGMENT = r"((?:[^\\\"'&|;]++|\\[\s\S]|" + _QUOTED + r"|(?!&&|\|\||;)[\s\S])*)(?:&&|\|\||;|$)"
_TOKEN = r"((?:[^\s\"'\\]++|\\[\s\S]|" + _QUOTED + r")+)"


def command_fragments(command: Column | str) -> Column:
    """Commands joined by ``&&``, ``||`` or ``;`` outside quotes, trimmed, empty ones dropped."""
    pieces = F.transform(F.regexp_extract_all(_c(command), F.lit(_FRAGMENT), F.lit(1)), lambda piece: F.trim(piece))
    return F.filter(pieces, lambda piece: piece != "")


def argv(fragment: Column | str) -> Column:
    """Words of one fragment with surrounding quotes removed."""
    words = F.regexp_extract_all(_c(fragment), F.lit(_TOKEN), F.lit(1))
    return F.transform(words, lambda word: F.regexp_replace(word, "^([\"'])([\\s\\S]*)\\1$", "$2"))


def executable(words: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.get(_c(words), F.lit(0)), r"^\./", ""))


def positional(words: Column | str) -> Column:
    """Arguments after the executable that are not flags."""
    words = _c(words)
    rest = F.when(F.size(words) > 1, F.slice(words, 2, F.size(words))).otherwise(F.array().cast("array<string>"))
    return F.filter(rest, lambda word: ~word.startswith("-"))


def subcommand(words: Column | str) -> Column:
    return F.lower(F.get(positional(words), F.lit(0)))


# Purposes by executable and subcommand, tested in this order.
TEST_TOOLS = ("pytest", "jest", "cypress")
PURPOSE_BY_SUBCOMMAND = [
    ("test", r"^(?:test|emulators:exec)$"),
    ("deploy", r"^(?:deploy|publish|apply)$"),
    ("build", r"^(?:build|compile|package|bundle)$"),
    ("install", r"^(?:install|add|restore|sync)$"),
    ("start", r"^(?:run|dev|start|up|emulators:start)$"),
]
# Technology started by an executable name.
TOOL_TECHNOLOGY = {
    "node": "nodejs", "npm": "npm", "pnpm": "pnpm", "yarn": "yarn", "bun": "bun", "deno": "deno", "python": "python",
    "python3": "python", "pip": "pip", "pip3": "pip", "uv": "uv", "cargo": "cargo", "composer": "composer", "nuget": "nuget",
    "mvn": "maven", "mvnw": "maven", "gradle": "gradle", "gradlew": "gradle", "java": "jvm", "go": "go", "ruby": "ruby",
    "php": "php", "webpack": "webpack", "esbuild": "esbuild", "jest": "jest", "pytest": "pytest", "cypress": "cypress",
    "kubectl": "kubernetes", "netlify": "netlify", "nginx": "nginx", "httpd": "apache-http-server",
    "apache2": "apache-http-server", "dotnet": "dotnet", "docker-compose": "docker-compose",
}


def command_purpose(words: Column | str) -> Column:
    """start / build / test / deploy / install / tool."""
    words = _c(words)
    tool, sub = F.get(words, F.lit(0)), F.coalesce(subcommand(words), F.lit(""))
    asks_info = F.exists(words, lambda word: word.isin("--version", "--help"))
    out = F.when((tool == "esbuild") & ~asks_info, F.lit("build")).when(tool.isin(*TEST_TOOLS), F.lit("test"))
    for purpose, rule in PURPOSE_BY_SUBCOMMAND:
        out = out.when(sub.rlike(rule), F.lit(purpose))
    return out.otherwise(F.lit("tool"))


def option(words: Column | str, keys: Sequence[str]) -> Column:
    """Value after a flag or in ``flag=value``; the first listed key that is present wins."""
    words = _c(words)
    found = []
    for key in keys:
        prefix = f"{key}="
        at = F.array_position(words, key).cast("int")
        following = F.when(at > 0, F.get(words, at))
        inline = F.get(F.filter(words, lambda word: word.startswith(prefix)), F.lit(0))
        found += [following, F.substring(inline, F.lit(len(key) + 2), F.length(inline))]
    return F.coalesce(*found)
