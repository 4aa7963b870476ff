"""Names, identifiers, classification and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# Language by file extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx",
    "py": "python", "pyi": "python", "java": "java", "cs": "c_sharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "dart": "dart", "vue": "vue", "svelte": "svelte", "astro": "astro", "html": "html", "xaml": "xaml",
    "sql": "sql", "prisma": "prisma", "graphql": "graphql", "gql": "graphql",
}

# Responsibility patterns, tested in this order (pattern on path, pattern on text).
RESPONSIBILITY = [
    ("Tests", r"(?i)(?:^|/)(?:__tests__|tests?|specs?)(?:/|\.)|\.(?:test|spec)\.", None),
    ("Authentication", r"(?i)(?:^|/)(?:auth|authentication|authorization)(?:/|\.)", r"verifyIdToken|signInWith|authenticate\("),
    ("Persistence", r"(?i)(?:^|/)(?:schema|migrations|database|db|repositories|persistence)(?:/|\.)|\.repository\.", None),
    ("Data models", r"(?i)(?:^|/)(?:models?|entities|types|dto)(?:/|\.)", None),
    ("API", r"(?i)(?:^|/)(?:routes?|controllers?|api|handlers?|endpoints?)(?:/|\.)", None),
    ("UI", r"\.(?:tsx|jsx|vue|svelte)$|\.component\.|(?:^|/)(?:components|pages|views|screens)(?:/|\.)", None),
    ("Domain services", r"(?i)(?:^|/)(?:services?|domain|usecases?)(?:/|\.)|\.service\.", None),
    ("Infrastructure", r"(?i)(?:^|/)(?:config|infrastructure|infra|deploy)(?:/|\.)", None),
]
OTHER_RESPONSIBILITY = "Shared logic"

# Auxiliary and generated sources.
AUXILIARY_PATH = (
    r"(?i)(?:^|/)(?:__tests__|__mocks__|__fixtures__|tests?|specs?|mocks?|fixtures?|samples?|examples?|generated)(?:/|\.)"
    r"|\.(?:test|spec|mock|fixture|generated|g)\.|\.Tests(?:/|\.)"
)
GENERATED_PATH = r"(?i)(?:^|/)generated/"
GENERATED_HEADER = r"(?i)\b(?:auto.generated|generated by|code generated|do not edit)\b"

# Inverse relation labels and display labels.
INVERSE_RELATION = {
    "contains": "contained-by", "uses": "used-by", "binds-to": "bound-from", "uses-config": "config-for",
    "declares": "declared-by", "matches": "matched-by", "depends-on": "used-by", "resolves-to": "resolved-from",
    "executes": "executed-by", "starts": "started-by", "runs-in": "hosts", "expands-to": "expanded-by", "imports": "imported-by",
}
STATUS_LABEL = {"active": "利用中", "experimental": "実験的", "legacy": "レガシー", "deprecated": "非推奨"}
CONFIDENCE_LABEL = {"source": "ソースで確認", "inferred": "推定", "observed": "実測", "unresolved": "未解決"}
KIND_LABEL = {
    "function": "Function", "entry": "Entry point", "request": "API request", "operation": "Operation", "value": "Data",
    "model": "Model / Schema", "resource": "Resource", "subsystem": "Subsystem", "external": "External call",
    "span": "Span", "log": "Log",
}


def mapped(column: Column | str, table: dict[str, str]) -> Column:
    """Look a value up in a small fixed table; null when absent."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.create_map(*entries)[_c(column)]


def normalize_query(text: Column | str) -> Column:
    """Trimmed, slashes unified, runs of white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.translate(F.trim(_c(text)), "\\", "/"), r"\s+", " "))


def lookup_key(text: Column | str) -> Column:
    return F.lower(F.trim(_c(text)))


def normalize_identifier(ecosystem: Column | str, name: Column | str) -> Column:
    """Package identity per ecosystem: PyPI folds case and separators, NuGet folds case."""
    ecosystem, trimmed = _c(ecosystem), F.trim(_c(name))
    return (
        F.when(ecosystem == "pypi", F.regexp_replace(F.lower(trimmed), r"[-_.]+", "-"))
        .when(ecosystem == "nuget", F.lower(trimmed))
        .otherwise(trimmed)
    )


def language_of(path: Column | str) -> Column:
    return mapped(F.lower(F.element_at(F.split(_c(path), r"\."), -1)), LANGUAGE_BY_EXTENSION)


def responsibility(path: Column | str, text: Column | str | None = None) -> Column:
    """First matching responsibility label of a source file."""
    path = _c(path)
    out = None
    for label, path_rule, text_rule in RESPONSIBILITY:
        test = path.rlike(path_rule)
        if text_rule and text is not None:
            test = test | F.coalesce(_c(text).rlike(text_rule), F.lit(False))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(OTHER_RESPONSIBILITY))


def is_auxiliary(path: Column | str) -> Column:
    return _c(path).rlike(AUXILIARY_PATH)


def is_generated(path: Column | str, text: Column | str) -> Column:
    return _c(path).rlike(GENERATED_PATH) | _c(text).rlike(GENERATED_HEADER)


def npm_root(specifier: Column | str) -> Column:
    """Package part of an import specifier, scope-aware; null for relative and absolute paths."""
    name = F.trim(_c(specifier))
    parts = F.filter(F.split(name, "/"), lambda part: part != "")
    root = F.when(name.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))
    return F.when((name != "") & ~name.startswith(".") & ~name.startswith("/"), root)


def normalize_route(address: Column | str) -> Column:
    """Route identity: no host, no query, parameters as ``:param``, no trailing slash."""
    out = F.regexp_replace(_c(address), r"^https?://[^/]+", "")
    out = F.regexp_replace(out, r"\$\{[^}]*\}", ":param")
    out = F.regexp_replace(F.substring_index(out, "?", 1), r":\w+", ":param")
    return F.regexp_replace(out, "/$", "")


ROUTE_FILE = r"(?:^|/)(?:app|pages|routes)/(.*?)(?:/route|/\+server|/index)?\.[cm]?[jt]sx?$"


def file_route(path: Column | str) -> Column:
    """Route a file stands for under file-based routing; null outside route folders."""
    inner = F.regexp_extract(_c(path), ROUTE_FILE, 1)
    route = F.regexp_replace(inner, r"\([^/]*\)/", "")
    route = F.regexp_replace(route, r"\[\.\.\.(.*?)\]", "*")
    route = F.regexp_replace(route, r"\[(.*?)\]", ":$1")
    return F.when(_c(path).rlike(ROUTE_FILE), F.concat(F.lit("/"), route))


def inverse_relation(kind: Column | str) -> Column:
    return mapped(kind, INVERSE_RELATION)


def kind_label(kind: Column | str) -> Column:
    """Display label of a kind of node; the kind itself where it has none."""
    return F.coalesce(mapped(kind, KIND_LABEL), _c(kind))


def confidence_label(confidence: Column | str) -> Column:
    return F.coalesce(mapped(confidence, CONFIDENCE_LABEL), _c(confidence))


def status_label(status: Column | str) -> Column:
    """Display label of a recorded status; null where none is recorded."""
    return mapped(status, STATUS_LABEL)


def relation_label_for(node: Column, src: Column, dst: Column, kind: Column, label: Column) -> Column:
    """Label of an edge as read from ``node``."""
    return F.when(src == node, label).when(dst == node, inverse_relation(kind)).otherwise(label)
