"""Ranked literal search over prepared documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import lookup_key, normalize_query

# Scores for an exact, a prefix and a contained match, by field.
FIELD_SCORES = {"name": (100, 90, 70), "alias": (88, 78, 62), "package": (86, 76, 60), "summary": (44, 38, 28)}


def _score(value: Column, query: str, scores: tuple[int, int, int]) -> Column:
    text = lookup_key(value)
    return F.when(text == query, scores[0]).when(text.startswith(query), scores[1]).when(F.contains(text, F.lit(query)), scores[2]).otherwise(0)


def dictionary_search(entries: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Best entries for a query: highest field score first, then name.

    ``entries``: ``id``, ``name`` and optional ``aliases``/``packages`` (arrays) and ``summary``.  ``matched_field`` is
    the first field, in name → alias → package → summary order, that reaches the score.
    """
    query = query.strip().lower()
    columns, scores = set(entries.columns), {"name": _score(F.col("name"), query, FIELD_SCORES["name"])}
    for field, column in (("alias", "aliases"), ("package", "packages")):
        if column in columns:
            listed = F.coalesce(column, F.array().cast("array<string>"))
            scores[field] = F.coalesce(F.array_max(F.transform(listed, _scorer(query, field))), F.lit(0))
    if "summary" in columns:
        scores["summary"] = _score(F.coalesce("summary", F.lit("")), query, FIELD_SCORES["summary"])
    total = F.greatest(*scores.values()) if len(scores) > 1 else scores["name"]
    matched = None
    for field, score in scores.items():
        test = score == total
        matched = F.when(test, F.lit(field)) if matched is None else matched.when(test, F.lit(field))
    scored = entries.withColumn("score", total).withColumn("matched_field", matched)
    hits = scored.filter(F.col("score") > 0) if query else scored.filter(F.lit(False))
    return hits.orderBy(F.desc("score"), "name", "id").limit(max(1, limit))


def _scorer(query: str, field: str):
    def score(item: Column) -> Column:
        return _score(item, query, FIELD_SCORES[field])

    return score


SECTIONS = ("names", "paths", "groups", "fields")


def search_document(names: Sequence[Column], paths: Sequence[Column] = (), groups: Sequence[Column] = (), fields: Sequence[Column] = ()) -> Column:
    """Searchable sections of an entity; only user-facing columns belong here."""

    def section(columns: Sequence[Column]) -> Column:
        return F.array_compact(F.array(*columns)) if columns else F.array().cast("array<string>")

    return F.struct(section(names).alias("names"), section(paths).alias("paths"), section(groups).alias("groups"), section(fields).alias("fields"))


def entity_search(entities: DataFrame, query: str, document: str = "document") -> DataFrame:
    """Entities in which every query token occurs in some section.

    ``rank``: 0 exact name, 1 name prefix, 2 all tokens within names, 3 otherwise; ``matched`` lists, section by section,
    whether a token was first found there.
    """
    spark_query = " ".join(query.strip().replace("\\", "/").lower().split())
    if not spark_query:
        return entities.withColumn("rank", F.lit(0)).withColumn("matched", F.array().cast("array<string>")).filter(F.lit(False))
    tokens = spark_query.split(" ")
    normal = {s: F.transform(F.col(f"{document}.{s}"), lambda item: normalize_query(item)) for s in SECTIONS}
    prepared = entities.select("*", *[normal[s].alias(f"_{s}") for s in SECTIONS])

    def holds(section: str, token: str) -> Column:
        return F.exists(F.col(f"_{section}"), lambda item: F.contains(item, F.lit(token)))

    first_hits = []
    for token in tokens:
        found = None
        for section in SECTIONS:
            found = F.when(holds(section, token), F.lit(section)) if found is None else found.when(holds(section, token), F.lit(section))
        first_hits.append(found)
    every = F.lit(True)
    for hit in first_hits:
        every = every & hit.isNotNull()
    in_names = F.lit(True)
    for token in tokens:
        in_names = in_names & holds("names", token)
    rank = (
        F.when(F.array_contains("_names", spark_query), 0)
        .when(F.exists("_names", lambda item: item.startswith(spark_query)), 1)
        .when(in_names, 2)
        .otherwise(3)
    )
    matched = F.array_distinct(F.array(*first_hits))
    return prepared.filter(every).withColumn("rank", rank).withColumn("matched", matched).drop(*[f"_{s}" for s in SECTIONS])


def ranked(matches: DataFrame, label: str = "label", path: str = "path", collation: str | None = None) -> DataFrame:
    """Result order: rank, label, path, id.  ``collation`` (e.g. ``UNICODE``) replaces binary text order."""

    def text(column: str) -> Column:
        return F.collate(F.col(column), collation) if collation else F.col(column)

    return matches.orderBy("rank", text(label), F.coalesce(text(path), F.lit("")), "id")


def explaining_fields(matches: DataFrame, query: str, document: str = "document") -> DataFrame:
    """Fields selected by the tokens that name, path and group do not explain."""
    tokens = [t for t in " ".join(query.strip().replace("\\", "/").lower().split()).split(" ") if t]
    known = F.transform(F.concat(F.col(f"{document}.names"), F.col(f"{document}.paths"), F.col(f"{document}.groups")), lambda item: normalize_query(item))
    left = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda token: ~F.exists(known, lambda item: F.contains(item, token)))
    fields = F.filter(F.col(f"{document}.fields"), lambda field: F.exists(left, lambda token: F.contains(normalize_query(field), token)))
    return matches.withColumn("matching_fields", fields)


def display_order(items: DataFrame, kind_rank: dict[str, int], kind: str = "kind", label: str = "label") -> DataFrame:
    """Deterministic order of mixed children: kind rank, label, id."""
    rank = None
    for name, value in kind_rank.items():
        rank = F.when(F.col(kind) == name, value) if rank is None else rank.when(F.col(kind) == name, value)
    return items.withColumn("kind_rank", rank.otherwise(len(kind_rank))).orderBy("kind_rank", label, "id")
