"""SQL, Prisma and GraphQL schemas → models, fields and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[\"`\[]?[\w]+[\"`\]]?(?:\.[\"`\[]?[\w]+[\"`\]]?)?"
# Possessive runs: the matcher loops over them instead of recursing, whatever the length of a table.
_INNER = r"[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_TABLE = r"(?is)(create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?" + _NAME + r"\s*\((?:" + _INNER + r")*+\))"
_ITEM = r"((?:[^,()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))++)"
_TABLE_RULE = r"(?i)^(?:constraint\s+\S+\s+)?(?:primary\s+key|foreign\s+key|unique|check|exclude|index|key)\b"
_FACT = (
    "struct<fact:string,label:string,coverage:string,pos:int,name:string,type:string,nullable:boolean,key:string,target:string,default_value:string,"
    "kind:string,columns:array<string>,target_columns:array<string>>"
)
_TARGET = r"(?i)\breferences\s+(" + _NAME + r")\s*(?:\(([^)]*)\))?"



def _clean(name: Column) -> Column:
    return F.regexp_replace(name, r"[\"`\[\]]", "")


def _columns(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda part: _clean(F.trim(part))), lambda part: part != "")


def _fact(fact: str, **values: Column) -> Column:
    fields = [part.split(":", 1) for part in _FACT[len("struct<") : -1].replace("array<string>", "array").split(",")]
    as_type = {"array": "array<string>"}
    return F.struct(*[(F.lit(fact) if name == "fact" else values.get(name, F.lit(None))).cast(as_type.get(kind, kind)).alias(name) for name, kind in fields])


def _found(text: Column, rule: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rule), F.lit(1))


def _last_part(name: Column) -> Column:
    return F.nullif(F.element_at(F.split(_clean(name), r"\."), -1), F.lit(""))


def _table(t: Column, coverage: Column) -> Column:
    """Rows of one CREATE TABLE statement."""
    label = F.element_at(F.split(_clean(F.regexp_extract(t, r"(?is)table\s+(?:if\s+not\s+exists\s+)?(" + _NAME + r")\s*\(", 1)), r"\."), -1)
    body = F.regexp_extract(t, r"(?s)^[^(]*\((.*)\)$", 1)
    items = F.transform(_found(body, _ITEM), lambda i, at: F.struct(F.trim(F.regexp_replace(i, r"\s+", " ")).alias("item"), at.alias("pos"), label.alias("label")))
    none = F.array().cast("array<string>")

    def rows(x: Column) -> Column:
        item, pos = x["item"], x["pos"]
        referenced, primary = _last_part(F.regexp_extract(item, _TARGET, 1)), item.rlike(r"(?i)\bprimary\s+key\b")
        name = _clean(F.regexp_extract(item, r"^(\S+)", 1))
        key = F.when(primary, "primary").when(referenced.isNotNull(), "foreign")
        field = _fact(
            "field", label=x["label"], pos=pos, name=name, type=F.regexp_extract(item, r"^\S+\s+([^\s(]+(?:\s*\([^)]*\))?)", 1), nullable=~item.rlike(r"(?i)\bnot\s+null\b") & ~primary,
            key=key, target=referenced, default_value=F.nullif(F.regexp_extract(item, r"(?i)\bdefault\s+('[^']*'|\S+)", 1), F.lit("")),
        )
        inline = _fact("constraint", label=x["label"], pos=pos, kind=key, columns=F.array(name), target=referenced, target_columns=none)
        kind = F.when(primary, "primary").when(item.rlike(r"(?i)\bforeign\s+key\b"), "foreign").when(item.rlike(r"(?i)\bunique\b"), "unique").when(item.rlike(r"(?i)\bcheck\b"), "check").otherwise("index")
        listed = F.when(kind != "check", _columns(F.regexp_extract(item, r"\(([^)]*)\)", 1))).otherwise(none)
        rule = _fact("constraint", label=x["label"], pos=pos, kind=kind, columns=listed, target=referenced, target_columns=F.when(kind == "foreign", _columns(F.regexp_extract(item, _TARGET, 2))).otherwise(none))
        column = F.when(key.isNotNull(), F.array(field, inline)).otherwise(F.array(field))
        return F.when(item == "", F.array().cast(f"array<{_FACT}>")).when(item.rlike(_TABLE_RULE), F.array(rule)).otherwise(column)

    return F.concat(F.array(_fact("model", label=label, coverage=coverage)), F.flatten(F.transform(items, rows)))


def _lines(block: Column, rule: str, label: Column) -> Column:
    """Lines of a block that follow a rule, with their place and the label of the block."""
    split = F.transform(F.split(F.regexp_extract(block, r"(?s)\{(.*)\}", 1), "\n"), lambda line, at: F.struct(F.trim(line).alias("item"), at.alias("pos"), label.alias("label")))
    return F.filter(split, lambda x: x["item"].rlike(rule))


def _prisma(b: Column) -> Column:
    def rows(x: Column) -> Column:
        item = x["item"]
        relation, type_ = item.rlike(r"@relation"), F.regexp_extract(item, r"^\w+\s+(\w+)", 1)
        field = _fact(
            "field", label=x["label"], pos=x["pos"], name=F.regexp_extract(item, r"^(\w+)", 1), type=F.regexp_extract(item, r"^\w+\s+(\S+)", 1), nullable=item.rlike(r"^\w+\s+\w+\?"),
            key=F.when(item.rlike(r"@id\b"), "primary").when(relation, "foreign"), target=type_, default_value=F.nullif(F.regexp_extract(item, r"@default\((.*?)\)(?:\s|$)", 1), F.lit("")),
        )
        side = lambda name: _columns(F.regexp_extract(item, name + r":\s*\[([^\]]*)\]", 1))
        rule = _fact("constraint", label=x["label"], pos=x["pos"], kind=F.lit("orm-relation"), columns=side("fields"), target=type_, target_columns=side("references"))
        return F.when(relation & item.rlike(r"fields:"), F.array(field, rule)).otherwise(F.array(field))

    label = F.regexp_extract(b, r"^model\s+(\w+)", 1)
    return F.concat(F.array(_fact("model", label=label, coverage=F.lit("complete"))), F.flatten(F.transform(_lines(b, r"^\w+\s+\w+", label), rows)))


def _graphql(b: Column) -> Column:
    entry = r"^(\w+)\s*(?:\([^)]*\))?\s*:\s*([\[\]\w!]+)"
    type_ = lambda x: F.regexp_extract(x["item"], entry, 2)
    row = lambda x: _fact("field", label=x["label"], pos=x["pos"], name=F.regexp_extract(x["item"], entry, 1), type=type_(x), nullable=~type_(x).endswith("!"), target=F.regexp_replace(type_(x), r"[\[\]!]", ""))
    label = F.regexp_extract(b, r"^\w+\s+(\w+)", 1)
    return F.concat(F.array(_fact("model", label=label, coverage=F.lit("complete"))), F.transform(_lines(b, entry, label), row))


def ddl_facts(files: DataFrame) -> DataFrame:
    """All rows of schema files in one pass: ``path``, ``language``, ``fact`` (model, field, constraint) and its columns.

    The target of a field of an object model is the name of its type, whether or not that is a model.
    """
    keep = [c for c in files.columns if c == "project_id"]
    text, language = F.col("text"), F.col("language")
    plain = F.when(language == "sql", F.regexp_replace(text, r"(?s)/\*.*?\*/|--[^\n]*", "")).otherwise(F.regexp_replace(text, r"(?m)//[^\n]*$|#[^\n]*$", ""))
    read = files.filter(language.isin("sql", "prisma", "graphql")).select(*keep, "path", "language", F.coalesce(plain, F.lit("")).alias("text"))
    coverage = F.when(text.rlike(r"(?i)\balter\s+table\b"), "partial").otherwise("complete")
    rows = (
        F.when(language == "sql", F.flatten(F.transform(_found(text, _TABLE), lambda t: _table(t, coverage))))
        .when(language == "prisma", F.flatten(F.transform(_found(text, r"(\bmodel\s+\w+\s*\{[^}]*\})"), _prisma)))
        .otherwise(F.flatten(F.transform(_found(text, r"(\b(?:type|input|interface)\s+\w+[^{]*\{[^}]*\})"), _graphql)))
    )
    return read.select(*keep, "path", "language", F.explode(rows).alias("r")).select(*keep, "path", "language", "r.*")


def ddl_rows(files: DataFrame) -> dict[str, DataFrame]:
    """``model`` (``path``, ``label``, ``coverage``), ``field`` and ``constraint`` rows of schema files.

    ``files``: ``path``, ``language`` (sql / prisma / graphql), ``text``.  A file with ALTER statements is only partly
    covered, since later changes are not replayed.  Fields of object models point to a model only where there is one.
    """
    keep = [c for c in files.columns if c == "project_id"]
    facts = ddl_facts(files)
    of = lambda fact: facts.filter(F.col("fact") == fact)
    models = of("model").filter("language <> 'sql'").select(*keep, "language", F.col("label").alias("target")).distinct().withColumn("_is_model", F.lit(True))
    field = of("field").join(models, [*keep, "language", "target"], "left")
    target = F.when((F.col("language") == "sql") | F.col("_is_model"), F.col("target"))
    return {
        "model": of("model").select(*keep, "path", "label", "coverage"),
        "field": field.select(*keep, "path", "label", "pos", "name", "type", "nullable", "key", target.alias("target"), "default_value"),
        "constraint": of("constraint").select(*keep, "path", "label", "pos", "kind", "columns", "target", "target_columns"),
    }
