"""Static module references in JavaScript/TypeScript text (best effort, lexical)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# Comments and literals are recognised first so that references inside them do not count; a reference keeps
# its own quoted specifier because its alternative is tried before the plain literal.
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
# Unrolled quantifiers: regex recursion must not grow with the length of a literal.
_LITERAL = r"\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_QUOTED = r"(?:\"[^\"\n]*\"|'[^'\n]*')"
_GAP = r"\s*+(?:/\*[\s\S]*?\*/\s*+)*+"
_REFERENCE = (
    r"(?<![\w$.])(?:"
    r"import" + _GAP + r"\(" + _GAP + r"(?:" + _QUOTED + _GAP + r"[,)]|[^)\"'][^)]*\))"
    r"|import\b" + _GAP + r"(?:[\w$*{][^;\"'()]*?\bfrom" + _GAP + r")?" + _QUOTED
    + r"|export\b" + _GAP + r"(?:type\b" + _GAP + r")?(?:\*|\{)[^;\"'()]*?\bfrom" + _GAP + _QUOTED
    + r"|require" + _GAP + r"\(" + _GAP + r"(?:" + _QUOTED + _GAP + r"\)|[^)\"'][^)]*\))"
    r")"
)
_ANY = "(" + _COMMENT + "|" + _REFERENCE + "|" + _LITERAL + ")"


def module_references(text: Column | str) -> Column:
    """Array of ``struct(kind, specifier, computed)`` in source order.

    Kinds: import, import-type, re-export, dynamic-import, require.  A call with a computed argument has a
    null specifier and ``computed`` set.
    """
    tokens = F.regexp_extract_all(_c(text), F.lit(_ANY), F.lit(1))
    references = F.filter(tokens, lambda token: token.rlike(r"^(?:import|export|require)\b"))

    def describe(token: Column) -> Column:
        specifier = F.regexp_extract(token, r"[\"']([^\"'\n]*)[\"']", 1)
        computed = ~token.rlike(r"[\"']")
        kind = (
            F.when(token.startswith("require"), F.lit("require"))
            .when(token.startswith("export"), F.lit("re-export"))
            .when(token.rlike(r"^import\s*(?:/\*[\s\S]*?\*/\s*)*\("), F.lit("dynamic-import"))
            .when(token.rlike(r"^import\s+type\b(?!\s+from\s*[\"'])"), F.lit("import-type"))
            .otherwise(F.lit("import"))
        )
        return F.struct(kind.alias("kind"), F.when(~computed, specifier).alias("specifier"), computed.alias("computed"))

    return F.transform(references, describe)
