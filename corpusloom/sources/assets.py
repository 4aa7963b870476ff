"""Asset references in markup, styles and imports, and the packages they name on public delivery hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import public_url

# Delivery hosts, and where the package starts in their paths.
DELIVERY_HOSTS = {"cdn.jsdelivr.net": ("jsdelivr", "/npm/"), "unpkg.com": ("unpkg", "/")}
_SOURCE_TAG = r"(?is)<(?:script|img|source|iframe)\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"']"
_LINK_TAG = r"(?is)<link\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"
_STYLE = r"(?i)(?:@import\s+(?:url\(\s*)?|\burl\(\s*)[\"']?([^\"')\s]+)"
_ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def references(text: Column | str, anchors: bool = False) -> Column:
    """Referenced addresses in a text, in no particular order; anchors only on request."""
    rules = [_SOURCE_TAG, _LINK_TAG, _STYLE] + ([_ANCHOR] if anchors else [])
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rule), F.lit(1)) for rule in rules]))


def anchors(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(_ANCHOR), F.lit(1))


def asset_refs(pages: DataFrame, text: str = "text", hosts: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per reference to an allowed host: ``stack_id``, public ``href`` and ``package_name``.

    Hosts must match exactly; addresses with user info are left out.
    """
    hosts = hosts or DELIVERY_HOSTS
    rest = [c for c in pages.columns if c != text]
    found = pages.select(*rest, F.explode(references(text)).alias("_raw"))
    url = F.when(F.col("_raw").startswith("//"), F.concat(F.lit("https:"), "_raw")).otherwise(F.col("_raw"))
    found = found.withColumn("_url", url).filter(F.col("_url").rlike(r"(?i)^https?://[^/@]*(?:[/?#]|$)"))
    host, path = F.lower(F.regexp_extract("_url", r"^[^:]+://([^/:?#]+)", 1)), F.regexp_extract("_url", r"^[^:]+://[^/?#]+([^?#]*)", 1)
    stack, base = None, None
    for name, (stack_id, prefix) in hosts.items():
        stack = F.when(host == name, stack_id) if stack is None else stack.when(host == name, stack_id)
        inside = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1)))
        base = F.when(host == name, inside) if base is None else base.when(host == name, inside)
    package = F.nullif(F.regexp_extract(base, r"^((?:@[^/@]+/)?[^/@]+)(?:@[^/]+)?(?:/|$)", 1), F.lit(""))
    return found.withColumn("stack_id", stack).filter(F.col("stack_id").isNotNull()).select(*rest, "stack_id", public_url("_url").alias("href"), package.alias("package_name"))
