"""Secret masking, with built-in expressions only.

The same-length mask depends on the length of each match, which a replacement cannot express: a text is cut into matches
and what lies between them, and put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# Key names and URL forms that count as secret.
SECRET_KEY = r"(?:B2_[A-Z0-9_]+|(?:API|AUTH|ACCESS|SECRET|PRIVATE|PASSWORD|TOKEN|CREDENTIAL)[A-Z0-9_]*)"
URL_SCHEMES = r"(?:https?|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|mssql)"
SECRET_PARAMETER = (
    r"(?:token|password|passwd|secret|credential|api.?key|access.?key|auth|signature|^sig$|cookie|session|policy)"
)
MASK = "•"

# Where a value begins: behind a key, quoted or not, and its sign.  White space is that of Unicode.
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_HEAD = r"(?iu)([\"']?)" + SECRET_KEY + r"\1" + _BLANK + r"*+[:=]" + _BLANK + r"*+"
# A quoted value ends at its quote or with the text; another before a comma, a brace or a line end.
_CLOSED = r"^(?:\"(?:\\[\s\S]|[^\"\\])*+\"|'(?:\\[\s\S]|[^'\\])*+'|(?![\"'])[^,}\r\n]*+(?=[,}\r\n]))"
_VALUE = r"^(?:\"(?:\\[\s\S]|[^\"\\])*+(?:\"|\\?\z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\z)|[^,}\r\n]*+)"
_URL = r"(?iu)" + URL_SCHEMES + r"://[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\"'<>`]++"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hide(value: Column) -> Column:
    """As many marks as code points, line ends kept."""
    return F.regexp_replace(value, r"[^\r\n]", MASK)


def _value_length(piece: Column, rest: Column) -> Column:
    """Length of the value at the start of ``piece``; ``rest`` is only looked at where it does not end there."""
    closed = F.regexp_extract(piece, _CLOSED, 0)
    whole = F.when(piece.rlike(_CLOSED), closed).otherwise(F.regexp_extract(rest, _VALUE, 0))
    return F.length(F.when(whole.rlike("^[\"']"), whole).otherwise(F.regexp_replace(whole, _BLANK + r"+\z", "")))


def _mask_assignments(text: Column) -> Column:
    """Text with hidden values.  It is cut into heads and what follows them; a value covers the beginnings of one or more pieces,
    also of heads inside it, and what is left to cover is carried from piece to piece."""
    # Piece by piece: the text up to the first head, then a head and what follows it.
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(_HEAD), F.lit(0)))
    paired = F.zip_with(heads, F.split(text, _HEAD, -1), lambda head, piece: F.struct(head.alias("head"), piece.alias("piece")))
    parts = F.transform(paired, lambda part, i: F.struct(part["head"].alias("head"), part["piece"].alias("piece"), i.alias("i")))
    kind = "struct<left:int,at:int,covers:array<struct<head:int,piece:int>>>"
    start = F.struct(F.lit(0).alias("left"), F.lit(1).alias("at"), F.array().cast("array<struct<head:int,piece:int>>").alias("covers")).cast(kind)

    def step(state: Column, part: Column) -> Column:
        head, piece = F.length(part["head"]), F.length(part["piece"])
        behind = state["at"] + head
        value = F.when(part["i"] > 0, _value_length(part["piece"], F.substring(text, behind, F.length(text)))).otherwise(0)
        left = F.greatest(F.greatest(state["left"] - head, F.lit(0)), value)
        cover = F.struct(F.least(state["left"], head).cast("int").alias("head"), F.least(left, piece).cast("int").alias("piece"))
        return F.struct(F.greatest(left - piece, F.lit(0)).cast("int").alias("left"), (behind + piece).cast("int").alias("at"), F.concat(state["covers"], F.array(cover)).alias("covers")).cast(kind)

    shown = lambda value, n: F.concat(_hide(F.substring(value, F.lit(1), n)), F.substring(value, n + 1, F.length(value)))
    covers = lambda listed: F.aggregate(listed, start, step, lambda state: state["covers"])
    masked = lambda listed: F.zip_with(listed, covers(listed), lambda part, cover: F.concat(shown(part["head"], cover["head"]), shown(part["piece"], cover["piece"])))
    return F.when(text.rlike(_HEAD), _let(parts, lambda listed: F.array_join(masked(listed), ""))).otherwise(text)


def _mask_address(url: Column) -> Column:
    """Hide user info (all before the last @ of the authority) and the values of parameters with a secret name."""
    address, asked, behind = F.regexp_extract(url, r"^([^?]*)", 1), F.contains(url, F.lit("?")), F.regexp_extract(url, r"(?s)^[^?]*\?(.*)$", 1)
    authority = F.regexp_extract(address, r"^[^:]*://([^/]*)", 1)
    user = F.regexp_extract(authority, r"(?s)^(.*)@", 1)
    plain = F.concat(F.regexp_extract(address, r"^([^:]*://)", 1), _hide(user), F.substring(authority, F.length(user) + 1, F.length(authority)), F.regexp_extract(address, r"(?s)^[^:]*://[^/]*(.*)$", 1))

    def field(item: Column) -> Column:
        name = F.substring_index(item, "=", 1)
        secret = F.coalesce(F.try_url_decode(name), name).rlike("(?iu)" + SECRET_PARAMETER) & F.contains(item, F.lit("="))
        return F.when(secret, F.concat(name, F.lit("="), _hide(F.substring(item, F.length(name) + 2, F.length(item))))).otherwise(item)

    query = F.array_join(F.transform(F.split(F.substring_index(behind, "#", 1), "&", -1), field), "&")
    return F.concat(plain, F.when(asked, F.concat(F.lit("?"), query, F.regexp_extract(behind, r"(?s)(#.*)$", 1))).otherwise(""))


def mask_url_source(text: Column | str) -> Column:
    """Addresses in a text with hidden user info and secret parameters; length and positions stay the same."""
    text = _c(text)
    masked = F.transform(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), _mask_address)
    # One address behind each piece but the last.
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, _URL, -1), masked, lambda piece, url: F.array(piece, F.coalesce(url, F.lit(""))))), "")
    return F.when(text.rlike(_URL), joined).otherwise(text)


def mask_source(text: Column | str) -> Column:
    """Mask secret values in a text; length, lines and quotes' offsets stay the same."""
    return _let(_c(text), lambda given: _let(_mask_assignments(given), mask_url_source))


def public_url(url: Column | str) -> Column:
    """Identity form of a URL: no user info, secret query values replaced by ``[redacted]``."""
    plain = F.regexp_replace(_c(url), r"(?i)(" + URL_SCHEMES + r"://)[^/?#]*@", "$1")

    def shown(field: Column) -> Column:
        name = F.substring_index(field, "=", 1)
        secret = F.coalesce(F.try_url_decode(name), name).rlike("(?i)" + SECRET_PARAMETER) & F.contains(field, F.lit("="))
        return F.when(secret, F.concat(name, F.lit("=[redacted]"))).otherwise(field)

    query = F.regexp_extract(plain, r"(?s)^[^?#]*\?([^#]*)", 1)
    fields = F.array_join(F.transform(F.split(query, "&"), shown), "&")
    redacted = F.concat(F.regexp_extract(plain, r"(?s)^([^?#]*\?)", 1), fields, F.regexp_extract(plain, r"(?s)(#.*)$", 1))
    return F.when(plain.rlike(r"^[^?#]*\?"), redacted).otherwise(plain)
