"""Message tokens with their variable parts replaced by a wildcard, and the template measures on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"

_HEX = "[0-9a-fA-F]"
_UUID = rf"(?:{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}|{_HEX}{{32}})"
UUID = rf"\A[{{}}]*(?:(?:urn:uuid:)?{_UUID})[{{}}]*\z"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _v6() -> str:
    h = "[0-9A-Fa-f]{1,4}"
    run = lambda n: f"{h}(?::{h}){{0,{n - 1}}}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{_V4}", f"::(?:{run(7)})?", f"(?:{run(7)})?::", f"::(?:{h}:){{0,5}}{_V4}"]
    forms += [f"{run(a)}::(?:{run(7 - a)})?" for a in range(1, 7)]
    forms += [f"{run(a)}::(?:{h}:){{0,{5 - a}}}{_V4}" for a in range(1, 6)]
    return "(?:" + "|".join(forms) + ")"


_IP = f"(?:{_V4}|{_v6()})"
#: An address, bare or in brackets, or either with a port.
IP = rf"\A(?:{_IP}|\[{_IP}\]|(?:{_IP}|\[{_IP}\]):[0-9]+)\z"
# The shapes that become wildcards.
STAMP = r"\A(?:\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?|\d{2}:\d{2}:\d{2}(?:\.\d+)?)\z"
DURATION = r"\A\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|s|m|h|d)\z"
OBJECT = rf"(?s)\A(.+)@{_HEX}{{4,}}\z"
QUERY = r"([?&][^=&#\s]+=)([^&#\s]*)"
LONG = rf"\A(?:{_HEX}{{8,}}|[0-9]{{4,}})\z"


#: What a token needs to fall under any rule, and to be an address; most tokens fail the first test.
_ANY = rf"[0-9:@=]|\A{_HEX}{{8,}}\z"
_ADDRESS = r"\A[\[\]0-9A-Fa-f:.]{2,}\z"


def normalize_token(token: Column) -> Column:
    """The first rule that applies: known shapes, object identities, query values, long hex or integers."""
    unicode = lambda p: "(?U)" + p
    known = token.rlike(UUID) | (token.rlike(_ADDRESS) & token.rlike(IP)) | token.rlike(unicode(STAMP)) | token.rlike(unicode(DURATION))
    in_query = F.contains(token, F.lit("=")) & (F.contains(token, F.lit("?")) | F.contains(token, F.lit("&"))) & token.rlike(unicode(QUERY))
    out = F.when(~token.rlike(_ANY), token).when(known, WILDCARD).when(token.rlike(OBJECT), F.regexp_replace(token, OBJECT, rf"$1@{WILDCARD}"))
    return out.when(in_query, F.regexp_replace(token, unicode(QUERY), rf"$1{WILDCARD}")).when(token.rlike(LONG), WILDCARD).otherwise(token)


def normalize(message: Column) -> Column:
    """The normalised tokens of a message, split at Unicode blanks."""
    return F.transform(F.filter(F.split(message, r"(?U)\s+"), lambda t: t != ""), normalize_token)


def similarity(template: Column, tokens: Column) -> Column:
    """Share of the template's fixed positions that the tokens match; one if it has none.  Not symmetric."""
    fixed = F.filter(F.arrays_zip(template.alias("a"), tokens.alias("b")), lambda p: p["a"] != WILDCARD)
    same = F.filter(fixed, lambda p: p["a"] == p["b"])
    return F.when(F.size(fixed) == 0, 1.0).otherwise(F.size(same) / F.size(fixed))


def generalize(template: Column, tokens: Column) -> Column:
    """The template with a wildcard wherever the tokens differ."""
    return F.zip_with(template, tokens, lambda a, b: F.when(a == b, a).otherwise(WILDCARD))
