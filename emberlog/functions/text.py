"""Scalar functions: identity, redaction, parsing and classification, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED]"
#: How pseudonyms and report codes look.
PSEUDONYM = "^(?:player|pet|uploader)-[0-9a-f]{8,64}$"
REPORT_CODE = "^[A-Za-z0-9]{8,32}$"
REPORT_URL = "/reports/([A-Za-z0-9]{8,32})"
#: What carries a secret, and what it becomes.
REDACTIONS = [
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", f"Bearer {PLACEHOLDER}"),
    (r"(?i)([\"']?authorization[\"']?\s*[:=]\s*)([\"'])[^\"']{8,}([\"'])", f"$1$2{PLACEHOLDER}$3"),
    (r"(?i)([\"']?(?:access_token|refresh_token|client_secret)[\"']?\s*[:=]\s*)([\"'])[^\"']{4,}([\"'])", f"$1$2{PLACEHOLDER}$3"),
    (r"(?i)\b(access_token|refresh_token|client_secret)=[^&\s\"']{4,}", f"$1={PLACEHOLDER}"),
]


def identity_hash(value: Column, salt: str) -> Column:
    """Twelve hex digits of SHA-256 over the salt and the trimmed, lower-cased value."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.lower(F.trim(value))), 256), 1, 12)


def salt_fingerprint(salt: str) -> str:
    return hashlib.sha256(salt.encode()).hexdigest()[:12]


def is_pseudonym(value: Column) -> Column:
    return F.trim(value).rlike(PSEUDONYM)


def pseudonym(prefix: str, value: Column, salt: str) -> Column:
    return F.when(is_pseudonym(value), F.lower(F.trim(value))).otherwise(F.concat(F.lit(f"{prefix}-"), identity_hash(value, salt)))


def focus_candidates(name: Column, salt: str) -> Column:
    """Pseudonyms that a name may stand for: itself, or the whole name and the part before a realm."""
    own = F.trim(name)
    short = F.trim(F.substring_index(own, "-", 1))
    made = F.array_distinct(F.array(*[F.concat(F.lit("player-"), identity_hash(v, salt)) for v in (own, short)]))
    return F.when(name.isNull() | (own == ""), F.array().cast("array<string>")).when(is_pseudonym(name), F.array(F.lower(own))).otherwise(made)


def redact(text: Column, secrets: list[str] | None = None) -> Column:
    """Known secrets (of 4 characters or more, longest first), then the patterns."""
    for s in sorted({s for s in secrets or [] if len(s) >= 4}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(s), F.lit(PLACEHOLDER))
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def report_code(value: Column) -> Column:
    """The code in a report's URL, or a bare code without ``#...``, ``?...``, spaces and slashes; else null."""
    found = F.nullif(F.regexp_extract(value, REPORT_URL, 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(value, "[#?].*$", ""), "^[\\s/]+|[\\s/]+$", "")
    return F.coalesce(found, F.when(bare.rlike(REPORT_CODE), bare))


def safe_segment(value: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(value, "[^A-Za-z0-9_-]", "_"), 1, most)


def class_and_spec(icon: Column, sub_type: Column) -> tuple[Column, Column]:
    """The icon before its first dash, and the sub-type; empty is null."""
    return F.nullif(F.substring_index(icon, "-", 1), F.lit("")), F.nullif(sub_type, F.lit(""))


def words(value: Column) -> Column:
    """A camel-case name as lower-case words."""
    return F.lower(F.regexp_replace(value, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def compact_name(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def as_int(value: Column) -> Column:
    """Text as a whole number, null for whatever isn't one."""
    return value.try_cast("long")


def aura_ids(value: Column) -> Column:
    """A dot list of ids, with or without a last dot, as an array."""
    return F.transform(F.filter(F.split(value, "[.]"), lambda x: x != ""), lambda x: x.try_cast("long"))


def seconds(value: Column) -> Column:
    """A unix time that may be in milliseconds, in seconds."""
    return F.when(value > 1e11, value / 1000).otherwise(value)


_ISO = "^([0-9]{4})(-?)([0-9]{2})\\2([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\\.([0-9]{1,9}))?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def iso_millis(text: Column) -> Column:
    """An ISO-8601 date or instant in milliseconds; without a zone it is UTC. Digits behind the
    milliseconds are cut off. Null for other text and for days and times that don't exist."""
    part = lambda i: F.nullif(F.regexp_extract(text, _ISO, i), F.lit(""))
    number = lambda i: F.coalesce(part(i).cast("long"), F.lit(0))
    day = F.concat_ws("-", part(1), part(3), part(4)).try_cast("date")
    zone = F.regexp_replace(F.coalesce(part(9), F.lit("Z")), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    away = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 4, 2).try_cast("long")))
    milli = F.rpad(F.substring(F.coalesce(part(8), F.lit("0")), 1, 3), 3, "0").cast("long")
    real = (number(5) < 24) & (number(6) < 60) & (number(7) < 60) & (F.abs(away) < 24 * 60)
    return F.when(text.rlike(_ISO) & real, (F.unix_date(day).cast("long") * 86_400 + number(5) * 3600 + (number(6) - away) * 60 + number(7)) * 1000 + milli)


def canonical_json(map_column: Column) -> Column:
    """A map of text as JSON with sorted keys; an empty one is null."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(map_column)))
    return F.when(F.size(map_column) > 0, F.to_json(ordered))


def bracket(level: Column, brackets: list[tuple[str, int, int | None]]) -> Column:
    """The first bracket that holds the level; null for none and for null."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(brackets):
        inside = level >= low if high is None else level.between(low, high)
        out = F.when(inside, name).otherwise(out)
    return out


#: The brackets of key levels.
BRACKETS = [("2-6", 2, 6), ("7-8", 7, 8), ("9", 9, 9), ("10", 10, 10), ("11-12", 11, 12), ("13-14", 13, 14), ("15+", 15, None)]


def check_epochs(epochs: list[tuple[str, int | None, int | None]]) -> None:
    """Epochs are half-open and must not overlap; null is no bound."""
    spans = sorted((lo if lo is not None else -(1 << 62), hi if hi is not None else 1 << 62, n) for n, lo, hi in epochs)
    for (_, end, a), (start, _, b) in zip(spans, spans[1:]):
        if start < end:
            raise ValueError(f"epochs {a} and {b} overlap")


def epoch(at_ms: Column, epochs: list[tuple[str, int | None, int | None]]) -> Column:
    check_epochs(epochs)
    out = F.lit("unclassified")
    for name, low, high in reversed(epochs):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (at_ms >= low)
        if high is not None:
            inside = inside & (at_ms < high)
        out = F.when(inside, name).otherwise(out)
    return out


#: Specialisations that tank or heal; every other one deals damage.
ROLES = {
    "tank": ["Protection", "Blood", "Brewmaster", "Guardian", "Vengeance"],
    "healer": ["Holy", "Discipline", "Restoration", "Mistweaver", "Preservation"],
}


def role(class_name: Column, spec: Column, roles: dict[str, list[str]] = ROLES) -> Column:
    """``Class-Spec`` first, then the bare spec, else dps; a null spec has no role."""
    full = F.concat_ws("-", class_name, spec)
    out = F.lit("dps")
    for value in (spec, full):
        for name in sorted(roles):
            out = F.when(value.isin(roles[name]), name).otherwise(out)
    return F.when(spec.isNotNull(), out)


def diagnostics_by_kind(df: DataFrame) -> DataFrame:
    return df.groupBy("kind", "severity").agg(F.count("*").alias("n"))
