"""De-identification of nested JSON, where keys say what a value is.

The shape is open, so this is the one place where columns go through Python, in
Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from emberlog.functions.text import PLACEHOLDER

#: Keys whose text names a person, a group or a realm.
NAMING_KEYS = {"title", "guild", "guildName", "server", "serverName", "serverSlug", "realm", "realmName"}
#: Keys whose value is a secret, whatever it is.
SECRET_KEYS = {"access_token", "refresh_token", "client_secret", "authorization", "password", "token", "secret"}
#: Actor types that stand for people, and the prefix of their pseudonyms.
PERSONS = {"Player": "player", "Pet": "pet", "PlayerPet": "pet"}


def _digest(value: str, salt: str, size: int) -> str:
    return hashlib.sha256(f"{salt}:{value.strip().lower()}".encode()).hexdigest()[:size]


def sanitize(value, salt: str, under: str = ""):
    """A copy of a JSON value: people get pseudonyms, naming text is hashed, anything else stays."""
    if isinstance(value, list):
        return [sanitize(v, salt, under) for v in value]
    if not isinstance(value, dict):
        return value
    person = "uploader" if under == "owner" else PERSONS.get(value.get("type")) if under == "actors" else None
    out = {}
    for key, item in value.items():
        if isinstance(item, str) and item and key in NAMING_KEYS:
            out[key] = f"redacted-{_digest(item, salt, 8)}"
        elif isinstance(item, str) and item and key == "name" and person:
            out[key] = f"{person}-{_digest(item, salt, 12)}"
        else:
            out[key] = sanitize(item, salt, key)
    return out


def redact_keys(value):
    """A copy of a JSON value without the values of secret-bearing keys."""
    if isinstance(value, list):
        return [redact_keys(v) for v in value]
    if isinstance(value, dict):
        return {k: PLACEHOLDER if k.lower() in SECRET_KEYS and v not in (None, "") else redact_keys(v) for k, v in value.items()}
    return value


def _over_json(change) -> object:
    @arrow_udf("string")
    def apply(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            try:
                out.append(None if t is None else json.dumps(change(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(None)  # what can't be read isn't passed on
        return pa.array(out, pa.string())

    return apply


def sanitize_json(column: Column, salt: str) -> Column:
    return _over_json(lambda v: sanitize(v, salt))(column)


def redact_json(column: Column) -> Column:
    return _over_json(redact_keys)(column)


def blamed(message: str, fields: list[str]) -> set[str]:
    """Fields that an error message complains of: spelled in any way, short ones only as
    words; a field whose name lies inside another blamed one's is not meant."""
    flat = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    hit = {f for f in fields if (re.search(rf"\b{re.escape(f)}\b", message, re.I) if len(f) < 4 else flat(f) in flat(message))}
    return {f for f in hit if not any(f != g and flat(f) in flat(g) for g in hit)}
