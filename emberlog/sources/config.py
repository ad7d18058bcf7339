"""Configuration files as small, checked tables."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from emberlog.functions.text import check_epochs


def load(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def config_hash(paths: list[str]) -> str:
    h = hashlib.sha256()
    for p in sorted(paths):
        h.update(Path(p).name.encode())
        h.update(Path(p).read_bytes())
    return h.hexdigest()[:16]


def brackets(config: dict) -> list[tuple[str, int, int | None]]:
    return [(b["key"], int(b["min"]), None if b.get("max") is None else int(b["max"])) for b in config.get("key_brackets", [])]


def instant_ms(value: str | None) -> int | None:
    """An ISO instant in milliseconds; without a zone it is UTC."""
    if value is None:
        return None
    at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def epochs(config: dict) -> list[tuple[str, int | None, int | None]]:
    """Named epochs; the one without bounds is the default and not listed."""
    found = [(e["name"], instant_ms(e.get("start")), instant_ms(e.get("end"))) for e in config.get("epochs", [])]
    found = [e for e in found if e[1] is not None or e[2] is not None]
    check_epochs(found)
    return found


def dungeons(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(i, d["key"], d.get("display_name", d["key"]), d.get("aliases") or [], [int(x) for x in d.get("encounter_ids") or []], d.get("zone_id")) for i, d in enumerate(config.get("dungeons", []))]
    return spark.createDataFrame(rows, "position int, key string, display_name string, aliases array<string>, encounter_ids array<long>, zone_id long")


def profiles(spark: SparkSession, config: dict, known_types: set[str] | None = None) -> DataFrame:
    """Event profiles; types that ``known_types`` lacks are refused."""
    rows = [(n, p.get("event_types") or [], bool(p.get("include_combatant_info"))) for n, p in (config.get("event_profiles") or {}).items()]
    if known_types is not None:
        unknown = sorted({t.split("@")[0].strip() for _, types, _ in rows for t in types} - known_types)
        if unknown:
            raise ValueError(f"unknown event types: {', '.join(unknown)}")
    return spark.createDataFrame(rows, "profile string, event_types array<string>, include_combatant_info boolean")


def sample_profile(config: dict, name: str) -> dict:
    """A sample profile; what it refers to has to exist."""
    found = (config.get("sample_profiles") or {}).get(name)
    if found is None:
        raise KeyError(f"no sample profile {name}")
    known = {b[0] for b in brackets(config)}
    missing = [b for b in found.get("key_brackets") or [] if b not in known]
    if missing or found.get("event_profile") not in (None, *(config.get("event_profiles") or {})):
        raise ValueError(f"sample profile {name} refers to what isn't there: {', '.join(missing) or found.get('event_profile')}")
    return found


def overlay_yaml(matched: DataFrame) -> str:
    """An overlay with the identities (encounter_id) of matched dungeons, as YAML; only their keys and ids."""
    import yaml

    rows = matched.where("state = 'matched'").orderBy("key").collect()  # one per configured dungeon
    return yaml.safe_dump({"dungeons": [{"key": r["key"], "encounter_ids": [r["encounter_id"]]} for r in rows]}, sort_keys=False)
