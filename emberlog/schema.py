"""Explicit schemas of every stored table; nothing is inferred.

Booleans of three states are 0, 1 or null; times are milliseconds, or unix seconds where named ``_at`` or ``_seen``.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of each table.
TABLES: dict[str, str] = {
    "schema_migrations": (
        "version BIGINT NOT NULL, name STRING NOT NULL, applied_at DOUBLE NOT NULL"
    ),
    "collection_jobs": (
        "job_id STRING NOT NULL, started_at DOUBLE NOT NULL, finished_at DOUBLE, status STRING NOT NULL, sample_profile STRING, event_profile STRING, "
        "config_hash STRING, software_version STRING NOT NULL, normalizer_version BIGINT NOT NULL, query_version BIGINT NOT NULL, "
        "schema_version BIGINT NOT NULL, git_commit STRING, git_dirty BIGINT, reports_attempted BIGINT NOT NULL, reports_completed BIGINT NOT NULL, "
        "reports_failed BIGINT NOT NULL, notes STRING, identity_scheme_version BIGINT"
    ),
    "report_provenance": (
        "id BIGINT NOT NULL, report_code STRING NOT NULL, source_type STRING NOT NULL, seed STRING, discovered_at DOUBLE NOT NULL, rank BIGINT, "
        "page BIGINT, job_id STRING, extra STRING"
    ),
    "reports": (
        "report_code STRING NOT NULL, title_hash STRING, owner_hash STRING, start_time_ms BIGINT NOT NULL, end_time_ms BIGINT NOT NULL, zone_id BIGINT, "
        "zone_name STRING, region_id BIGINT, region_slug STRING, revision BIGINT, segments BIGINT, visibility STRING, is_archived BIGINT, "
        "is_accessible BIGINT, archive_date BIGINT, log_version BIGINT, game_version BIGINT, retrieved_at DOUBLE NOT NULL, "
        "collection_status STRING NOT NULL"
    ),
    "dungeon_runs": (
        "run_id STRING NOT NULL, report_code STRING NOT NULL, fight_id BIGINT NOT NULL, dungeon_key STRING, encounter_id BIGINT, game_zone_id BIGINT, "
        "game_zone_name STRING, log_zone_id BIGINT, rel_start_ms BIGINT NOT NULL, rel_end_ms BIGINT NOT NULL, abs_start_ms BIGINT NOT NULL, "
        "abs_end_ms BIGINT NOT NULL, duration_ms BIGINT NOT NULL, keystone_level BIGINT, keystone_affixes STRING, keystone_bonus BIGINT, "
        "keystone_time_ms BIGINT, rating DOUBLE, count_reached BIGINT, count_required BIGINT, average_item_level DOUBLE, kill BIGINT, timed BIGINT, "
        "size BIGINT, npc_count_map STRING, hotfix_epoch STRING NOT NULL, key_bracket STRING, duplicate_group_id STRING, is_canonical BIGINT, "
        "collection_status STRING NOT NULL, job_id STRING"
    ),
    "players": (
        "player_id STRING NOT NULL, first_seen DOUBLE NOT NULL, last_seen DOUBLE NOT NULL, run_count BIGINT NOT NULL"
    ),
    "run_players": (
        "run_id STRING NOT NULL, actor_id BIGINT NOT NULL, player_id STRING NOT NULL, class STRING, spec STRING, role STRING, item_level DOUBLE"
    ),
    "actors": (
        "report_code STRING NOT NULL, actor_id BIGINT NOT NULL, game_id BIGINT, name STRING, type STRING, sub_type STRING, icon STRING, "
        "pet_owner BIGINT, is_player BIGINT NOT NULL"
    ),
    "abilities": (
        "game_id BIGINT NOT NULL, name STRING, icon STRING, type STRING, first_seen DOUBLE NOT NULL, last_seen DOUBLE NOT NULL"
    ),
    "pulls": (
        "pull_id STRING NOT NULL, run_id STRING NOT NULL, log_pull_id BIGINT NOT NULL, pull_index BIGINT NOT NULL, name STRING, encounter_id BIGINT, "
        "is_boss BIGINT NOT NULL, rel_start_ms BIGINT NOT NULL, rel_end_ms BIGINT NOT NULL, run_rel_start_ms BIGINT NOT NULL, "
        "run_rel_end_ms BIGINT NOT NULL, abs_start_ms BIGINT NOT NULL, abs_end_ms BIGINT NOT NULL, duration_ms BIGINT NOT NULL, kill BIGINT, x BIGINT, "
        "y BIGINT, map_ids STRING, bounding_box STRING, composition_signature STRING, npc_species_count BIGINT, npc_total_count BIGINT, "
        "prev_pull_id STRING, next_pull_id STRING, species_signature STRING, dungeon_key STRING"
    ),
    "pull_npcs": (
        "id BIGINT NOT NULL, pull_id STRING NOT NULL, npc_game_id BIGINT NOT NULL, actor_id BIGINT, min_instance_id BIGINT, max_instance_id BIGINT, "
        "min_instance_group_id BIGINT, max_instance_group_id BIGINT, instance_count BIGINT, instance_count_confidence STRING NOT NULL"
    ),
    "event_pages": (
        "page_id BIGINT NOT NULL, run_id STRING NOT NULL, data_type STRING NOT NULL, hostility STRING, page_index BIGINT NOT NULL, "
        "requested_start_ms BIGINT NOT NULL, requested_end_ms BIGINT NOT NULL, cursor_ms BIGINT, next_cursor_ms BIGINT, event_count BIGINT NOT NULL, "
        "raw_cache_path STRING, status STRING NOT NULL, error STRING, fetched_at DOUBLE NOT NULL, source_id BIGINT, target_id BIGINT"
    ),
    "events": (
        "event_id BIGINT NOT NULL, page_id BIGINT NOT NULL, seq_in_page BIGINT NOT NULL, run_id STRING NOT NULL, report_code STRING NOT NULL, "
        "pull_id STRING, data_type STRING NOT NULL, hostility STRING, rel_ms BIGINT NOT NULL, abs_ms BIGINT NOT NULL, run_rel_ms BIGINT NOT NULL, "
        "pull_rel_ms BIGINT, type STRING NOT NULL, source_id BIGINT, source_instance BIGINT, target_id BIGINT, target_instance BIGINT, "
        "ability_game_id BIGINT, extra_ability_game_id BIGINT, amount BIGINT, absorbed BIGINT, blocked BIGINT, mitigated BIGINT, "
        "unmitigated_amount BIGINT, overkill BIGINT, hit_type BIGINT, is_tick BIGINT, is_aoe BIGINT, is_buff BIGINT, stack BIGINT, hit_points BIGINT, "
        "max_hit_points BIGINT, buffs STRING, killer_id BIGINT, killer_instance BIGINT, killing_ability_game_id BIGINT, x BIGINT, y BIGINT, "
        "map_id BIGINT, extra STRING, normalizer_version BIGINT NOT NULL"
    ),
    "ingest_diagnostics": (
        "id BIGINT NOT NULL, job_id STRING, run_id STRING, kind STRING NOT NULL, severity STRING NOT NULL, detail STRING NOT NULL, "
        "created_at DOUBLE NOT NULL"
    ),
    "run_stream_coverage": (
        "coverage_id BIGINT NOT NULL, run_id STRING NOT NULL, data_type STRING NOT NULL, hostility STRING, collection_profile STRING NOT NULL, "
        "scope STRING NOT NULL, source_id BIGINT, target_id BIGINT, requested_start_ms BIGINT NOT NULL, requested_end_ms BIGINT NOT NULL, "
        "pages BIGINT NOT NULL, events BIGINT NOT NULL, status STRING NOT NULL, error STRING, job_id STRING, query_version BIGINT NOT NULL, "
        "normalizer_version BIGINT NOT NULL, software_version STRING NOT NULL, collected_at DOUBLE NOT NULL"
    ),
    "corpus_identity": (
        "scheme_version BIGINT NOT NULL, salt_fingerprint STRING NOT NULL, first_written_at DOUBLE NOT NULL, software_version STRING NOT NULL, "
        "notes STRING"
    ),
    "analytics_migrations": (
        "version BIGINT NOT NULL, name STRING NOT NULL, applied_at DOUBLE NOT NULL"
    ),
    "analytics_source": (
        "id BIGINT NOT NULL, source_db_path STRING NOT NULL, identity_scheme_version BIGINT NOT NULL, identity_salt_fingerprint STRING NOT NULL, "
        "bound_at DOUBLE NOT NULL"
    ),
    "derivations": (
        "derivation_id STRING NOT NULL, kind STRING NOT NULL, started_at DOUBLE NOT NULL, finished_at DOUBLE, status STRING NOT NULL, "
        "corpus_fingerprint STRING NOT NULL, fingerprint_grade STRING NOT NULL, fingerprint_version BIGINT NOT NULL, run_count BIGINT NOT NULL, "
        "dedupe_policy STRING NOT NULL, provisional BIGINT NOT NULL, model_versions STRING NOT NULL, software_version STRING NOT NULL, "
        "normalizer_version BIGINT NOT NULL, query_version BIGINT NOT NULL, schema_version BIGINT NOT NULL, notes STRING"
    ),
    "derivation_runs": (
        "derivation_id STRING NOT NULL, run_id STRING NOT NULL, run_digest STRING NOT NULL"
    ),
    "derivation_exclusions": (
        "derivation_id STRING NOT NULL, run_id STRING NOT NULL, reason STRING NOT NULL, detail STRING"
    ),
}

#: Keys that identify a row; nulls in them count as equal.
KEYS: dict[str, list[str]] = {
    "reports": ["report_code"],
    "dungeon_runs": ["run_id"],
    "players": ["player_id"],
    "run_players": ["run_id", "actor_id"],
    "actors": ["report_code", "actor_id"],
    "abilities": ["game_id"],
    "pulls": ["pull_id"],
    "pull_npcs": ["pull_id", "npc_game_id", "actor_id"],
    "event_pages": ["run_id", "data_type", "hostility", "source_id", "target_id", "page_index"],
    "events": ["page_id", "seq_in_page"],
    "run_stream_coverage": ["run_id", "data_type", "hostility", "source_id", "target_id"],
    "report_provenance": ["report_code", "source_type", "seed", "job_id"],
    "derivations": ["derivation_id"],
    "derivation_runs": ["derivation_id", "run_id"],
    "derivation_exclusions": ["derivation_id", "run_id"],
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
