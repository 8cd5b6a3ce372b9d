"""Schemas of the tables that the engine reads and writes."""

CUES = "track_id STRING, cue_id INT, start_ms BIGINT, end_ms BIGINT, source_text STRING, target_text STRING, speaker STRING"
GOLD = "id INT, category STRING, source STRING, context STRING, intended_meaning STRING, gold_sorani STRING, acceptable_alternatives ARRAY<STRING>, unacceptable_literal_examples ARRAY<STRING>, notes STRING"
ISSUE = "STRUCT<rule: STRING, category: STRING, severity: STRING, points: INT>"
CORRECTIONS = "id BIGINT, cue_id BIGINT, source_text STRING, original_translation STRING, corrected_translation STRING, correction_type STRING, reviewer STRING, project_id STRING, scene_id STRING, ts TIMESTAMP"
MEMORY = "tm_id BIGINT, source_text STRING, target_text STRING, context_notes STRING, version BIGINT"
