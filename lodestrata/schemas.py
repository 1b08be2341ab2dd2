"""Declared schemas of the entities that are read and written as nested JSON."""

from __future__ import annotations

GPS = "date: string, time: string, datetime: string, lat: double, lon: double, rel_alt: double, abs_alt: double, yaw: double, pitch: double, roll: double, focal_len: double, dzoom_ratio: double, distance: double, speed: double"
BOX = "struct<x: int, y: int, w: int, h: int>"
COLOR_FINDING = f"struct<color: string, zone: int, area: int, bbox: {BOX}, centroid: struct<x: int, y: int>, confidence: double, colorfulness: double, rarity: double, avg_lab: struct<a: double, b: double>>"
SHAPE_FINDING = (
    f"struct<shape: string, zone: int, area: int, bbox: {BOX}, centroid: struct<x: int, y: int>, confidence: double, length: double, angle: double, endpoints: array<int>, radius: double, "
    "edge_coverage: double, grad_mean_diff: double, grad_std_diff: double, score: double, regularity: double, right_angles: int, rect_score: double, side_ratio: double, circularity: double>"
)
DYNAMICS = f"struct<anomaly_score: double, zone_scores: map<string, double>, flagged_zones: array<int>, color_findings: array<{COLOR_FINDING}>, image_file: string>"
LLM_FINDING = "struct<type: string, zone: string, color: string, man_made: string, confidence: double, description: string, source_variant: string>"
VERDICT_FIELDS = f"objects_found: boolean, confidence: double, findings: array<{LLM_FINDING}>, terrain: string, visibility: string, zones_of_interest: array<string>, llm_time: double, llm_model: string, raw: string, error: string"
VERDICT = f"struct<{VERDICT_FIELDS}>"
MERGED_VERDICT = f"struct<{VERDICT_FIELDS}, variant_results: map<string, {VERDICT}>>"
DESCRIPTION = "struct<elements: array<struct<zone: string, type: string, color: string, size: string, description: string>>, terrain: string, visibility: string>"
CONTEXT = "context string, natural_list string, priority_signals string, target_objects string, platform_notes string, color_shift_notes string, name string"
SCENE = (
    f"struct<scene_id: int, best_frame: bigint, best_score: double, best_reasons: array<string>, timestamp: double, time_str: string, n_frames_in_scene: int, frame_range: array<bigint>, merged_from: array<int>, "
    f"gps: struct<{GPS}>, image_file: string, image_file_v1: string, image_file_v2: string, image_file_v3: string, image_file_v4: string, dynamics: {DYNAMICS}, llm_fast: {MERGED_VERDICT}, llm_deep: {MERGED_VERDICT}>"
)
REPORT = (
    "video string, recording_time string, analysis_date string, analysis_time double, video_info struct<width: int, height: int, fps: double, total_frames: bigint, duration_sec: double>, "
    "analysis_params map<string, string>, total_frames_scanned bigint, total_frames_passed bigint, scenes_found int, positives int, confirmed int, findings_total int, mission_context struct<"
    + ", ".join(f"{x.split()[0]}: string" for x in CONTEXT.split(", "))
    + f">, scenes array<{SCENE}>"
)
TELEMETRY = "frame_num bigint, " + GPS.replace(":", "")
