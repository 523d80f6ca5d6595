"""Schemas, as DDL, of the tables that flow through the engine."""

from __future__ import annotations

#: Format constants of the stock classifiers.
SAMPLE_RATE, CHUNK_S, BAND_LOW, BAND_HIGH = 48_000, 3.0, 0, 15_000

AUDIO_FILE = "path string, sample_rate int, n_frames bigint, duration_s double, channels int, error string"
CHUNK_GRID = "path string, chunk_idx bigint, start_s double, end_s double, start_frame bigint, end_frame bigint"
CHUNK = "path string, chunk_idx bigint, start_s double, end_s double, samples array<float>, error string"
SCORES = "path string, chunk_idx bigint, start_s double, end_s double, logits array<float>, error string"
PREDICTION = "species string, confidence float, label_idx int"
PREDICTIONS = "path string, chunk_idx bigint, start_s double, end_s double, predictions array<struct<species:string,confidence:float,label_idx:int>>"
LABELS = "label_idx int, species string"
GEO_IN = "req_id bigint, latitude double, longitude double, week int"
