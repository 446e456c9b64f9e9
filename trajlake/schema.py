"""Schemas of the canonical tables. A sequence's rows carry run_id and seq_id; boxes are corners, normalised or in pixels."""

from __future__ import annotations

BOX = ("x1", "y1", "x2", "y2")

SEQUENCES = "run_id string, seq_id long, name string, frame_rate double, width int, height int, classes array<string>, original_video string"
FRAMES = "run_id string, seq_id long, frame_idx long, frame_time double, tracked boolean, image_path string"
OBJECTS = (
    "run_id string, seq_id long, frame_idx long, frame_time double, traj_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, "
    "pose_pos array<array<double>>, pose_conf array<double>, face_pos array<array<double>>, face_conf array<double>, attr array<double>, subbox array<double>, subbox_conf double"
)
EVENTS = "seq_id long, frame_idx long, type string, oid long, hid long, d double"
RESULTS = "ds_key string, grp string, test_key string, config_hash string, metric string, value double, computed_at timestamp"
