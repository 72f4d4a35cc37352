"""Public tables and their types. ``group`` is a reserved word and needs back quotes in SQL."""

from __future__ import annotations

RECORDINGS = (
    "source_file string, source_path string, `group` string, subject string, hand string, n_samples long, duration_s double, n_bursts long, n_clips long, "
    "n_burst_only long, n_clip_only long, emg_pose_lag_s double, emg_pose_corr double, lag_flag string, pose_nan_frac double, emg_nan_frac double, "
    "enter_thresh double, exit_thresh double, pose_thresh double, pose_exit_thresh double, rec_pose_range double, pose_static long, seg_version string"
)
BURSTS = (
    "source_file string, `group` string, burst_idx long, start_sample long, end_sample long, hold_end_sample long, apex_sample long, duration_s double, "
    "emg_rms double, envelope_peak double, pose_range double, matched_clip_id long"
)
CLIPS = (
    "source_file string, `group` string, subject string, hand string, clip_id long, start_sample long, end_sample long, motion_start_sample long, "
    "motion_end_sample long, hold_start_sample long, hold_end_sample long, apex_sample long, duration_s double, motion_duration_s double, hold_duration_s double, "
    "emg_rms double, envelope_peak double, mean_pose_speed double, max_pose_speed double, pose_range double, fusion_type string, review_flag string, "
    "matched_burst_idx long, seg_version string"
)
ANNOTATIONS = (
    "source_file string, clip_id long, scope string, kind string, value string, clip_start_sample long, clip_end_sample long, seg_version string, "
    "labeler string, labeled_at string, note string"
)
CLUSTER_RUNS = "run_id string, created_at string, channel string, params_json string"
CLUSTER_ASSIGNMENTS = "run_id string, source_file string, clip_id long, cluster_id long"
TOMBSTONES = "source_file string, dropped_at string, note string"
TABLES = {
    "recordings": RECORDINGS, "bursts": BURSTS, "clips": CLIPS, "annotations": ANNOTATIONS, "cluster_runs": CLUSTER_RUNS,
    "cluster_assignments": CLUSTER_ASSIGNMENTS, "tombstones": TOMBSTONES,
}
#: Columns by which tables are partitioned when they are saved: lookups by them read one folder.
PARTITIONS = {"cluster_runs": ["run_id"], "cluster_assignments": ["run_id"]}


def create_tables(spark, database: str = "default") -> None:
    """Empty managed tables for those that are missing."""
    for name, columns in TABLES.items():
        by = f" PARTITIONED BY ({', '.join(PARTITIONS[name])})" if name in PARTITIONS else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{by}")
