"""Declared schemas of the eight driving-log tables.

Every table starts with the frame key ``(run_id, shard_id, frame_id)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KEY = "run_id string, shard_id int, frame_id bigint, "

_TABLES = {
    "frames": (
        "sim_time double, fixed_dt float, future_dt float, map string, weather smallint, seed bigint, "
        "ego_x_w float, ego_y_w float, ego_yaw_w float, speed_mps float, yaw_rate float, road_option tinyint, "
        "goal_dist_m float, at_junction tinyint, dist_to_next_junction float, accel_long float, accel_lat float, "
        "steer_angle_rad float, steer_norm float, throttle float, brake float, curvature float, gear smallint, "
        "speed_limit_mps float, command tinyint, time_of_day_sin float, time_of_day_cos float, "
        "route_progress_m float, route_id int, scenario_id int, frame_ref string"
    ),
    "route_points": "idx smallint, x_ego float, y_ego float, dx float, dy float, curvature float, s_frac float",
    "actors": (
        "actor_id bigint, type_id tinyint, x_ego float, y_ego float, yaw float, vx float, vy float, "
        "length float, width float"
    ),
    "traffic_lights": "tl_id bigint, state tinyint, stop_x_ego float, stop_y_ego float",
    "map_segments": (
        "seg_id bigint, kind tinyint, coords_x array<float>, coords_y array<float>, lane_id bigint, "
        "lane_type tinyint, speed_limit float"
    ),
    "futures": "i tinyint, x_ego float, y_ego float, v_mps float",
    "object_tokens": (
        "idx smallint, actor_id bigint, type_id tinyint, x_ego float, y_ego float, sin_yaw float, cos_yaw float, "
        "length float, width float, vx float, vy float, oncoming_flag tinyint, priority_flag tinyint"
    ),
    "bev_frames": (
        "C smallint, H smallint, W smallint, dtype string, encoding string, channel_spec string, "
        "meters_per_px float, x_fwd_m float, y_left_m float, ego_x_w float, ego_y_w float, ego_yaw_w float, "
        "spec_version smallint, norms_version smallint, frame_ref string, data binary"
    ),
}

TABLE_NAMES = tuple(_TABLES)


def table_schema(name: str) -> T.StructType:
    """Schema of one of the eight tables."""
    if name not in _TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLE_NAMES)}")
    return T.StructType.fromDDL(_KEY + _TABLES[name])
