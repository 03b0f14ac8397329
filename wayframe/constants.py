"""Fixed values of the driving-log data model.

They are part of the format (readers of the data depend on them), so they are
stated here once, as plain text.
"""

# --- fixed values: sizes and clocks ---
ROUTE_POINTS = 32
FUTURE_STEPS = 12
MAX_OBJECTS = 64
OBJECT_WIDTH = 11
EGO_WIDTH = 14
RASTER_CHANNELS = 18
TICK_US = 100_000
FUTURE_STEP_US = 200_000
ACTOR_RADIUS_M = 40.0
WINDOW_M = 60.0
WHEELBASE_M = 2.875
LANE_WIDTH_M = 3.5

# --- fixed values: normalisation scales ---
SPEED_SCALE = 50.0
ACCEL_SCALE = 20.0
YAW_RATE_SCALE = 10.0
CURVATURE_SCALE = 1.0
SPATIAL_SCALE = 100.0
RASTER_VELOCITY_SCALE = 40.0
SPEED_LIMIT_SCALE = 50.0
COMMAND_SCALE = 5.0
GEAR_SCALE = 6.0
LENGTH_SCALE = 10.0
BREADTH_SCALE = 5.0

# --- fixed values: codes ---
COMMANDS = {
    "LaneFollow": 0,
    "Left": 1,
    "Right": 2,
    "Straight": 3,
    "ChangeLaneLeft": 4,
    "ChangeLaneRight": 5,
}
COMMAND_SENTENCES = {
    0: "Continue following lane",
    1: "Prepare for left turn",
    2: "Prepare for right turn",
    3: "Proceed straight through intersection",
    4: "Change lane to the left",
    5: "Change lane to the right",
}
VEHICLE, WALKER, BIKE = 0, 1, 2
BIKE_WORDS = ("bike", "bicycle", "motorcycle")
RED, YELLOW, GREEN = 0, 1, 2
DRIVING_LANE = 1

# --- fixed values: raster channels ---
CHANNELS = {
    "drivable": 0,
    "lane_centre": 1,
    "lane_left": 2,
    "lane_right": 3,
    "stop_line": 4,
    "crosswalk": 5,
    "intersection": 6,
    "route_corridor": 7,
    "route_centre": 8,
    "light_red": 9,
    "light_yellow": 10,
    "light_green": 11,
    "vehicle": 12,
    "walker": 13,
    "bike": 14,
    "velocity_x": 15,
    "velocity_y": 16,
    "speed_limit": 17,
}

# --- fixed values: reward weights and bounds ---
REWARD_WEIGHTS = {
    "progress": 0.1,
    "collision": -5.0,
    "offroad": -2.0,
    "violation": -1.0,
    "comfort": -0.01,
    "completion": 5.0,
}
REWARD_CLIP = (-10.0, 10.0)
STOP_LINE_REACH_M = 8.0

# --- fixed values: recording gate, cuts and quality thresholds ---
GATE_TICKS = 15
GATE_SPEED_MPS = 1.0
GOAL_REACH_M = 5.0
STATIONARY_STEP_M = 0.05
STATIONARY_SHIFT_M = 0.2
STATIONARY_SPEED_MPS = 0.2
STATIONARY_KEEP_RATIO = 0.15
STATIONARY_MAX_RUN = 5
LIGHT_RADIUS_M = 15.0
BEHIND_M = -1.0
JUMP_M = 60.0

# --- fixed values: sample fields ---
BC_FIELDS = (
    "frame_id", "episode_id", "ego_vec", "bev", "route",
    "objects", "object_mask", "future_xy", "future_v", "future_mask",
)
RL_FIELDS = (
    "reward_raw", "reward_clipped", "reward_normalized", "reward_progress",
    "reward_collision", "reward_offroad", "reward_violation", "reward_comfort",
    "reward_completion", "reward_mean", "reward_std", "noise_injected",
    "action_steer", "action_throttle", "action_brake", "route_progress_delta",
    "done", "discount",
)
