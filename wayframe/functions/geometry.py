"""Geometry, kinematics and command expressions (plain columns, no shuffles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayframe import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def rotate_to_ego(vx, vy, yaw_deg) -> tuple[Column, Column]:
    """World vector in the vehicle's axes (rotation by minus the yaw)."""
    a = F.radians(_c(yaw_deg))
    vx, vy = _c(vx), _c(vy)
    return vx * F.cos(a) + vy * F.sin(a), vy * F.cos(a) - vx * F.sin(a)


def to_ego_xy(x, y, ego_x, ego_y, yaw_deg) -> tuple[Column, Column]:
    """World point in the vehicle's axes."""
    return rotate_to_ego(_c(x) - _c(ego_x), _c(y) - _c(ego_y), yaw_deg)


def wrap_pi(angle) -> Column:
    """Angle in [-pi, pi]; values already inside, both ends included, stay as they are."""
    a = _c(angle)
    turn = F.lit(2.0) * F.pi()
    return (
        F.when(a > F.pi(), a - turn * F.ceil((a - F.pi()) / turn))
        .when(a < -F.pi(), a + turn * F.ceil((-a - F.pi()) / turn))
        .otherwise(a)
    )


def wrap_deg(angle) -> Column:
    """Angle in [-180, 180)."""
    return F.pmod(_c(angle) + 180.0, F.lit(360.0)) - 180.0


def speed3(vx, vy, vz) -> Column:
    vx, vy, vz = _c(vx), _c(vy), _c(vz)
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def goal_distance(x, y, goal_x, goal_y) -> Column:
    return F.hypot(_c(goal_x) - _c(x), _c(goal_y) - _c(y))


def path_curvature(yaw_rate, speed) -> Column:
    return _c(yaw_rate) / F.greatest(_c(speed), F.lit(0.5))


def steer_angle(curvature, wheelbase: float = K.WHEELBASE_M) -> Column:
    return F.atan(_c(curvature) * wheelbase)


def limit_to_mps(limit) -> Column:
    """Speed limit unit repair: values above 30 are taken as km/h."""
    v = F.coalesce(_c(limit), F.lit(0.0))
    return F.when(v > 30.0, v / 3.6).otherwise(v)


def repair_speed_limit(limit, default: float | None = None, force: float | None = None) -> tuple[Column, Column]:
    """Repaired limit in m/s and a flag telling that the default was used.

    With neither ``default`` nor ``force`` only the unit is repaired.
    """
    v = limit_to_mps(limit)
    if force is not None:
        return F.lit(float(force)), F.lit(False)
    if default is None:
        return v, F.lit(False)
    missing = v <= 0.0
    return F.when(missing, F.lit(float(default))).otherwise(v), missing


def time_of_day(azimuth_deg) -> tuple[Column, Column]:
    a = F.radians(F.pmod(_c(azimuth_deg), F.lit(360.0)))
    return F.sin(a), F.cos(a)


def encode_command(name) -> Column:
    """Command code of a planner option name; unknown names give 0."""
    bare = F.regexp_replace(_c(name), "^RoadOption\\.", "")
    table = F.create_map(*[F.lit(x) for kv in K.COMMANDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, bare), F.lit(0))


def command_label(code) -> Column:
    code = _c(code).cast("int")
    table = F.create_map(*[F.lit(x) for n, c in K.COMMANDS.items() for x in (c, n)])
    return F.coalesce(F.try_element_at(table, code), F.format_string("Unknown(%d)", code))


def command_text(code) -> Column:
    code = _c(code).cast("int")
    table = F.create_map(*[F.lit(x) for kv in K.COMMAND_SENTENCES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), command_label(code))


def command_from_yaw(here_deg, ahead_deg, junction_here, junction_ahead) -> Column:
    """Command implied by the lane's yaw change; only junctions give a turn."""
    turn = wrap_deg(_c(ahead_deg) - _c(here_deg))
    return (
        F.when(~(_c(junction_here) | _c(junction_ahead)), F.lit(K.COMMANDS["LaneFollow"]))
        .when(F.abs(turn) < 15.0, F.lit(K.COMMANDS["Straight"]))
        .when(turn > 0.0, F.lit(K.COMMANDS["Left"]))
        .otherwise(F.lit(K.COMMANDS["Right"]))
    )


def command_from_path(last_x, last_y, n_points, lane_width: float = K.LANE_WIDTH_M) -> Column:
    """Command implied by the driven path's end point; null for fewer than two points."""
    x, y = _c(last_x), _c(last_y)
    heading = F.degrees(F.atan2(y, x))
    sideways = (F.abs(y) > lane_width * 0.6) & (F.abs(heading) < 15.0)
    return (
        F.when(_c(n_points) < 2, F.lit(None).cast("int"))
        .when(sideways & (y > 0), F.lit(K.COMMANDS["ChangeLaneLeft"]))
        .when(sideways, F.lit(K.COMMANDS["ChangeLaneRight"]))
        .when(heading > 20.0, F.lit(K.COMMANDS["Left"]))
        .when(heading < -20.0, F.lit(K.COMMANDS["Right"]))
        .when(F.abs(heading) < 10.0, F.lit(K.COMMANDS["LaneFollow"]))
        .otherwise(F.lit(K.COMMANDS["Straight"]))
    )


def in_window(x, y, window_m: float = K.WINDOW_M) -> Column:
    half = window_m / 2.0
    return (F.abs(_c(x)) <= half) & (F.abs(_c(y)) <= half)


def object_type(type_name) -> Column:
    """Object class from the actor's type name; null for anything but vehicles and walkers."""
    n = _c(type_name)
    bike = F.lit(False)
    for word in K.BIKE_WORDS:
        bike = bike | n.contains(word)
    return (
        F.when(n.startswith("vehicle.") & bike, F.lit(K.BIKE))
        .when(n.startswith("vehicle."), F.lit(K.VEHICLE))
        .when(n.startswith("walker."), F.lit(K.WALKER))
    )
