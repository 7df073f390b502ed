"""Column functions on names, ids, parameters, angles, lines and quadrilaterals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_filename(name: Column) -> Column:
    """The last part of a path, with either slash."""
    return F.element_at(F.split(F.translate(name, "\\", "/"), "/", -1), -1)


def get_extension(name: Column) -> Column:
    """Lower-case suffix without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(display_filename(name), r"\.([^.]*)$", 1))


def is_valid_resource_id(ident: Column) -> Column:
    return F.coalesce(ident.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def parameter_label(params: Column) -> Column:
    """k_v__k_v in order of keys, with blanks, dots and dashes as underscores; `default` for none."""
    parts = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("_"), e["value"].cast("string")))
    return F.when(F.coalesce(F.size(params), F.lit(0)) <= 0, "default").otherwise(F.translate(F.array_join(parts, "__"), " .-", "___"))


def metric_value(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def norm_angle(a: Column) -> Column:
    """Degrees in (-90, 90]."""
    m = a - 180 * F.floor(a / 180)
    return F.when(m > 90, m - 180).otherwise(m)


def angle_distance(a: Column, b: Column) -> Column:
    """Of lines without a direction: 0 to 90."""
    d = F.abs(a - b)
    m = d - 180 * F.floor(d / 180)
    return F.least(m, 180 - m)


def area_score(ratio: Column, low: float = 0.18, best: float = 0.70, high: float = 0.98) -> Column:
    """Triangle over [low, high] with its top at `best`."""
    up, down = (ratio - low) / (best - low), (high - ratio) / (high - best)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(ratio <= best, up).otherwise(down)))


def segment_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return norm_angle(F.degrees(F.atan2((y2 - y1).cast("double"), (x2 - x1).cast("double"))))


def quad_area(c: Column) -> Column:
    """Shoelace area of four corners (structs x, y)."""
    cross = [c[i]["x"] * c[(i + 1) % 4]["y"] - c[(i + 1) % 4]["x"] * c[i]["y"] for i in range(4)]
    return F.abs(cross[0] + cross[1] + cross[2] + cross[3]) / 2


def quad_sides(c: Column) -> Column:
    return F.array(*[F.hypot(c[(i + 1) % 4]["x"] - c[i]["x"], c[(i + 1) % 4]["y"] - c[i]["y"]) for i in range(4)])


def quad_angles(c: Column) -> Column:
    """Interior angles in degrees; null where two corners coincide."""
    out = []
    for i in range(4):
        a, o, b = c[(i + 3) % 4], c[i], c[(i + 1) % 4]
        dot = (a["x"] - o["x"]) * (b["x"] - o["x"]) + (a["y"] - o["y"]) * (b["y"] - o["y"])
        size = F.hypot(a["x"] - o["x"], a["y"] - o["y"]) * F.hypot(b["x"] - o["x"], b["y"] - o["y"])
        out.append(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, size))))))
    return F.array(*out)


def is_convex(c: Column) -> Column:
    cross = []
    for i in range(4):
        a, b, d = c[i], c[(i + 1) % 4], c[(i + 2) % 4]
        cross.append((b["x"] - a["x"]) * (d["y"] - b["y"]) - (b["y"] - a["y"]) * (d["x"] - b["x"]))
    return F.least(*cross) * F.greatest(*cross) > 0


def order_corners(c: Column) -> Column:
    """Top left, top right, bottom right, bottom left: least and greatest of x + y and of y - x."""
    by = lambda key, last: F.element_at(F.array_sort(F.transform(c, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))), -1 if last else 1)
    plus, minus = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    pick = [by(plus, False), by(minus, False), by(plus, True), by(minus, True)]
    return F.array(*[F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in pick])
