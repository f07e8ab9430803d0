"""Geometry of hand landmarks: 21 points, wrist first, as arrays of x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import bound
from .vectors import total

#: Places of fingertips, thumb first, of the knuckle of each finger, and of the middle knuckle.
TIPS = (4, 8, 12, 16, 20)
KNUCKLES = {8: 5, 12: 9, 16: 13, 20: 17}
MIDDLE = 9
POINTS, FEATURES, TINY = 21, 79, 1e-9


#: What has to be done before features() says anything: recorded beside each network, so that it can describe itself.
CONTRACT = {
    "feature_contract": "landmark-v1",
    "feature_dimension": FEATURES,
    "points": POINTS,
    "steps": ["a left hand is mirrored", "the wrist is moved to the origin", "the farthest point from it comes to distance 1", "the middle knuckle is turned straight up in the plane"],
    "distances": ["tips to the wrist", "tips to the thumb's", "tips of neighbouring fingers", "tips to their own knuckles"],
    "augmented": False,
}


def points_of(values: Column) -> Column:
    """21 points from the first 63 numbers of an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(values, 3 * i + k).cast("double")))


def points_from_structs(points: Column) -> Column:
    """Points given as structs with fields x, y and z, as arrays of these; a null coordinate stays null."""
    return F.transform(points, lambda p: F.array(*(p[axis].cast("double") for axis in ("x", "y", "z"))))


def _length(p: Column) -> Column:
    return F.sqrt(total(F.transform(p, lambda v: v * v)))


def _apart(p: Column, q: Column) -> Column:
    return F.sqrt(total(F.zip_with(p, q, lambda a, b: (a - b) * (a - b))))


def canonical_points(points: Column, handedness: Column) -> Column:
    """Points of a right hand, wrist at the origin, largest distance 1, middle knuckle straight up; null for a wrong
    number of points or a hand without extent."""
    left = F.coalesce(F.startswith(F.lower(F.trim(handedness)), F.lit("l")), F.lit(False))
    sided = F.transform(points, lambda p: F.array(F.when(left, -p[0]).otherwise(p[0]), p[1], p[2]))
    moved = bound(sided, lambda s: F.transform(s, lambda p: F.zip_with(p, s[0], lambda a, b: a - b)))
    span = lambda m: F.array_max(F.transform(m, _length))
    scaled = bound(moved, lambda m: bound(span(m), lambda d: F.when(d > TINY, F.transform(m, lambda p: F.transform(p, lambda v: v / d)))))

    def turned(s: Column) -> Column:
        x, y = s[MIDDLE][0], s[MIDDLE][1]
        reach = F.sqrt(x * x + y * y)
        return F.when(reach <= TINY, s).otherwise(F.transform(s, lambda p: F.array((-y / reach) * p[0] + (x / reach) * p[1], (-x / reach) * p[0] + (-y / reach) * p[1], p[2])))

    return F.when(F.size(points) == POINTS, bound(scaled, turned))


def features(points: Column, handedness: Column) -> Column:
    """79 features: the canonical coordinates, then 16 distances: each tip to the wrist, tips to the thumb's, tips of
    neighbouring fingers, tips to their own knuckles. Null where there is no canonical form."""
    def of(c: Column) -> Column:
        pairs = [(t, TIPS[0]) for t in TIPS[1:]] + list(zip(TIPS[1:], TIPS[2:])) + list(KNUCKLES.items())
        return F.concat(F.flatten(c), F.array(*(_length(c[t]) for t in TIPS)), F.array(*(_apart(c[a], c[b]) for a, b in pairs)))

    return bound(canonical_points(points, handedness), lambda c: F.when(c.isNotNull(), of(c)))


def minimal_features(points: Column) -> Column:
    """Width and height of the box, wrist to tips in the plane, and the angle in degrees between thumb and first finger."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    flat = lambda i: F.array(points[i][0] - points[0][0], points[i][1] - points[0][1])
    cosine = total(F.zip_with(flat(TIPS[0]), flat(TIPS[1]), lambda a, b: a * b)) / (_length(flat(TIPS[0])) * _length(flat(TIPS[1])))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return F.array(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y), *(_length(flat(t)) for t in TIPS), angle)


def crop_box(points: Column, width: Column, height: Column, padding: float, least: int = 8) -> Column:
    """A square around points given in shares of the picture, wider by padding, in whole pixels and cut at the
    picture's edges; null under least pixels."""
    x, y = F.transform(points, lambda p: p[0] * width), F.transform(points, lambda p: p[1] * height)
    half = F.greatest(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y)) * (1 + padding) / 2
    cx, cy = (F.array_max(x) + F.array_min(x)) / 2, (F.array_max(y) + F.array_min(y)) / 2
    whole = lambda c: c.cast("int")
    box = F.struct(F.greatest(F.lit(0), whole(cx - half)).alias("left"), F.greatest(F.lit(0), whole(cy - half)).alias("top"), F.least(whole(width), whole(cx + half)).alias("right"), F.least(whole(height), whole(cy + half)).alias("bottom"))
    return F.when((box["right"] - box["left"] >= least) & (box["bottom"] - box["top"] >= least), box)


def plane_points(values: Column) -> Column:
    """x and y of all 21 points in a row: 42 values."""
    return F.flatten(F.transform(points_of(values), lambda p: F.array(p[0], p[1])))


def wrist_to_tips(values: Column) -> Column:
    """The distances in the plane from the wrist to the tips of the four fingers, the thumb left out."""
    return bound(points_of(values), lambda p: F.array(*(F.hypot(p[0][0] - p[t][0], p[0][1] - p[t][1]) for t in TIPS[1:])))


#: The letters of each group of hand shapes.
SHAPE_GROUPS = ("ABCEHMNOST", "DIJXZ", "GKLPQRUVY", "FW")


def shape_group(letter: Column) -> Column:
    """The number of a letter's group of hand shapes; null for anything else."""
    return F.coalesce(*(F.when(letter.isin(*own), F.lit(k)) for k, own in enumerate(SHAPE_GROUPS)))
