"""Column expressions: periodic geometry, angles, labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def box_columns(box) -> list[str]:
    """The columns that hold the box's lengths, where it has names of columns in place of numbers: each frame then has a box of its own."""
    return [v for v in box if isinstance(v, str)]


def length_of(box, axis: str, prefix: str = ""):
    """The box's length along an axis: a number, or the column (with the prefix of a side) that holds it."""
    v = box[AXES.index(axis)]
    return F.col(f"{prefix}{v}") if isinstance(v, str) else v


def wrap(c: Column, length) -> Column:
    """Into [0, length); a length of 0 leaves the coordinate as it is."""
    return F.pmod(c, F.lit(length)) if length else c


def nearest_image(d: Column, length) -> Column:
    """The difference to the nearest periodic image; a tie goes to the even multiple."""
    if isinstance(length, int):  # whole numbers stay whole
        return d - F.lit(length) * F.rint(d / F.lit(length)).cast("long")
    if not isinstance(length, Column):
        length = F.lit(length)
    return d - length * F.rint(d / length)


def delta(a: str, b: str, axis: str, box) -> Column:
    return nearest_image(F.col(f"{b}{axis}") - F.col(f"{a}{axis}"), length_of(box, axis, a))


def squared(a: str, b: str, box) -> Column:
    """Squared distance of the points whose coordinates have the prefixes a and b."""
    d = [delta(a, b, k, box) for k in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def dot(u: list[Column], v: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, [a * b for a, b in zip(u, v, strict=True)])


def angle(u: list[Column], v: list[Column]) -> Column:
    """Degrees between two vectors; null if one has no length."""
    uu, vv = dot(u, u).cast("double"), dot(v, v).cast("double")
    cosine = dot(u, v).cast("double") / F.sqrt(uu) / F.sqrt(vv)
    return F.when((uu > 0) & (vv > 0), F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))))


def label_is(label: Column, pattern: str) -> Column:
    """A pattern of letters and a number is one label; any other is a prefix."""
    return label == pattern if re.fullmatch(r"[A-Za-z]+\d+", pattern) else label.startswith(pattern)


def any_label(label: Column, patterns) -> Column:
    """Whether one of the patterns (a list, or text with commas) fits; blank ones are ignored."""
    names = [p.strip() for p in (patterns.split(",") if isinstance(patterns, str) else patterns)]
    return reduce(lambda p, q: p | q, [label_is(label, p) for p in names if p], F.lit(False))


def first_label(label: Column, values: dict[str, float], default: float) -> Column:
    """The value of the first pattern that fits."""
    return F.coalesce(*[F.when(label_is(label, p), F.lit(v)) for p, v in values.items()], F.lit(default))
