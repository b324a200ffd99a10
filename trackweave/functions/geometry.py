"""Positions, distances, angles and fields of view as Columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Locator:
    """Where a position lies in the feature map: key, index of x, and scale of each axis."""

    key: str = "com"
    first: int = 0
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def position(self, features: Column) -> Point:
        value = F.when(features.getItem(self.key).isNull(), F.raise_error(F.lit(f"no feature {self.key}"))).otherwise(features.getItem(self.key))
        return tuple(s * F.get(value, F.lit(self.first + k)).cast("double") for k, s in enumerate(self.scale))  # type: ignore[return-value]


COM = Locator("com")
COM_CORRECTED = Locator("com_corrected")
INTENSITY_MAXIMUM = Locator("intmaxpos", first=1)


def corrected(features: Column, plain: Locator = COM) -> Point:
    """The corrected position in its own unit scale where there is one, else the plain position."""
    other = features.getItem("com_corrected")
    return tuple(F.coalesce(F.get(other, F.lit(k)).cast("double"), p) for k, p in enumerate(plain.position(features)))  # type: ignore[return-value]


def point(prefix: str = "", suffix: str = "") -> Point:
    return tuple(F.col(f"{prefix}{axis}{suffix}") for axis in "xyz")  # type: ignore[return-value]


def squared_distance(a: Point, b: Point) -> Column:
    return reduce(lambda s, d: s + d, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(squared_distance(a, b))


def angle(vertex: Point, leg1: Point, leg2: Point) -> Column:
    """The angle in radians at ``vertex``; a leg of no length gives NaN."""
    u = [p - q for p, q in zip(leg1, vertex, strict=True)]
    v = [p - q for p, q in zip(leg2, vertex, strict=True)]
    dot = reduce(lambda s, d: s + d, [p * q for p, q in zip(u, v, strict=True)])
    length = distance(leg1, vertex) * distance(leg2, vertex)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / length))))


@dataclass(frozen=True)
class FieldOfView:
    """An axis-aligned box in (t, x, y, z); both ends belong to it."""

    lower: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    upper: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        if any(a > b for a, b in zip(self.lower, self.upper, strict=True)):
            raise ValueError("a lower bound exceeds its upper bound")

    def contains(self, t: Column, p: Point) -> Column:
        return reduce(lambda s, c: s & c, [v.between(F.lit(a), F.lit(b)) for v, a, b in zip((t, *p), self.lower, self.upper, strict=True)])

    def spatial_margin(self, p: Point) -> Column:
        """The least distance to one of the six face planes."""
        return F.least(*[F.abs(v - F.lit(b)) for k, v in enumerate(p) for b in (self.lower[k + 1], self.upper[k + 1])])

    def temporal_margin(self, t: Column) -> Column:
        return F.least(F.abs(t - F.lit(self.lower[0])), F.abs(t - F.lit(self.upper[0])))

    def border_distance(self, p: Point, relative: bool = False) -> Column:
        """As :meth:`spatial_margin`, without z for a flat box; ``relative`` divides by the sides."""
        axes = range(2) if self.lower[3] == self.upper[3] else range(3)
        side = [self.upper[k + 1] - self.lower[k + 1] for k in axes]
        if relative and not all(side):
            return F.lit(float("nan"))  # a box without extent has no relative distance
        parts = [F.abs(p[k] - F.lit(b)) / F.lit(side[k] if relative else 1.0) for k in axes for b in (self.lower[k + 1], self.upper[k + 1])]
        return F.least(*parts)


def sort_indices(values: Column) -> Column:
    """Positions of an array's values in ascending order of value, then of position; missing ones come last."""
    return F.transform(F.sort_array(F.transform(values, lambda v, i: F.struct(v.isNull().alias("missing"), v.alias("v"), i.alias("i")))), lambda s: s["i"])


def reorder(values: Column, order: Column) -> Column:
    picked = F.transform(order, lambda i: F.get(values, i))
    return F.when(F.size(values) != F.size(order), F.raise_error(F.lit("sizes differ"))).otherwise(picked)
