"""Costs as Columns. All are minimised; probabilities enter as ``-weight * ln(p)``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geometry import FieldOfView, Point, angle, distance, squared_distance

#: Fixed values of the cost model.
FORBIDDEN_DIVISION = 1e13
CELLNESS_FLOOR = 1e-5
PROBABILITY_FLOOR = 1e-10
CELLNESS_EPS = 1e-7
APPEARANCE_EPS = 1e-5


def constant(value: float) -> Column:
    return F.lit(float(value))


def distance_energy(a: Point, b: Point) -> Column:
    """The plain distance: it is the cost that carries the name of a squared one."""
    return distance(a, b)


def division_by_geometry(mother: Point, first: Point, second: Point, mean: float, least_angle: float, by_distance: bool = True, by_angle: bool = True) -> Column:
    cost = F.lit(0.0)
    if by_angle:
        cost = cost + F.when(angle(mother, first, second) / math.pi < least_angle, FORBIDDEN_DIVISION).otherwise(0.0)
    if by_distance:
        for daughter in (first, second):
            off = distance(mother, daughter) - mean
            cost = cost + off * off
    return cost


def division_by_angle(mother: Point, first: Point, second: Point) -> Column:
    return division_by_geometry(mother, first, second, 0.0, 0.8, by_distance=False)


def division_by_sum(mother: Point, first: Point, second: Point, cost: float) -> Column:
    return distance(mother, first) + distance(mother, second) + cost


def division_by_squares(mother: Point, first: Point, second: Point, weight: float, cost: float) -> Column:
    return weight * (squared_distance(mother, first) + squared_distance(mother, second) + cost)


def _floored(p: Column, floor: float) -> Column:
    return F.when(p == 0, F.lit(floor)).otherwise(p)


def neg_ln_cellness(p: Column, weight: float) -> Column:
    return -weight * F.log(_floored(p, CELLNESS_FLOOR))


def neg_ln_not_cellness(p: Column, weight: float) -> Column:
    return -weight * F.log(_floored(1 - p, CELLNESS_FLOOR))


def neg_ln(p: Column, weight: float) -> Column:
    return -weight * F.log(F.greatest(p, F.lit(PROBABILITY_FLOOR)))


def detection_energies(probabilities: Column, weight: float) -> Column:
    """The cost of every number of objects, as an array."""
    return F.transform(probabilities, lambda p: neg_ln(p.cast("double"), weight))


def division_energy(p: Column, weight: float, divides: bool) -> Column:
    return neg_ln(p if divides else 1 - p, weight)


def transition_probability(d: Column, moves: bool, alpha: float) -> Column:
    decay = F.exp(-d / alpha)
    return decay if moves else 1 - decay


def transition_energies(d: Column, weight: float, alpha: float, states: int) -> Column:
    """The cost of 0..states objects on an arc: the same for every number above none."""
    still, move = (neg_ln(transition_probability(d, m, alpha), weight) for m in (False, True))
    return F.array(still, *[move] * states)


def prior_energy(weight: float, prior: list[float], state: int) -> Column:
    if not 0 <= state < len(prior):
        raise ValueError("no prior for that number of objects")
    return F.lit(-weight * math.log(prior[state] or PROBABILITY_FLOOR))


def border_aware_constant(t: Column, weight: float, at: int, early: bool, margin: int = 1) -> Column:
    near = (t >= at) & (t < at + margin) if early else (t > at - margin) & (t <= at)
    return F.when(near, 0.0).otherwise(float(weight))


def border_aware_weight(p: Point, cost: float, margin: float, relative: bool, fov: FieldOfView) -> Column:
    """The cost falls linearly to nothing towards the border of the field of view."""
    if relative and margin > 0.5:
        raise ValueError("a relative margin is at most 0.5")
    if fov.lower == fov.upper or margin == 0:
        return F.lit(float(cost))
    d = fov.border_distance(p, relative)
    return F.when(~F.isnan(d) & (d < margin), cost * d / margin).otherwise(float(cost))


def _share(value: Column, eps: float) -> Column:
    return F.log((value + eps) / (1 + eps))


def division_by_cellness(mother: Point, first: Point, second: Point, c: Column, c1: Column, c2: Column, difference: float = 1461, absolute: float = 190) -> Column:
    """Missing cellness adds nothing."""
    apart = c1 - c2
    parts = F.coalesce(absolute * _share(c * c, CELLNESS_EPS), F.lit(0.0)) + F.coalesce(difference * _share(1 - apart * apart, CELLNESS_EPS), F.lit(0.0))
    return squared_distance(mother, first) + squared_distance(mother, second) - parts


def move_by_cellness(a: Point, b: Point, ca: Column, cb: Column, difference: float = 1140) -> Column:
    apart = ca - cb
    return squared_distance(a, b) - F.coalesce(difference * _share(1 - apart * apart, CELLNESS_EPS), F.lit(0.0))


def _needed(c: Column) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit("no feature cellness"))).otherwise(c)


def disappearance_by_cellness(c: Column, weight: float = 1000) -> Column:
    return -weight * _share(1 - _needed(c), CELLNESS_EPS)


def appearance_by_cellness(c: Column, weight: float = 1000) -> Column:
    return -weight * _share(1 - _needed(c), APPEARANCE_EPS)


def size_probabilities(volume: Column, means: list[float], variances: list[float]) -> Column:
    raw = [F.exp(-(volume - m) * (volume - m) / s) for m, s in zip(means, variances, strict=True)]
    total = raw[0]
    for r in raw[1:]:
        total = total + r
    return F.array(*[r / total for r in raw])


def size_prior(volume: Column, average: float, states: int) -> Column:
    """P(number of objects) of a detection by its size, kept in [0.01, 0.99]."""
    spread = max(average * average / 4, 1e-4)
    p = size_probabilities(volume, [k * average for k in range(states + 1)], [spread] * (states + 1))
    return F.transform(p, lambda v: F.greatest(F.lit(0.01), F.least(F.lit(0.99), v)))


def hard_prior(states: int) -> list[float]:
    some = [0.7 * 0.3 ** (k - 1) for k in range(1, states + 1)]
    return [1 - sum(some), *some]
