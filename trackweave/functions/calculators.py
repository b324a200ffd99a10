"""Feature calculators: functions of one, two or three feature arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-4


@dataclass(frozen=True)
class Calculator:
    """A named function of feature arrays and the numbers of arguments that it takes."""

    name: str
    arity: tuple[int, ...]
    function: Callable[..., Column]

    def __call__(self, *values: Column) -> Column:
        if len(values) not in self.arity:
            raise NotImplementedError(f"{self.name} of {len(values)} arrays")
        return self.function(*values)


def _same_length(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("feature lengths differ"))).otherwise(out)


def _each(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: _same_length(a, b, F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def _total(f: Callable[[Column, Column], Column], last: Callable[[Column], Column] = lambda x: x) -> Callable[[Column, Column], Column]:
    """The sum first, then zeros up to the arrays' length."""

    def run(a: Column, b: Column) -> Column:
        total = last(F.aggregate(_each(f)(a, b), F.lit(0.0), lambda s, x: s + x))
        return F.concat(F.array(total), F.array_repeat(F.lit(0.0), F.size(a) - 1))

    return run


def _ratio(x: Column, y: Column, value: Column) -> Column:
    return F.when((x == y) | ((x < TINY) & (y < TINY)), 1.0).otherwise(value)


def _of_last_two(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *v: _each(f)(*v[-2:])


#: The names under which calculators are looked up; the spelling of the fourth is fixed.
CALCULATORS = {
    "Identity": Calculator("Identity", (1,), lambda a: a),
    "ElementWiseSquaredDistance": Calculator("squared distance", (2,), _each(lambda x, y: (x - y) * (x - y))),
    "AbsoluteDifference": Calculator("AbsDiff", (2,), _total(lambda x, y: F.abs(x - y))),
    "SquareRooteSquaredDifference": Calculator("SqrtSquaredDiff", (2,), _total(lambda x, y: (x - y) * (x - y), F.sqrt)),
    "SquaredDifference": Calculator("SquaredDiff", (2,), _total(lambda x, y: (x - y) * (x - y))),
    "Ratio": Calculator("Ratio", (2, 3), _of_last_two(lambda x, y: _ratio(x, y, F.least(x, y) / F.greatest(x, y)))),
    "AsymmetricRatio": Calculator("AsymmetricRatio", (2, 3), _of_last_two(lambda x, y: _ratio(x, y, x / y))),
}


def calculator(key: str) -> Calculator:
    if key not in CALCULATORS:
        raise KeyError(f"no calculator {key}")
    return CALCULATORS[key]


def pairwise(name: str, f: Callable[[Column, Column], Column]) -> Calculator:
    return Calculator(name, (2,), f)


def triplet(name: str, f: Callable[[Column, Column, Column], Column]) -> Calculator:
    return Calculator(name, (3,), f)


def feature(features: Column, key: str) -> Column:
    value = features.getItem(key)
    return F.when(value.isNull(), F.raise_error(F.lit(f"no feature {key}"))).otherwise(value)


def extract(calc: Calculator, key: str, *features: Column) -> Column:
    """A calculator over one feature of one, two or three feature maps."""
    return calc(*[feature(f, key) for f in features])


def extractor_name(calc: Calculator, key: str) -> str:
    return f"{calc.name}<{key}>"


def extract_all(wanted: list[tuple[str, str]], *features: Column) -> Column:
    """(calculator key, feature) pairs to one map from extractor name to values."""
    return F.create_map(*[x for c, key in wanted for x in (F.lit(extractor_name(calculator(c), key)), extract(calculator(c), key, *features))])
