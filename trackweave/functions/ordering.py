"""The order in which the SQL's list functions leave equal values."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from trackweave.functions.geometry import sort_indices

#: Shorter lists, and parts of longer ones, are sorted by insertion, which keeps equal values in place.
SHORT = 24
#: Longer lists are sorted another way (by bytes), which is not followed here.
LONG = 127
#: How far insertions may move values of a part that seems to be sorted.
MOVES = 8


def _insert(keys: list, at: list, begin: int, end: int, most: float = math.inf, guarded: bool = True) -> bool:
    moved = 0
    for cur in range(begin + 1, end):
        i, item = cur, at[cur]
        while (i > begin or not guarded) and keys[item] < keys[at[i - 1]]:
            at[i] = at[i - 1]
            i -= 1
        at[i] = item
        moved += cur - i
        if moved > most:
            return False
    return True


def _swap(at: list, i: int, j: int) -> None:
    at[i], at[j] = at[j], at[i]


def _part_left(keys: list, at: list, begin: int, end: int) -> int:
    """Values equal to the first one go before it; where it ends up."""
    pivot, first, last = at[begin], begin, end - 1
    key = keys[pivot]
    while key < keys[at[last]]:
        last -= 1
    if last + 1 == end:
        while first < last:
            first += 1
            if key < keys[at[first]]:
                break
    else:
        first += 1
        while not key < keys[at[first]]:
            first += 1
    while first < last:
        _swap(at, first, last)
        last -= 1
        while key < keys[at[last]]:
            last -= 1
        first += 1
        while not key < keys[at[first]]:
            first += 1
    at[begin], at[last] = at[last], pivot
    return last


def _part_right(keys: list, at: list, begin: int, end: int) -> tuple[int, bool]:
    """Values equal to the first one go behind it; (where it ends up, nothing had to move)."""
    pivot, first, last = at[begin], begin + 1, end
    key = keys[pivot]
    while keys[at[first]] < key:
        first += 1
    if first - 1 == begin:
        while first < last:
            last -= 1
            if keys[at[last]] < key:
                break
    else:
        last -= 1
        while not keys[at[last]] < key:
            last -= 1
    done = first >= last
    if not done:
        # both halves of what is left are read first, then the values on the wrong sides change places
        _swap(at, first, last)
        first += 1
        middle = first + (last - first) // 2
        left = [i for i in range(first, middle) if not keys[at[i]] < key]
        right = [i for i in range(last - 1, middle - 1, -1) if keys[at[i]] < key]
        n = min(len(left), len(right))
        if len(left) == len(right):
            for i, j in zip(left, right, strict=True):
                _swap(at, i, j)
        elif n:
            held = at[left[0]]
            at[left[0]] = at[right[0]]
            for i in range(1, n):
                at[right[i - 1]] = at[left[i]]
                at[left[i]] = at[right[i]]
            at[right[n - 1]] = held
        first = middle
        for i in reversed(left[n:]):
            first -= 1
            _swap(at, i, first)
        for i in reversed(right[n:]):
            _swap(at, i, first)
            first += 1
    at[begin], at[first - 1] = at[first - 1], pivot
    return first - 1, done


def _sort(keys: list, at: list, begin: int, end: int, bad: int, leftmost: bool) -> None:
    while end - begin >= SHORT:
        middle = begin + (end - begin) // 2
        for i, j in ((middle, begin), (begin, end - 1), (middle, begin)):  # the median of three goes first
            if keys[at[j]] < keys[at[i]]:
                _swap(at, i, j)
        if not leftmost and not keys[at[begin - 1]] < keys[at[begin]]:
            begin = _part_left(keys, at, begin, end) + 1
            continue
        mid, done = _part_right(keys, at, begin, end)
        left, right = mid - begin, end - mid - 1
        if min(left, right) < (end - begin) // 8:
            bad -= 1
            if not bad:
                at[begin:end] = sorted(at[begin:end], key=lambda i: keys[i])
                return
            if left >= SHORT:
                _swap(at, begin, begin + left // 4)
                _swap(at, mid - 1, mid - left // 4)
            if right >= SHORT:
                _swap(at, mid + 1, mid + 1 + right // 4)
                _swap(at, end - 1, end - right // 4)
        elif done and _insert(keys, at, begin, mid, MOVES) and _insert(keys, at, mid + 1, end, MOVES):
            return
        _sort(keys, at, begin, mid, bad, leftmost)
        begin, leftmost = mid + 1, False
    _insert(keys, at, begin, end, guarded=leftmost)


def graded(values: list) -> list[int]:
    """Positions of a list's values in ascending order, as DuckDB's ``list_grade_up`` has them.

    It sorts by pattern-defeating quicksort without branches, which leaves equal values in an
    order that depends on the whole list. What is not a number comes after all numbers and
    what is missing last. A list of more than ``LONG`` values, or a part whose pivots are bad
    time after time, has equal values in order of position. DuckDB sorts the lists of a vector
    of rows at once; where they have less than 128 values in all, or lists that are sorted
    already make long runs, its order of equal values depends on the other rows, too.
    """
    keys = [(1, 0.0) if v is None else (0, math.inf, 1) if v != v else (0, v, 0) for v in values]
    at = list(range(len(keys)))
    if len(keys) > LONG:
        return sorted(at, key=lambda i: keys[i])
    _sort(keys, at, 0, len(keys), max(len(keys), 1).bit_length() - 1, True)
    return at


@F.arrow_udf(ArrayType(IntegerType()))  # pandas takes what is missing for what is not a number
def _graded(lists: pa.Array) -> pa.Array:
    return pa.array([None if v is None else graded(v) for v in lists.to_pylist()], pa.list_(pa.int32()))


def grade_up(values: Column) -> Column:
    """As :func:`sort_indices`, with equal values in the order of :func:`graded`; only lists that have some leave the JVM."""
    same = F.size(F.array_distinct(F.transform(values, lambda v: v + F.lit(0.0)))) < F.size(values)  # zeros lose their sign
    return F.coalesce(_graded(F.when(same & F.size(values).between(SHORT, LONG), values)), sort_indices(values))
