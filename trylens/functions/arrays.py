"""Array helpers: Python slice rules, fixed-length padding, binding a value once."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst's CollapseProject inlines a projected column into every lambda
    that uses it, so a fold referenced inside ``filter``/``transform`` would be
    recomputed per element.  Wrapping it in a one-element array and mapping
    over that array binds it once.
    """
    return F.transform(F.array(value), body)[0]


def built_once(make: Callable[[Column], Column]) -> Callable[[str], Column]:
    """``make`` of a column by name, built once per application: a large fold
    takes seconds to put together, whatever it is applied to."""
    built: dict[tuple[str, str], Column] = {}

    @wraps(make)
    def of(name: str) -> Column:
        key = (SparkSession.active().sparkContext.applicationId, name)
        if key not in built:
            built[key] = make(F.col(name))
        return built[key]
    return of


def _norm_index(i: Column, n: Column) -> Column:
    """Python slice bound normalisation to ``[0, n]``."""
    return F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))


def py_slice(arr: Column, start: Column | int | None = None,
             stop: Column | int | None = None) -> Column:
    """``arr[start:stop]`` with Python's clamping and negative indices."""
    n = F.size(arr)
    s = F.lit(0) if start is None else _norm_index(_c(start), n)
    e = n if stop is None else _norm_index(_c(stop), n)
    return F.slice(arr, s + 1, F.greatest(e - s, F.lit(0)))


def pad_to(arr: Column, length: int, fill) -> Column:
    """Cut ``arr`` to ``length`` elements or pad it with ``fill``."""
    return F.slice(F.concat(arr, F.array_repeat(F.lit(fill), length)), 1, length)


def json_int_list(arr: Column) -> Column:
    """``json.dumps`` of a list of ints: ``[0, 1, 1]`` (comma + space)."""
    return F.concat(F.lit("["), F.array_join(arr.cast("array<string>"), ", "), F.lit("]"))


def comma_list(arr: Column) -> Column:
    """``",".join(map(str, arr))``."""
    return F.array_join(arr.cast("array<string>"), ",")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
