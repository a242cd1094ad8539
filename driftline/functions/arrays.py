"""Column expressions on arrays that hold one value per point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.scalars import heading_change


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without it the optimizer may inline a derived array into a lambda, where it would be rebuilt per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(count: Column) -> Column:
    """[0, 1, .. count-1]; empty when count <= 0 (a bare ``sequence`` would count downwards)."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def same_length(cols: list[Column], n: int | None = None) -> Column:
    """True when all arrays are present and equally long (``n`` long if given)."""
    want = F.lit(n) if n is not None else F.size(cols[0])
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & (F.size(c) == want)
    return F.coalesce(ok, F.lit(False))


def drop_nulls(arr: Column) -> Column:
    """Remove NULL elements; an array left empty becomes NULL."""
    kept = F.array_compact(arr)
    return F.when(F.size(kept) > 0, kept)


def slice_from(arr: Column, start: Column, n: Column | int) -> Column:
    """``n`` elements from 0-based ``start``."""
    return F.slice(arr, start + 1, n)


def rebase(offsets: Column) -> Column:
    """Offsets counted from the first element."""
    return bind(offsets, lambda o: F.transform(o, lambda x: x - F.get(o, F.lit(0))))


def steps(arr: Column) -> Column:
    """Forward differences, one element shorter than the input."""
    return bind(arr, lambda a: F.transform(
        indices(F.size(a) - 1), lambda i: F.get(a, i + 1) - F.get(a, i)))


def turns(headings: Column) -> Column:
    return bind(headings, lambda h: F.transform(
        indices(F.size(h) - 1), lambda i: heading_change(F.get(h, i), F.get(h, i + 1))))


def ratio(num: Column, den: Column) -> Column:
    """Element-wise quotient; a zero divisor gives NULL."""
    return F.zip_with(num, den, lambda a, b: F.try_divide(a, b))


def repeat_last(arr: Column, k: int = 1) -> Column:
    """Append ``k`` copies of the last element."""
    return bind(arr, lambda a: F.concat(a, F.array_repeat(F.get(a, F.size(a) - 1), k)))


def positions(arr: Column, predicate: Callable[[Column], Column]) -> Column:
    """0-based positions whose element satisfies ``predicate``."""
    return bind(arr, lambda a: F.filter(indices(F.size(a)), lambda i: predicate(F.get(a, i))))


def interleave(cols: list[Column], n: int) -> Column:
    """k arrays of n values as one array of n*k, all values of point 0 first."""
    return F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(*[F.get(c, i).cast("double") for c in cols])))


def stride(flat: Column, k: int, offset: int, n: int) -> Column:
    """Inverse of :func:`interleave` for one of the k features."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(flat, i * k + offset))


def all_finite(arr: Column) -> Column:
    """No NULL, NaN or infinite element."""
    inf = float("inf")
    return F.coalesce(F.forall(
        arr, lambda x: x.isNotNull() & ~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf))), F.lit(False))


def within(arr: Column, low: float, high: float) -> Column:
    """Every present element lies in [low, high]."""
    return F.forall(arr, lambda x: x.isNull() | x.between(low, high))


def cast_elements(arr: Column, dtype: str) -> Column:
    """Elements that cannot be read as ``dtype`` become NULL."""
    return F.transform(arr, lambda x: x.try_cast(dtype))


def truncate_to_long(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.try_cast("double").try_cast("bigint"))


def mean_of(arr: Column) -> Column:
    """Mean of the present elements."""
    return bind(F.array_compact(arr), lambda a: F.try_divide(
        F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(a)))
