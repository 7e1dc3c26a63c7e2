"""Array and map expressions used by packing and decoding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is otherwise evaluated again for every
    element the lambda visits.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_line(texts: Column) -> Column:
    """An array of strings as one string, by which it travels: line by line, or as JSON after a NUL."""
    lines = F.array_join(texts, "\n")
    plain = (F.size(texts) > 0) & ~F.exists(texts, lambda t: t.isNull() | t.contains("\n")) & ~lines.startswith("\0")
    return F.when(plain, lines).otherwise(F.concat(F.lit("\0"), F.to_json(texts)))


def from_line(line: Column) -> Column:
    """The array of :func:`to_line`."""
    return F.when(line.startswith("\0"), F.from_json(F.substring(line, 2, 2**31 - 1), "array<string>")).otherwise(F.split(line, "\n"))


def pad_to(values: Column, size: int, filler: Column) -> Column:
    """Right-pad an array to ``size`` with ``filler``."""
    return F.concat(values, F.array_repeat(filler, F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def sizes_and_nulls(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list, 0 for a null one, and which lists are null."""
    nulls = lists.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), nulls


def to_lists(values: pa.Array, sizes: np.ndarray, nulls: np.ndarray) -> pa.Array:
    """Lists of the given sizes, null where ``nulls`` says so."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(nulls, False) if nulls.any() else None), values)


def framed(values: Column, element: T.DataType, first, last, filler, size: int) -> Column:
    """``first``, the array, ``last``, and ``filler`` up to ``size``, on Arrow batches.

    An array that is longer with its ends stays whole; a null one stays null.
    """

    @F.arrow_udf(T.ArrayType(element))
    def frame(lists: pa.Array) -> pa.Array:
        inner, nulls = sizes_and_nulls(lists)
        flat = lists.flatten()
        n = len(flat)
        widths = np.where(nulls, 0, np.maximum(inner + 2, size))
        begins = np.cumsum(widths) - widths
        # Places of the values, and after them those of the two ends and the filler.
        source = np.full(int(widths.sum()), n + 2, dtype=np.int64)
        source[begins[~nulls]] = n
        source[(begins + inner + 1)[~nulls]] = n + 1
        source[np.arange(n) + np.repeat(begins + 1 - (np.cumsum(inner) - inner), inner)] = np.arange(n)
        pool = pa.concat_arrays([flat, pa.array([first, last, filler], flat.type)])
        return to_lists(pool.take(pa.array(source)), widths, nulls)

    return frame(values)


def where_one(flags: Column, values: Column, other: int) -> Column:
    """Values where the flag beside them is 1, else ``other``, on Arrow batches."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def choose(marks: pa.Array, lists: pa.Array) -> pa.Array:
        sizes, nulls = sizes_and_nulls(lists)
        hit = pc.fill_null(pc.equal(marks.flatten(), 1), False)
        return to_lists(pc.if_else(hit, lists.flatten(), pa.scalar(other, pa.int32())), sizes, nulls)

    return choose(flags, values)


def kept_ones(flags: Column, values: Column, element: T.DataType) -> Column:
    """Only the values whose flag is 1, on Arrow batches."""

    @F.arrow_udf(T.ArrayType(element))
    def keep(marks: pa.Array, lists: pa.Array) -> pa.Array:
        sizes, nulls = sizes_and_nulls(lists)
        hit = pc.fill_null(pc.equal(marks.flatten(), 1), False)
        own = np.repeat(np.arange(len(sizes)), sizes)
        left = np.bincount(own[hit.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        return to_lists(lists.flatten().filter(hit), left, nulls)

    return keep(flags, values)


@F.arrow_udf(T.IntegerType())
def count_ones(marks: pa.Array) -> pa.Array:
    """Number of ones in each array."""
    sizes, nulls = sizes_and_nulls(marks)
    hit = pc.fill_null(pc.equal(marks.flatten(), 1), False).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(sizes)), sizes)
    return pa.array(np.bincount(own[hit], minlength=len(sizes)).astype(np.int32), mask=nulls)


@F.arrow_udf(T.LongType())
def placed_total(lists: pa.Array) -> pa.Array:
    """Sum of each integer array's elements times their places; null where the array or an element is."""
    sizes, nulls = sizes_and_nulls(lists)
    cells = lists.flatten()
    values = pc.fill_null(cells, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    weighted = values * (np.arange(len(values)) - np.repeat(begins, sizes) + 1)
    ahead = np.append(0, np.cumsum(weighted))
    if cells.null_count:
        gaps = np.append(0, np.cumsum(cells.is_null().to_numpy(zero_copy_only=False)))
        nulls = nulls | (gaps[begins + sizes] > gaps[begins])
    return pa.array(ahead[begins + sizes] - ahead[begins], mask=nulls)


def ones_then_zeros(ones: Column, size: int) -> Column:
    """Array of ``size`` ints, the first ``ones`` of them 1."""
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(size) - ones))


def log_sum_exp(scores: Column) -> Column:
    zero = F.lit(0.0).cast("double")
    return let(
        F.array_max(scores),
        lambda top: top + F.log(F.aggregate(scores, zero, lambda acc, x: acc + F.exp(x - top))),
    )


def softmax(scores: Column) -> Column:
    return let(log_sum_exp(scores), lambda norm: F.transform(scores, lambda x: F.exp(x - norm)))


def argmax(scores: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x
    )


def invert_map(mapping: Column) -> Column:
    """Swap keys and values; values must be unique, as ids are."""
    return F.map_from_arrays(F.map_values(mapping), F.map_keys(mapping))


def as_ints(values: Column) -> Column:
    return values.cast("array<int>")
