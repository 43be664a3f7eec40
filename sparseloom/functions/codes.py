"""Sparse codes: ascending arrays of different ints. Distances hold for codes of different size too."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .vec import _col


def is_code(code: Column | str, k: int | None = None) -> Column:
    c = _col(code)
    ok = F.array_sort(F.array_distinct(c)) == c
    if k is not None:
        ok = ok & (F.size(c) == k)
    return F.coalesce(ok & F.forall(c, lambda x: x.isNotNull() & (x >= 0)), F.lit(False))


def checked(code: Column | str, k: int | None = None) -> Column:
    c = _col(code)
    return F.when(is_code(c, k), c).otherwise(F.raise_error(F.lit("not a sorted code of different units of the expected size")).cast("array<int>"))


def from_units(units: Column | str) -> Column:
    """A code from units in any order, with repeats."""
    return F.array_sort(F.array_distinct(_col(units)))


def intersection_size(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b)))


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.size(a) + F.size(b) - 2 * intersection_size(a, b)


def register(spark: SparkSession) -> None:
    """SQL functions code_hamming, code_overlap, vec_dot, vec_l2 and code_top_k, made of native expressions."""
    for name, args, body in (
        ("code_overlap", "a ARRAY<INT>, b ARRAY<INT>", ("INT", "size(array_intersect(a, b))")),
        ("code_hamming", "a ARRAY<INT>, b ARRAY<INT>", ("INT", "size(a) + size(b) - 2 * size(array_intersect(a, b))")),
        ("vec_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")),
        ("vec_l2", "a ARRAY<DOUBLE>", ("DOUBLE", "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))")),
        ("code_top_k", "s ARRAY<DOUBLE>, k INT", ("ARRAY<INT>", "array_sort(transform(slice(array_sort(transform(s, (x, i) -> struct(-x AS s, i AS i))), 1, k), x -> x.i))")),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {body[0]} RETURN {body[1]}")
