"""Chunk grids as column expressions: sizes, indexes, keys. Zero-based, C order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_size(shape: Column, chunks: Column) -> Column:
    """Chunks along each dimension; a last one may reach over the edge."""
    return F.zip_with(shape, chunks, lambda n, c: quotient(n + c - 1, c))


def quotient(a: Column, b: Column) -> Column:
    """Integer division of numbers that are not negative, exact beyond 2^53 (`/` makes doubles)."""
    return F.call_function("div", a, b)


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1).cast("long"), lambda a, x: a * x)


def _below(grid: Column, d: Column) -> Column:
    """Cells of the grid to one step along dimension d."""
    return product(F.slice(grid, d + 2, F.size(grid)))


def delinearize(lin: Column, grid: Column) -> Column:
    dims = F.when(F.size(grid) > 0, F.sequence(F.lit(0), F.size(grid) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(dims, lambda d: quotient(lin, _below(grid, d)) % F.element_at(grid, d + 1))


def linearize(index: Column, grid: Column) -> Column:
    """Horner's rule over the dimensions."""
    return F.aggregate(F.arrays_zip(index.alias("i"), grid.alias("n")), F.lit(0).cast("long"), lambda a, x: a * x["n"] + x["i"])


def chunk_key(index: Column) -> Column:
    """`1.0.2`; `0` for an array without dimensions."""
    return F.when(F.size(index) == 0, F.lit("0")).otherwise(F.array_join(F.transform(index, lambda x: x.cast("string")), "."))


def parse_chunk_key(key: Column, grid: Column) -> Column:
    """The chunk's linear number, null for what is no key of the grid."""
    parts = F.transform(F.split(key, r"\."), lambda x: F.when(x.rlike(r"^(0|[1-9][0-9]{0,17})$"), x.cast("long")))
    inside = F.forall(F.arrays_zip(parts.alias("i"), grid.alias("n")), lambda x: F.coalesce(x["i"] < x["n"], F.lit(False)))
    scalar = F.when((F.size(grid) == 0) & (key == "0"), F.lit(0).cast("long"))
    return F.coalesce(scalar, F.when((F.size(parts) == F.size(grid)) & inside, linearize(parts, grid)))


def affine_offset(index: Column, base: Column, strides: Column) -> Column:
    """base + the sum of index times stride."""
    return F.aggregate(F.zip_with(index, strides, lambda i, s: i * s), base.cast("long"), lambda a, x: a + x)


def prefixes(path: Column) -> Column:
    """Proper prefixes of a path, the root ('') first: a/b/c -> '', a, a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
