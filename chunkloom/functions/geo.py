"""Georeferencing: transforms as column expressions, GeoKeys and nodata as plain Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def affine_of(matrix: Column, scale: Column, tiepoint: Column) -> Column:
    """Row-major 4x4 from a matrix if there is one, else from scale and tiepoint (y downwards)."""
    at = lambda c, i: F.element_at(c, i)
    zero, one = F.lit(0.0), F.lit(1.0)
    made = F.array(
        at(scale, 1), zero, zero, at(tiepoint, 4) - at(tiepoint, 1) * at(scale, 1),
        zero, -at(scale, 2), zero, at(tiepoint, 5) + at(tiepoint, 2) * at(scale, 2),
        zero, zero, at(scale, 3), zero, zero, zero, zero, one,
    )
    return F.coalesce(matrix, made)


def pixel_to_world(affine: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda i: F.element_at(affine, i)
    return at(1) * x + at(2) * y + at(4), at(5) * x + at(6) * y + at(8)


def pixel_centers(affine: Column, n: Column, axis: str, is_area: Column) -> Column:
    """World coordinates of n pixel centers along x or y, for a transform without rotation."""
    half = F.when(is_area, 0.5).otherwise(0.0)
    scale, start = (1, 4) if axis == "x" else (6, 8)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(affine, start) + (i + half) * F.element_at(affine, scale))


def decode_geokeys(directory: list[int], doubles: list[float], text: str) -> dict[int, object]:
    """The entries of a GeoKey directory: (key, place, count, value or index)."""
    out: dict[int, object] = {}
    for k in range(4, min(len(directory), 4 + 4 * directory[3]) - 3, 4):
        key, where, count, value = directory[k : k + 4]
        if where == 0:
            out[key] = value
        elif where == 34736:
            out[key] = doubles[value] if count == 1 else list(doubles[value : value + count])
        elif where == 34737:
            out[key] = text[value : value + count].rstrip("|\0")
    return out


def epsg_of_geokeys(keys: dict[int, object]) -> int | None:
    """The projected system's code, else the geographic one's; user-defined codes are none."""
    for key in (3072, 2048):
        v = keys.get(key)
        if isinstance(v, int) and 1 <= v <= 32766:
            return v
    return None


def parse_nodata(text: str | None) -> float | None:
    t = (text or "").strip().strip("\0").lower()
    if t in ("nan", "-nan", "+nan"):
        return float("nan")
    try:
        return float(t) if t else None
    except ValueError:
        return None
