"""Arrays as rasters: cells with coordinates, CF scaling, reference systems, stacks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..plans.window import clipped, read_layers, read_window


def scaled(value: Column, attrs: dict, fill) -> Column:
    """CF packing undone: fill to null, times scale_factor, plus add_offset."""
    out = value.cast("double")
    for bad in {fill, attrs.get("_FillValue"), attrs.get("missing_value")} - {None}:
        out = F.when(F.isnan(out) if bad == "NaN" else value == F.lit(float(bad)), F.lit(None)).otherwise(out)
    return out * float(attrs.get("scale_factor", 1)) + float(attrs.get("add_offset", 0))


def epsg_of(attrs_json: Column) -> Column:
    """spatial_epsg of a grid mapping's attributes, spelled as int, float, text or a list of one."""
    raw = F.get_json_object(attrs_json, "$.spatial_epsg")
    return F.regexp_extract(raw, r"^\s*\[?\s*\"?\s*([0-9]+)(?:\.0*)?\s*\"?\s*\]?\s*$", 1).try_cast("int")


def crs_of(arrays: DataFrame) -> DataFrame:
    """array_path, epsg and crs_wkt by way of each array's grid_mapping attribute."""
    group = F.regexp_replace("array_path", "[^/]*$", "")
    own = arrays.select("array_path", F.concat(group, F.get_json_object("attrs", "$.grid_mapping")).alias("mapping"))
    maps = arrays.select(F.col("array_path").alias("mapping"), epsg_of(F.col("attrs")).alias("epsg"), F.get_json_object("attrs", "$.crs_wkt").alias("crs_wkt"))
    return own.filter(F.col("mapping").isNotNull()).join(maps, "mapping", "left").select("array_path", "epsg", "crs_wkt")


def raster(m: Manifest, path: str | None = None, bounds=None, scale: bool = True) -> DataFrame:
    """Cells of an array with its coordinates' values; without a path there must be one data array."""
    if path is None:
        names = data_arrays(m)
        if len(names) != 1:
            raise ValueError(f"name one of {', '.join(names)}")
        path = names[0]
    a = m.array(path)
    cells = read_window(m, path, bounds)
    attrs = json.loads(a["attrs"] or "{}")
    if scale and a["dtype"][1:2] in "iuf":
        cells = cells.withColumn("value", scaled(F.col("value"), attrs, a["fill_value"]))
    return with_coordinates(m, path, a, cells, bounds)


def with_coordinates(m: Manifest, path: str, a, cells: DataFrame, bounds=None) -> DataFrame:
    """Cells with a column for each dimension that has a coordinate array beside the array."""
    group = path.rpartition("/")[0]
    have = {r[0] for r in m.arrays.select("array_path").filter(F.col("array_path").isin([f"{group}/{d}".lstrip("/") for d in a["dims"] or []])).collect()}
    window = clipped(bounds, a["shape"])
    for k, d in enumerate(a["dims"] or []):
        coord = f"{group}/{d}".lstrip("/")
        if coord in have and coord != path:
            axis = read_window(m, coord, [window[k]]).withColumnsRenamed({"i0": f"i{k}", "value": d})
            cells = cells.join(axis, f"i{k}", "left")
    return cells


def data_arrays(m: Manifest, group: str = "") -> list[str]:
    """Arrays right below a group that are no coordinate, bounds or grid mapping."""
    rows = m.arrays.select("array_path", "dims", "attrs").collect()
    head = group + "/" if group else ""
    own = [r for r in rows if r["array_path"].startswith(head) and "/" not in r["array_path"][len(head) :]]
    meta = {d for r in own for d in (r["dims"] or [])}
    for r in own:
        attrs = json.loads(r["attrs"] or "{}")
        meta |= {str(attrs[k]) for k in ("grid_mapping", "bounds") if k in attrs} | set(str(attrs.get("coordinates", "")).split())
    return sorted(r["array_path"] for r in own if r["array_path"][len(head) :] not in meta)


def raster_stack(m: Manifest, group: str = "", bounds=None) -> DataFrame:
    """The group's data arrays of one shape as columns. Layers of one chunk grid are decoded
    together; layers of several grids are joined on their indexes."""
    names = data_arrays(m, group)
    if not names:
        raise ValueError(f"no data array in {group!r}")
    arrays = {n.rpartition("/")[2]: m.array(n) for n in names}
    first = next(iter(arrays.values()))
    if all(a["shape"] == first["shape"] and a["chunks"] == first["chunks"] for a in arrays.values()):
        cells = read_layers(m, arrays, bounds)
        for n, a in arrays.items():
            if a["dtype"][1:2] in "iuf":
                cells = cells.withColumn(n, scaled(F.col(n), json.loads(a["attrs"] or "{}"), a["fill_value"]))
        return with_coordinates(m, names[0], first, cells, bounds)
    out = None
    for n in names:
        a = m.array(n)
        keys = [f"i{d}" for d in range(len(a["shape"]))]
        cells = raster(m, n, bounds) if out is None else read_window(m, n, bounds)
        if out is not None and a["dtype"][1:2] in "iuf":
            cells = cells.withColumn("value", scaled(F.col("value"), json.loads(a["attrs"] or "{}"), a["fill_value"]))
        cells = cells.withColumnRenamed("value", n.rpartition("/")[2])
        out = cells if out is None else out.join(cells, keys, "full")
    return out
