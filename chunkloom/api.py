"""Entry points: scan, load, save and the operators on whole manifests."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.codecs import register_codec
from .manifest import Manifest
from .operators.combine import Members, concat, merge
from .operators.edit import materialize_affine, replace_prefix, set_chunk, set_uri
from .operators.integrity import validate
from .operators.listing import storage_size
from .operators.ranges import coalesce_ranges
from .operators.raster import raster, raster_stack
from .plans.fetch import authorize, register_transport
from .plans.window import read_points, read_window
from .sources import base, hdf5, jp2, kerchunk, native, tiff, zips
from .sources.base import register_driver

__all__ = [
    "Manifest", "Members", "authorize", "coalesce_ranges", "concat", "load", "load_many", "materialize_affine", "merge", "raster", "raster_stack", "read_points", "read_window", "register_codec",
    "register_driver", "register_format", "register_transport", "replace_prefix", "save", "scan", "scan_cost", "scan_many", "scan_series", "set_chunk", "set_uri", "storage_size", "validate", "zips",
]
_ = (hdf5, jp2, tiff)  # imported for the drivers that they register

#: Saved formats by name: (save(m, path, **options), load(spark, path)).
_FORMATS: dict[str, tuple[Callable, Callable]] = {
    "native": (native.save, native.load), "zarr_manifest": (native.save_zarr_manifest, native.load_zarr_manifest),
    "kerchunk_json": (kerchunk.save_json, kerchunk.load_json), "kerchunk_parquet": (kerchunk.save_parquet, kerchunk.load_parquet),
}
FORMATS = tuple(_FORMATS)


def register_format(name: str, save: Callable, load: Callable) -> None:
    """A saved format of one's own, for save(format=name) and load(format=name)."""
    _FORMATS[name] = (save, load)


def _provenance(path: str, driver: str | None, **more) -> dict:
    return {"path": path, "driver": driver or base.driver_for(path), "scanned_at": time.time()} | more


def scan_many(spark: SparkSession, paths: list[str], driver: str | None = None, **options) -> list[Manifest]:
    """A manifest of each file, in order; the files are scanned together, a task for each.

    The scan's rows are cached for all of them; `release` on one gives them up. Very many files
    are better scanned by `scan_series`, whose tables are not cut up by file.
    """
    if not paths:
        return []
    rows = base.scan_rows(spark, paths, driver, **options).persist()
    attrs = base.root_attrs(rows)
    return [base.manifest_of(rows.filter(rows["ord"] == i), attrs.get(i), _provenance(p, driver), (rows,)) for i, p in enumerate(paths)]


def scan_series(spark: SparkSession, paths: list[str], driver: str | None = None, **options) -> Members:
    """Files scanned together, to be given to `concat` or `merge`: one set of tables with a
    member column, so the plan's size does not grow with the number of files."""
    if not paths:
        raise ValueError("no files")
    rows = base.scan_rows(spark, paths, driver, **options).persist()
    files, arrays, chunks = base.tables_of(rows)
    attrs = base.root_attrs(rows)
    return Members(files, arrays, chunks, [attrs.get(i, {}) for i in range(len(paths))], [base.stem(p) for p in paths], (rows,))


def scan_cost(spark: SparkSession, paths: list[str], driver: str | None = None, **options) -> DataFrame:
    """ord, uri, requests and bytes_read that scanning each file takes."""
    return base.scan_cost(base.scan_rows(spark, paths, driver, **options))


def scan(spark: SparkSession, path: str, driver: str | None = None, **options) -> Manifest:
    return scan_many(spark, [path], driver, **options)[0]


def format_of(path: str, spark: SparkSession | None = None) -> str | None:
    """The saved format that a path holds, by its files or its first character; None for none.
    The path is one that Spark can read: local, or of any store that it knows."""
    spark = spark or SparkSession.active()
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    except Exception:  # noqa: BLE001 - a store that only the engine's own transports know holds no saved manifest
        return None
    has = lambda name: fs.exists(jvm.org.apache.hadoop.fs.Path(at, name))
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isDirectory():
        return "zarr_manifest" if has("manifest.json") else "kerchunk_parquet" if has(".zmetadata") else "native" if has("chunks") and has("arrays") else None
    stream = fs.open(at)
    try:
        for _ in range(256):
            c = stream.read()
            if c < 0 or not chr(c).isspace():
                return "kerchunk_json" if c == ord("{") else None
    finally:
        stream.close()
    return None


def save(m: Manifest, path: str, format: str | None = None, **options) -> None:
    """Write a whole manifest; without a format the path's ending says which."""
    format = format or ("kerchunk_json" if path.endswith(".json") else "kerchunk_parquet" if path.endswith((".parq", ".parquet")) else "native")
    if format not in _FORMATS:
        raise ValueError(f"format {format!r}; there are {', '.join(_FORMATS)}")
    _FORMATS[format][0](m.root("save"), path, **options)


def load(spark: SparkSession, path: str, format: str | None = None, driver: str | None = None, **options) -> Manifest:
    """A saved manifest, or a scan of a source file."""
    if format and driver:
        raise ValueError("give a format or a driver, not both")
    format = format or (None if driver else format_of(path, spark))
    if format is None:
        if path.rstrip("/").endswith(".zarr"):
            raise ValueError(f"{path}: a Zarr store is read by a Zarr library; this engine loads manifests and scans files")
        return scan(spark, path, driver, **options)
    if options:
        raise ValueError(f"{', '.join(options)}: scan options do not go with a saved manifest")
    if format not in _FORMATS:
        raise ValueError(f"format {format!r}; there are {', '.join(_FORMATS)}")
    return _FORMATS[format][1](spark, path)


def load_many(spark: SparkSession, paths: list[str], format: str | None = None, driver: str | None = None, **options) -> list[Manifest]:
    """A manifest of each path, in order. Source files are scanned together, a task for each."""
    if format and driver:
        raise ValueError("give a format or a driver, not both")
    saved = [format or (None if driver else format_of(p, spark)) for p in paths]
    scanned = iter(scan_many(spark, [p for p, s in zip(paths, saved) if s is None], driver, **options))
    return [next(scanned) if s is None else load(spark, p, s) for p, s in zip(paths, saved)]


def refs_data_source():
    """A Python Data Source for spark.read.format("array_refs"): one partition per file.

    Register with spark.dataSource.register(refs_data_source()). Options: driver and what the
    driver knows; paths are separated by commas.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    from .plans import fetch

    drivers, extensions, access = dict(base._DRIVERS), dict(base._EXTENSIONS), fetch.current()  # workers know none of their own

    class RefsReader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [InputPartition((i, p)) for i, p in enumerate(self.options["path"].split(","))]

        def read(self, partition):
            base._EXTENSIONS.update(extensions)
            order, path = partition.value
            name = self.options.get("driver") or base.driver_for(path)
            opts = {k: v for k, v in self.options.items() if k not in ("path", "driver")}
            yield from base._batches(base.rows_of(path, order, drivers[name][1], opts, access))

    class Refs(DataSource):
        @classmethod
        def name(cls):
            return "array_refs"

        def schema(self):
            return base.ROW_DDL

        def reader(self, schema):
            return RefsReader(self.options)

    return Refs


def cells(m: Manifest, path: str, bounds=None) -> DataFrame:
    return read_window(m, path, bounds)
