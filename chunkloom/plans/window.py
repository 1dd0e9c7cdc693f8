"""Reads: a window over an array becomes a filter on chunk rows, then fetch and decode.

The rewrite is declarative: the numbers of the window's chunks are generated from its bounds,
so a window costs what it holds, however large the array; chunk rows stay if their number lies
between the window's first and last (which a saved table's statistics prune by) and their index
meets the window in every dimension. A formula's places are computed from the numbers. What is
left is dealt out by file, sorted by offset, and read in Arrow batches; a worker holds the
chunks of one small batch at a time. Cells come out as i0, i1, ... and value, clipped to the
window and the array's shape, so chunks that reach over the edge and missing chunks need no
second look.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import codecs, grid
from ..manifest import Manifest
from ..operators.listing import affine_chunks, all_chunks

FETCH_ROWS = 64  # chunks that a worker fetches together


def clipped(bounds, shape) -> list[tuple[int, int]]:
    """Half-open bounds per dimension within the shape; None is all of it."""
    if bounds is None:
        return [(0, n) for n in shape]
    if len(bounds) != len(shape):
        raise ValueError(f"{len(bounds)} bounds for {len(shape)} dimensions")
    return [(0, n) if b is None else (max(0, b[0]), min(n, b[1])) for b, n in zip(bounds, shape)]


def chunk_rows(m: Manifest, path: str) -> DataFrame:
    own = m.chunks.filter(F.col("array_path") == path)
    return own.unionByName(affine_chunks(m.arrays.filter(F.col("array_path") == path)))


def prune(rows: DataFrame, shape, chunks, window: list[tuple[int, int]]) -> DataFrame:
    """Chunk rows whose index meets the window; the index is arithmetic on chunk_lin, so the
    filter runs inside the scan's stage."""
    counts = [-(-n // c) for n, c in zip(shape, chunks)]
    if any(hi <= lo for lo, hi in window):
        return rows.filter(F.lit(False))
    below, first, last = 1, 0, 0
    cond = F.lit(True)
    for d in range(len(counts) - 1, -1, -1):
        at = grid.quotient(F.col("chunk_lin"), F.lit(below)) % counts[d]
        lo, hi = window[d][0] // chunks[d], (window[d][1] - 1) // chunks[d]
        if (lo, hi) != (0, counts[d] - 1):
            cond = cond & at.between(lo, hi)
        first, last = first + lo * below, last + hi * below
        below *= counts[d]
    return rows.filter(F.col("chunk_lin").between(first, last) & cond)


def window_chunks(m: Manifest, shape, chunks, window: list[tuple[int, int]]) -> DataFrame:
    """chunk_lin and idx of the window's chunks, generated."""
    spans = [(lo // c, -(-hi // c)) for (lo, hi), c in zip(window, chunks)]
    counts = [-(-n // c) for n, c in zip(shape, chunks)]
    n = 0 if any(hi <= lo for lo, hi in window) else math.prod(b - a for a, b in spans)
    lin, index, below, inside = F.lit(0).cast("long"), [], 1, 1
    for d in range(len(spans) - 1, -1, -1):
        a, b = spans[d]
        at = grid.quotient(F.col("id"), F.lit(inside)) % max(1, b - a) + a
        index.append(at)
        lin = lin + at * below
        inside, below = inside * max(1, b - a), below * counts[d]
    every = F.array(*index[::-1]) if index else F.array().cast("array<bigint>")
    return m.spark.range(n).select(lin.alias("chunk_lin"), every.alias("idx"))


def _values(a: np.ndarray, dtype: str) -> pa.Array:
    kind = schema.spark_type(dtype)
    if a.dtype.kind == "S":
        return pa.array([x.rstrip(b"\0").decode("utf-8", "replace") for x in a.tolist()], pa.string())
    if a.dtype.kind == "c":
        t = pa.float32() if a.dtype.itemsize == 8 else pa.float64()
        return pa.StructArray.from_arrays([pa.array(a.real, t), pa.array(a.imag, t)], names=["re", "im"])
    if kind.startswith("decimal"):
        return pa.array([int(x) for x in a], pa.decimal128(20, 0))
    up = {"smallint": np.int16, "int": np.int32, "bigint": np.int64, "tinyint": np.int8, "float": np.float32, "double": np.float64, "boolean": np.bool_}[kind]
    return pa.array(np.ascontiguousarray(a, dtype=up))


def decode_cells(rows: DataFrame, array, window: list[tuple[int, int]], fill_missing: bool = True) -> DataFrame:
    """Cells of pruned chunk rows (chunk_lin, state, uri, offset, nbytes, inline)."""
    dtype, shape, chunks = array["dtype"], list(array["shape"]), list(array["chunks"])
    compressor, filters, fill = array["compressor"], array["filters"], schema.fill_of(array["dtype"], array["fill_value"])
    counts = [-(-n // c) for n, c in zip(shape, chunks)]
    nd = len(shape)
    ddl = ", ".join([f"i{d} bigint" for d in range(nd)] + [f"value {schema.spark_type(dtype)}"])
    fetched = fetcher()

    def cells(lin: int, data: bytes | None) -> pa.RecordBatch | None:
        index = np.unravel_index(lin, counts) if nd else ()
        lo = [int(max(i * c, w[0])) for i, c, w in zip(index, chunks, window)]
        hi = [int(min((i + 1) * c, w[1], n)) for i, c, w, n in zip(index, chunks, window, shape)]
        if any(b <= a for a, b in zip(lo, hi)):
            return None
        if data is None:
            part = np.full([b - a for a, b in zip(lo, hi)], np.zeros((), dtype) if fill is None else fill, dtype)
        else:
            whole = codecs.decode_chunk(data, dtype, chunks, compressor, filters)
            part = whole[tuple(slice(a - int(i) * c, b - int(i) * c) for a, b, i, c in zip(lo, hi, index, chunks))]
        axes = np.meshgrid(*[np.arange(a, b) for a, b in zip(lo, hi)], indexing="ij") if nd else []
        return pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in axes] + [_values(part.ravel(), dtype)], names=[f"i{d}" for d in range(nd)] + ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, data in fetched(batches):
            if data is not None or fill_missing:
                out = cells(r["chunk_lin"], data)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, ddl)


def fetcher():
    """A function for tasks: batches of located chunk rows to (row, bytes), bytes None for what is
    missing (a reference of no bytes is, too). It carries the driver's transports, checks and codecs."""
    from . import fetch

    access, registered = fetch.current(), codecs.extras()

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes | None]]:
        codecs.adopt(registered)
        for batch in batches:
            for at in range(0, batch.num_rows, FETCH_ROWS):
                rows = batch.slice(at, FETCH_ROWS).to_pylist()
                got: dict[int, bytes] = {}
                by_uri: dict[str, list[int]] = {}
                for i, r in enumerate(rows):
                    if r["state"] == schema.INLINE:
                        got[i] = r["inline"]
                    elif r["state"] == schema.VIRTUAL and r["nbytes"]:
                        if r["nbytes"] == schema.WHOLE_OBJECT:
                            raise ValueError(f"{r['uri']}: a whole-object reference cannot be fetched as a range")
                        by_uri.setdefault(r["uri"], []).append(i)
                for uri, at_rows in by_uri.items():
                    for i, data in zip(at_rows, access.ranges(uri, [(rows[i]["offset"], rows[i]["nbytes"]) for i in at_rows])):
                        got[i] = data
                for i, r in enumerate(rows):
                    yield r, got.get(i)

    return fetched


def _located(m: Manifest, rows: DataFrame, *more: str) -> DataFrame:
    placed = rows.join(m.files.select("file_id", "uri"), "file_id", "left")
    return placed.select("chunk_lin", "state", "uri", "offset", "nbytes", "inline", *more)


def with_chunks(m: Manifest, array, numbers: DataFrame, window=None) -> DataFrame:
    """`numbers` (chunk_lin, and idx for a formula) with each chunk's row; without one it is missing."""
    if array["map_kind"] == "affine":
        f = array["affine"]
        where = grid.affine_offset(F.col("idx"), F.lit(f["base"]), F.array(*[F.lit(s).cast("long") for s in f["strides"]]) if f["strides"] else F.array().cast("array<bigint>"))
        return numbers.select("*", F.lit(schema.VIRTUAL).alias("state"), F.lit(f["file_id"]).alias("file_id"), where.alias("offset"), F.lit(f["chunkbytes"]).alias("nbytes"), F.lit(None).cast("binary").alias("inline"))
    own = m.chunks.filter(F.col("array_path") == array["array_path"]).drop("array_path")
    if window is not None:
        own = prune(own, array["shape"], array["chunks"], window)
    return numbers.join(own, "chunk_lin", "left").withColumn("state", F.coalesce("state", F.lit(schema.MISSING)))


def dealt(placed: DataFrame) -> DataFrame:
    """Chunks of one stretch of a file go to one task in order, so its reads coalesce; a large file
    is many stretches."""
    stretch = F.floor(F.coalesce("offset", F.lit(0)) / (256 << 20))
    salt = F.when(F.col("state") == schema.VIRTUAL, F.xxhash64("uri", stretch)).otherwise(F.col("chunk_lin"))
    return placed.withColumn("_k", salt).repartition("_k").sortWithinPartitions("uri", "offset").drop("_k")


def read_window(m: Manifest, path: str, bounds=None) -> DataFrame:
    """Cells (i0, i1, ..., value) of a half-open window [(lo, hi), ...]; None reads everything.

    Cells of missing chunks have the fill value (zero without one). A grid cell that has no
    chunk row at all is missing, too: the window's chunk numbers are generated and joined.
    """
    array = m.array(path)
    window = clipped(bounds, array["shape"])
    numbers = window_chunks(m, array["shape"], array["chunks"], window)
    return decode_cells(dealt(_located(m, with_chunks(m, array, numbers, window))), array, window)


def read_points(m: Manifest, path: str, points: DataFrame) -> DataFrame:
    """Cells at the points (i0, i1, ...) of a DataFrame, one for each row; points outside are left out.

    A chunk that holds points gets the list of the different ones, which is no longer than the
    chunk has cells; it is fetched once and gives out those cells only.
    """
    array = m.array(path)
    dtype, shape, chunks = array["dtype"], list(array["shape"]), list(array["chunks"])
    counts = [-(-n // c) for n, c in zip(shape, chunks)]
    nd = len(shape)
    names = [f"i{d}" for d in range(nd)]
    at = points.select(*[F.col(n).cast("long").alias(n) for n in names])
    for n, size in zip(names, shape):
        at = at.filter(F.col(n).between(0, size - 1))
    index = [grid.quotient(F.col(n), F.lit(c)) for n, c in zip(names, chunks)]
    lin, cell = F.lit(0).cast("long"), F.lit(0).cast("long")
    for n, c, k, i in zip(names, chunks, counts, index):
        lin, cell = lin * k + i, cell * c + F.col(n) % c
    once = at.groupBy(*names).agg(F.count("*").alias("times")) if nd else at.agg(F.count("*").alias("times"))
    every = F.array(*index) if nd else F.array().cast("array<bigint>")
    need = once.select(lin.alias("chunk_lin"), every.alias("idx"), F.struct(cell.alias("cell"), "times").alias("p"))
    need = need.groupBy("chunk_lin", "idx").agg(F.collect_list("p").alias("points"))
    compressor, filters, fill = array["compressor"], array["filters"], schema.fill_of(dtype, array["fill_value"])
    fetched = fetcher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, data in fetched(batches):
            where = np.array([x["cell"] for x in r["points"]], np.int64)
            if data is None:
                values = np.full(len(where), np.zeros((), dtype) if fill is None else fill, dtype)
            else:
                values = codecs.decode_chunk(data, dtype, chunks, compressor, filters).ravel()[where]
            first = [int(i) * c for i, c in zip(np.unravel_index(r["chunk_lin"], counts) if nd else (), chunks)]
            cells = [x + a for x, a in zip(np.unravel_index(where, chunks) if nd else (), first)]
            times = pa.array([x["times"] for x in r["points"]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells] + [_values(values, dtype), times], names=[*names, "value", "times"])

    ddl = ", ".join([f"{n} bigint" for n in names] + [f"value {schema.spark_type(dtype)}", "times bigint"])
    cells = dealt(_located(m, with_chunks(m, array, need), "points")).mapInArrow(run, ddl)
    return cells.select(*names, "value", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_k")).drop("_k")


def read_layers(m: Manifest, arrays: dict[str, object], bounds=None) -> DataFrame:
    """Cells (i0, i1, ..., a column for each name) of arrays of one shape and one chunk grid,
    decoded together chunk by chunk: chunk rows meet, not cells."""
    one = next(iter(arrays.values()))
    shape, chunks = list(one["shape"]), list(one["chunks"])
    if any(list(a["shape"]) != shape or list(a["chunks"]) != chunks for a in arrays.values()):
        raise ValueError("layers that are read together have one shape and one chunk grid")
    window, counts, nd = clipped(bounds, shape), [-(-n // c) for n, c in zip(shape, chunks)], len(shape)
    numbers = window_chunks(m, shape, chunks, window)
    rows = None
    for k, a in enumerate(arrays.values()):
        own = with_chunks(m, a, numbers, window).withColumn("layer", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    # By a hash of the number: a repartition by what the union's branches seem to be partitioned by
    # already is dropped, and adaptive planning may then change the branches.
    placed = _located(m, rows, "layer").withColumn("_k", F.xxhash64("chunk_lin")).repartition("_k").sortWithinPartitions("chunk_lin", "layer").drop("_k")
    about = [(a["dtype"], a["compressor"], a["filters"], schema.fill_of(a["dtype"], a["fill_value"])) for a in arrays.values()]
    names = [f"i{d}" for d in range(nd)]
    fetched = fetcher()

    def cells(lin: int, parts: list[bytes | None]) -> pa.RecordBatch | None:
        index = [int(i) for i in np.unravel_index(lin, counts)] if nd else []
        lo = [max(i * c, w[0]) for i, c, w in zip(index, chunks, window)]
        hi = [min((i + 1) * c, w[1], n) for i, c, w, n in zip(index, chunks, window, shape)]
        if any(b <= a for a, b in zip(lo, hi)):
            return None
        cut = tuple(slice(a - i * c, b - i * c) for a, b, i, c in zip(lo, hi, index, chunks))
        columns = []
        for data, (dtype, compressor, filters, fill) in zip(parts, about):
            if data is None:
                part = np.full([b - a for a, b in zip(lo, hi)], np.zeros((), dtype) if fill is None else fill, dtype)
            else:
                part = codecs.decode_chunk(data, dtype, chunks, compressor, filters)[cut]
            columns.append(_values(part.ravel(), dtype))
        axes = np.meshgrid(*[np.arange(a, b) for a, b in zip(lo, hi)], indexing="ij") if nd else []
        return pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in axes] + columns, names=names + list(arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes | None] = []
        for r, data in fetched(batches):  # the layers of a chunk follow each other
            if r["layer"] != len(parts):
                raise AssertionError(f"layer {r['layer']} of chunk {r['chunk_lin']} in place of {len(parts)}")
            parts.append(data)
            if len(parts) == len(about):
                out = cells(r["chunk_lin"], parts)
                parts = []
                if out is not None:
                    yield out

    ddl = ", ".join([f"{n} bigint" for n in names] + [f"`{k}` {schema.spark_type(a['dtype'])}" for k, a in arrays.items()])
    return placed.mapInArrow(run, ddl)


def chunk_bytes(m: Manifest, rows: DataFrame | None = None) -> DataFrame:
    """array_path, chunk_lin and data (as encoded) of chunk rows, all by default; missing ones have none."""
    fetched = fetcher()
    kind = pa.schema([("array_path", pa.string()), ("chunk_lin", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, data in fetched(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((r["array_path"], r["chunk_lin"], data), kind)], schema=kind)

    rows = all_chunks(m) if rows is None else rows
    return dealt(_located(m, rows, "array_path")).mapInArrow(run, "array_path string, chunk_lin long, data binary")


def array_hash(m: Manifest, path: str) -> str:
    """A hash of an array's decoded cells, whatever the layout of its chunks."""
    cells = read_window(m, path)
    row = cells.agg(F.sum(F.xxhash64(*cells.columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{row['h']}:{row['n']}".encode()).hexdigest()


def encode_cells(cells: DataFrame, path: str, dtype: str, shape, chunks, fill=None, compressor: str | None = None, filters: list[str] | None = None) -> DataFrame:
    """Cells (i0, ..., value) to inline chunk rows; a chunk's absent cells get the fill value."""
    counts = [-(-n // c) for n, c in zip(shape, chunks)]
    nd = len(shape)
    lin = F.lit(0).cast("long")
    for d, (c, n) in enumerate(zip(chunks, counts)):
        lin = lin * n + F.floor(F.col(f"i{d}") / c)

    def run(key, pdf):
        import pandas as pd

        a = np.full(chunks, 0 if fill is None else fill, dtype)
        a[tuple((pdf[f"i{d}"].to_numpy() % chunks[d]) for d in range(nd))] = pdf["value"].to_numpy()
        return pd.DataFrame({"chunk_lin": [int(key[0])], "inline": [codecs.encode_chunk(a, compressor, filters)]})

    made = cells.withColumn("chunk_lin", lin).groupBy("chunk_lin").applyInPandas(run, "chunk_lin long, inline binary")
    nul = lambda t: F.lit(None).cast(t)
    return made.select(
        F.lit(path).alias("array_path"), "chunk_lin", F.lit(schema.INLINE).alias("state"), nul("long").alias("file_id"), nul("long").alias("offset"), nul("long").alias("nbytes"), "inline"
    )
