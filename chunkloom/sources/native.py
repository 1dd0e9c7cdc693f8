"""The engine's own format (Parquet tables and one JSON file), and Zarr-column manifests.

The latter keep three integer columns for all chunks of all arrays as one-dimensional Zarr v2
arrays beside a manifest.json; their dimensions are in first-fastest order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import codecs
from ..manifest import Manifest, from_rows

FORMAT = 1


def save(m: Manifest, path: str, mode: str = "errorifexists") -> None:
    """Four Parquet tables; chunk rows are sorted by array and number, so statistics prune."""
    m.files.write.mode(mode).parquet(f"{path}/files")
    m.arrays.write.mode(mode).parquet(f"{path}/arrays")
    m.chunks.repartitionByRange("array_path", "chunk_lin").sortWithinPartitions("array_path", "chunk_lin").write.mode(mode).option("compression", "zstd").parquet(f"{path}/chunks")
    head = m.spark.createDataFrame([(FORMAT, json.dumps(m.attrs), json.dumps(m.provenance))], "format_version int, attrs string, provenance string")
    head.write.mode(mode).parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Manifest:
    head = spark.read.parquet(f"{path}/manifest").first()
    if head["format_version"] != FORMAT:
        raise ValueError(f"{path}: format version {head['format_version']}; {FORMAT} is supported")
    read = lambda t, ddl: spark.read.schema(ddl).parquet(f"{path}/{t}")
    return Manifest(read("files", schema.FILES), read("arrays", schema.ARRAYS), read("chunks", schema.CHUNKS), json.loads(head["attrs"]), json.loads(head["provenance"]))


def read_zarr(path: str) -> np.ndarray:
    """A whole Zarr v2 array of a local directory."""
    with open(f"{path}/.zarray") as f:
        doc = json.load(f)
    shape, chunks = doc["shape"], doc["chunks"]
    out = np.full(shape, doc["fill_value"] or 0, doc["dtype"])
    filters = [json.dumps(x) for x in doc.get("filters") or []]
    for index in product(*[range(-(-n // c)) for n, c in zip(shape, chunks)]):
        try:
            with open(f"{path}/{doc.get('dimension_separator', '.').join(map(str, index)) or '0'}", "rb") as f:
                data = f.read()
        except FileNotFoundError:
            continue
        block = codecs.decode_chunk(data, doc["dtype"], chunks, json.dumps(doc["compressor"]) if doc["compressor"] else None, filters)
        if doc.get("order") == "F":
            block = block.reshape(chunks[::-1]).T
        at = tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(index, chunks, shape))
        out[at] = block[tuple(slice(0, s.stop - s.start) for s in at)]
    return out


def write_zarr(path: str, a: np.ndarray, chunk: int, compressor: dict | None, filters: list[dict] | None = None) -> None:
    import os

    os.makedirs(path, exist_ok=True)
    doc = {"zarr_format": 2, "shape": list(a.shape), "chunks": [chunk], "dtype": a.dtype.str, "compressor": compressor, "fill_value": 0, "order": "C", "filters": filters}
    with open(f"{path}/.zarray", "w") as f:
        json.dump(doc, f)
    for k in range(-(-len(a) // chunk)):
        part = np.zeros(chunk, a.dtype)
        own = a[k * chunk : (k + 1) * chunk]
        part[: len(own)] = own
        with open(f"{path}/{k}", "wb") as f:
            f.write(codecs.encode_chunk(part, json.dumps(compressor) if compressor else None, [json.dumps(x) for x in filters or []]))


def _column_chunk(path: str, k: int) -> np.ndarray:
    """One chunk of a one-dimensional Zarr v2 array of a folder that all executors reach."""
    with open(f"{path}/.zarray") as f:
        doc = json.load(f)
    n, (size,) = doc["shape"][0], doc["chunks"]
    count = min(size, n - k * size)
    try:
        with open(f"{path}/{k}", "rb") as f:
            data = f.read()
    except FileNotFoundError:
        return np.full(count, doc["fill_value"] or 0, doc["dtype"])
    block = codecs.decode_chunk(data, doc["dtype"], [size], json.dumps(doc["compressor"]) if doc["compressor"] else None, [json.dumps(x) for x in doc.get("filters") or []])
    return block[:count]


def _column_rows(spark: SparkSession, path: str, cells: int, size: int, spans: list[tuple[int, int, str, list[int]]]) -> DataFrame:
    """Chunk rows of the shared columns, a task reading a stretch of them; `spans` are (start, cells,
    array path, file ids by index) of the arrays in order of their starts."""
    starts = np.array([s for s, *_ in spans], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                index, offset, nbytes = (_column_chunk(f"{path}/columns/{c}", k) for c in ("index", "offset", "nbytes"))
                first = k * size
                for start, n, name, table in spans[max(0, int(np.searchsorted(starts, first, "right")) - 1) :]:
                    if start >= first + len(index):
                        break
                    lo, hi = max(start, first) - first, min(start + n, first + len(index)) - first
                    there = lo + np.flatnonzero((index[lo:hi] != schema.MISSING_INDEX) & (index[lo:hi] != schema.INLINE_INDEX))
                    if len(there):
                        ids = np.array(table, np.int64)[index[there].astype(np.int64) - 1]
                        columns = [there + first - start, ids, offset[there].astype(np.int64), nbytes[there].astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), *[pa.array(c) for c in columns]], names=["array_path", "chunk_lin", "file_id", "offset", "nbytes"])

    parts = -(-cells // size) if size else 0
    found = spark.range(parts).mapInArrow(run, "array_path string, chunk_lin long, file_id long, offset long, nbytes long")
    return found.select("array_path", "chunk_lin", F.lit(schema.VIRTUAL).alias("state"), "file_id", "offset", "nbytes", F.lit(None).cast("binary").alias("inline"))


DELTA = {"id": "delta", "dtype": "<u8", "astype": "<u8"}


def load_zarr_manifest(spark: SparkSession, path: str) -> Manifest:
    """manifest.json of format 2 (columns per array) or 3 (one set of columns, cut by `start`)."""
    with open(f"{path}/manifest.json") as f:
        doc = json.load(f)
    version = doc.get("format_version")
    if version not in (2, 3):
        raise ValueError(f"{path}: manifest format {version}; 2 and 3 are supported")
    files: list[tuple] = []
    ids: dict[str, int] = {}

    def push(table):
        own = []
        for e in table:
            if e["uri"] not in ids:
                ids[e["uri"]] = len(ids) + 1
                files.append((ids[e["uri"]], e["uri"], e.get("etag"), e.get("size"), e.get("mtime")))
            own.append(ids[e["uri"]])
        return own

    shared = push(doc.get("table", []))
    arrays, chunks, spans = [], [], []
    for a in doc["arrays"]:
        m = a["manifest"]
        table = push(a["table"]) if "table" in a else shared
        nd = len(a["shape"])
        fill = a.get("fillvalue")
        common = (
            a["path"], schema.check_dtype(a["dtype"], a["path"]), a["shape"][::-1], a["chunkshape"][::-1], (a.get("dimnames") or [f"dim_{i}" for i in range(nd)])[::-1],
            None if fill is None else fill if isinstance(fill, str) else json.dumps(fill), json.dumps(a["compressor"]) if a.get("compressor") else None,
            [json.dumps(f) for f in a.get("filters") or []] or None, json.dumps(a.get("attrs") or {}),
        )
        if m["kind"] == "affine":
            arrays.append((*common, "affine", (table[m["fileindex"] - 1], m["base"], m["strides"][::-1], m["chunkbytes"])))
            continue
        arrays.append((*common, "explicit", None))
        n = int(np.prod(m["gridsize"], dtype=np.int64))
        if version == 3:
            spans.append((m["start"], n, a["path"], table))
            index = None  # read by tasks
        else:
            index, offset, nbytes = (read_zarr(f"{path}/arrays/{m.get('dir', a['path'])}/{c}").ravel() for c in ("index", "offset", "nbytes"))
        grid = m["gridsize"]
        inline = {}
        import base64

        for key, text in (m.get("inline") or {}).items():
            at = [int(x) - 1 for x in key.split(",")]  # first dimension fastest, from 1
            inline[int(np.ravel_multi_index(at[::-1], grid[::-1]))] = base64.b64decode(text)
        chunks += [(a["path"], k, schema.INLINE, None, None, None, inline[k]) for k in sorted(inline)]
        for k in range(n if index is not None else 0):
            if k in inline:
                continue
            if index[k] not in (schema.MISSING_INDEX, schema.INLINE_INDEX):
                chunks.append((a["path"], k, schema.VIRTUAL, table[int(index[k]) - 1], int(offset[k]), int(nbytes[k]), None))
    out = from_rows(spark, files, arrays, chunks, doc.get("group_attrs") or {}, doc.get("provenance") or {})
    if not spans:
        return out
    spans.sort()
    lengths = []
    for c in ("index", "offset", "nbytes"):
        with open(f"{path}/columns/{c}/.zarray") as f:
            about = json.load(f)
        lengths.append((about["shape"][0], about["chunks"][0]))
    (cells, size), ends = lengths[0], [s + n for s, n, *_ in spans]
    if len(set(lengths)) > 1 or max(ends) > cells or any(a > b for a, (b, *_) in zip(ends, spans[1:])):
        raise ValueError(f"{path}: the columns do not have the cells that the arrays need")
    return out.with_(chunks=out.chunks.unionByName(_column_rows(spark, path, cells, size, spans)))


def save_zarr_manifest(m: Manifest, path: str, cells: int = 65536, compressor: dict | None = None) -> None:
    """Format 3. The columns are one file set by design, so they are made on the driver."""
    import base64
    import os

    compressor = compressor or {"id": "zstd", "level": 3}
    os.makedirs(path, exist_ok=True)
    table = m.files.orderBy("file_id").collect()
    at = {r["file_id"]: i + 1 for i, r in enumerate(table)}
    arrays, cols, start = [], [[], [], []], 0
    for r in m.arrays.orderBy("array_path").collect():
        grid = [-(-n // c) for n, c in zip(r["shape"], r["chunks"])]
        n = int(np.prod(grid, dtype=np.int64))
        base = {
            "path": r["array_path"], "dtype": r["dtype"], "shape": r["shape"][::-1], "chunkshape": r["chunks"][::-1], "fillvalue": r["fill_value"],
            "compressor": json.loads(r["compressor"]) if r["compressor"] else None, "filters": [json.loads(f) for f in r["filters"]] if r["filters"] else None,
            "attrs": json.loads(r["attrs"] or "{}"), "dimnames": r["dims"][::-1] if r["dims"] else None,
        }
        if r["map_kind"] == "affine":
            f = r["affine"]
            arrays.append(base | {"manifest": {"kind": "affine", "gridsize": grid[::-1], "fileindex": at[f["file_id"]], "base": f["base"], "strides": f["strides"][::-1], "chunkbytes": f["chunkbytes"]}})
            continue
        index, offset, nbytes = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
        inline = {}
        for c in m.chunks.filter(m.chunks["array_path"] == r["array_path"]).toLocalIterator():
            k = c["chunk_lin"]
            if c["state"] == schema.VIRTUAL:
                index[k], offset[k], nbytes[k] = at[c["file_id"]], c["offset"], c["nbytes"]
            elif c["state"] == schema.INLINE:
                index[k], nbytes[k] = schema.INLINE_INDEX, len(c["inline"])
                key = ",".join(str(int(x) + 1) for x in np.unravel_index(k, grid)[::-1])
                inline[key] = base64.b64encode(bytes(c["inline"])).decode()
        for col, v in zip(cols, (index, offset, nbytes)):
            col.append(v)
        arrays.append(base | {"manifest": {"kind": "chunk", "gridsize": grid[::-1], "start": start, "inline": inline}})
        start += n
    if start:
        for name, parts, f in zip(("index", "offset", "nbytes"), cols, (None, [DELTA], None)):
            write_zarr(f"{path}/columns/{name}", np.concatenate(parts), min(cells, start), compressor, f)
    doc = {"format_version": 3, "group_attrs": m.attrs, "provenance": m.provenance, "table": [{k: r[k] for k in ("uri", "etag", "size", "mtime")} for r in table], "arrays": arrays}
    with open(f"{path}/manifest.json", "w") as f:
        json.dump(doc, f)
