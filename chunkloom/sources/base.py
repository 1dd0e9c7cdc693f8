"""Scanning: a parser per format turns a file's metadata into array and chunk rows.

A parser gets a reader and options and yields Array objects. Files are dealt out one to a
task; the rows are kept, so that the manifest's three tables come from one pass.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..manifest import Manifest


class FormatError(ValueError):
    """A file that cannot be scanned; says which file and why."""


#: Ways to a file's metadata: by ranges, by ranges of local files only, by reading all of it
#: first, or by ranges where the size can be asked and all of it where not.
ACCESS = ("auto", "local", "range", "download")


class Reader:
    """Byte ranges of one file through a block cache, so that a parser may seek freely. Blocks
    leave the cache in the order they came."""

    def __init__(self, uri: str, block: int = 256 << 10, keep: int = 64, access=None, mode: str = "auto"):
        from ..plans import fetch

        if mode not in ACCESS:
            raise ValueError(f"access={mode!r}; there are {', '.join(ACCESS)}")
        if mode == "local" and "://" in uri and not uri.startswith("file://"):
            raise ValueError(f"{uri} is not local")
        access = access or fetch.current()
        self.uri, self.block, self.keep, self.access = uri, block, keep, access
        size = access.size(uri)
        if size is None:
            raise FileNotFoundError(uri)
        self.size = size
        self._blocks: dict[int, bytes] = {}
        self.bytes_read = self.requests = 0
        if mode == "download":
            self.block, self.keep = max(1, size), 1

    def _schedule(self, offset: int, n: int) -> None:
        """Have the blocks of a range in the cache; runs of missing ones are read together."""
        first, last = offset // self.block, (offset + max(n, 1) - 1) // self.block
        plan, k = [], first
        while k <= last:
            if k in self._blocks:
                k += 1
                continue
            end = k
            while end < last and end + 1 not in self._blocks:
                end += 1
            plan.append((k, end))
            k = end + 1
        spans = [(a * self.block, min((b + 1) * self.block, self.size) - a * self.block) for a, b in plan]
        spans = [s for s in spans if s[1] > 0]
        for (a, b), data in zip(plan, self.access.blocks(self.uri, spans)):
            self.requests, self.bytes_read = self.requests + 1, self.bytes_read + len(data)
            for j in range(a, b + 1):
                self._blocks[j] = data[(j - a) * self.block : (j - a + 1) * self.block]

    def prefetch(self, ranges: Iterable[tuple[int, int]], most: int = 16) -> None:
        """Ask for the blocks of several places at once, as far as the cache has room: a parser that
        knows where it goes next saves the waits between."""
        wanted = sorted({k for o, n in ranges if 0 <= o < self.size for k in range(o // self.block, (min(o + max(n, 1), self.size) - 1) // self.block + 1)} - self._blocks.keys())
        wanted = wanted[: min(most, self.keep // 2)]
        spans = [(k * self.block, min((k + 1) * self.block, self.size) - k * self.block) for k in wanted]
        for k, data in zip(wanted, self.access.blocks(self.uri, spans)):
            self.requests, self.bytes_read = self.requests + 1, self.bytes_read + len(data)
            self._blocks[k] = data

    def at(self, offset: int, n: int) -> bytes:
        if n < 0 or offset < 0 or offset + n > self.size:
            raise FormatError(f"{self.uri}: {n} bytes at {offset} lie beyond the file")
        if not n:
            return b""
        first, last = offset // self.block, (offset + n - 1) // self.block
        self._schedule(offset, n)
        out = b"".join(self._blocks[j] for j in range(first, last + 1))
        while len(self._blocks) > self.keep:
            del self._blocks[next(iter(self._blocks))]
        return out[offset - first * self.block : offset - first * self.block + n]


@dataclass
class Group:
    """A group's attributes, for parsers of formats that have them."""

    path: str
    attrs: dict


@dataclass
class Array:
    path: str
    dtype: str
    shape: list[int]
    chunks: list[int]
    dims: list[str] | None = None
    fill: object = None
    compressor: dict | None = None
    filters: list[dict] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    affine: tuple[int, list[int], int] | None = None  # base, strides, chunk bytes
    places: Iterable[tuple[int, int, int]] = ()  # chunk number, offset, length
    inline: dict[int, bytes] = field(default_factory=dict)


def fill_text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        return "NaN" if v != v else "Infinity" if v == np.inf else "-Infinity" if v == -np.inf else repr(float(v))
    if isinstance(v, (complex, np.complexfloating)):
        return json.dumps([float(v.real), float(v.imag)])
    return str(v)


def finite(attrs: dict) -> dict:
    """Attributes that JSON can spell; others are left out with a warning."""
    ok = lambda v: not (isinstance(v, float) and (v != v or v in (np.inf, -np.inf)))
    kept = {k: v for k, v in attrs.items() if ok(v) and (not isinstance(v, list) or all(map(ok, v)))}
    if len(kept) < len(attrs):
        warnings.warn(f"attributes that are not finite were left out: {', '.join(sorted(attrs.keys() - kept.keys()))}", stacklevel=2)
    return kept


def inline_array(path: str, values: np.ndarray, dims: list[str], attrs: dict | None = None) -> Array:
    """A small array whose bytes are in the manifest: one chunk."""
    return Array(path, values.dtype.str if values.dtype.itemsize > 1 else "|" + values.dtype.str[1:], list(values.shape), [max(1, n) for n in values.shape], dims, attrs=attrs or {}, inline={0: values.tobytes()})


_FIELDS = [
    ("ord", pa.int64(), "long"), ("kind", pa.string(), "string"), ("uri", pa.string(), "string"), ("size", pa.int64(), "long"), ("array_path", pa.string(), "string"), ("dtype", pa.string(), "string"),
    ("shape", pa.list_(pa.int64()), "array<long>"), ("chunks", pa.list_(pa.int64()), "array<long>"), ("dims", pa.list_(pa.string()), "array<string>"), ("fill_value", pa.string(), "string"),
    ("compressor", pa.string(), "string"), ("filters", pa.list_(pa.string()), "array<string>"), ("attrs", pa.string(), "string"), ("base", pa.int64(), "long"), ("strides", pa.list_(pa.int64()), "array<long>"),
    ("chunkbytes", pa.int64(), "long"), ("chunk_lin", pa.int64(), "long"), ("state", pa.string(), "string"), ("offset", pa.int64(), "long"), ("nbytes", pa.int64(), "long"), ("inline", pa.binary(), "binary"),
]
ROW_SCHEMA = pa.schema([(n, t) for n, t, _ in _FIELDS])
ROW_DDL = ", ".join(f"{n} {s}" for n, _, s in _FIELDS)

Parser = Callable[[Reader, dict], Iterator["Array | Group"]]
_DRIVERS: dict[str, tuple[str, Parser]] = {}
_EXTENSIONS: dict[str, str] = {}


def register_driver(name: str, parser: Parser, extensions: Iterable[str] = ()) -> None:
    """A parser for a format, and the file extensions that stand for it (dot optional, any case)."""
    _DRIVERS[name] = (name, parser)
    for e in extensions:
        e = e.lower().lstrip(".")
        if not e:
            raise ValueError("an extension may not be empty")
        _EXTENSIONS[e] = name


def driver_for(path: str) -> str:
    clean = re.sub(r"[?#].*", "", path) if "://" in path else path
    ext = clean.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ext not in _EXTENSIONS:
        raise FormatError(f"{path}: no driver for .{ext}; there are drivers for {', '.join(sorted(_EXTENSIONS))}")
    return _EXTENSIONS[ext]


def stem(uri: str) -> str:
    name = re.sub(r"[?#].*", "", uri).rstrip("/").rsplit("/", 1)[-1]
    return name.rpartition(".")[0] or name


def rows_of(uri: str, order: int, parser: Parser, options: dict, access=None) -> Iterator[dict]:
    """Option access: one of ACCESS; all others are the parser's. The last row tells the scan's cost."""
    options = dict(options)
    reader = Reader(uri, access=access, mode=options.pop("access", "auto"))
    yield {"ord": order, "kind": "file", "uri": uri, "size": reader.size}
    named: set[str] = set()
    for a in parser(reader, options):
        if isinstance(a, Group):
            yield {"ord": order, "kind": "group", "uri": uri, "array_path": a.path, "attrs": json.dumps(finite(a.attrs))}
            continue
        path = a.path or stem(uri)  # a root array is known by its file's name
        if path in named or (named and not a.path):
            raise FormatError(f"{uri}: an array at the root beside others")
        named.add(path)
        codec = json.dumps(a.compressor) if a.compressor else None
        base, strides, size = a.affine or (None, None, None)
        yield {
            "ord": order, "kind": "array", "uri": uri, "array_path": path, "dtype": schema.check_dtype(a.dtype, f"{uri}: {path}"), "shape": a.shape, "chunks": a.chunks,
            "dims": a.dims if a.dims is not None else [f"dim_{i}" for i in range(len(a.shape))], "fill_value": fill_text(a.fill), "compressor": codec,
            "filters": [json.dumps(f) for f in a.filters] or None, "attrs": json.dumps(finite(a.attrs)), "base": base, "strides": strides, "chunkbytes": size,
        }
        for lin, offset, nbytes in a.places:
            yield {"ord": order, "kind": "chunk", "uri": uri, "array_path": path, "chunk_lin": lin, "state": schema.VIRTUAL, "offset": offset, "nbytes": nbytes}
        for lin, data in a.inline.items():
            yield {"ord": order, "kind": "chunk", "uri": uri, "array_path": path, "chunk_lin": lin, "state": schema.INLINE, "inline": data}
    yield {"ord": order, "kind": "cost", "uri": uri, "offset": reader.requests, "nbytes": reader.bytes_read}


def _batches(rows: Iterator[dict], size: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=ROW_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ROW_SCHEMA)


def scan_rows(spark: SparkSession, paths: list[str], driver: str | None = None, **options) -> DataFrame:
    """Metadata rows of all files, a task for each."""
    todo = [(i, p, driver or driver_for(p)) for i, p in enumerate(paths)]
    from ..plans import fetch

    table, access = dict(_DRIVERS), fetch.current()

    def run(batches):
        for b in batches:
            for order, uri, name in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield from _batches(rows_of(uri, order, table[name][1], options, access))

    src = spark.createDataFrame(todo, "ord long, uri string, driver string").repartition(len(todo), "ord")
    return src.mapInArrow(run, ROW_DDL)


def scan_cost(rows: DataFrame) -> DataFrame:
    """Requests and bytes that each file's scan took."""
    return rows.filter("kind = 'cost'").select("ord", "uri", F.col("offset").alias("requests"), F.col("nbytes").alias("bytes_read"))


def root_attrs(rows: DataFrame) -> dict[int, dict]:
    """The root groups' attributes by file (one small row a file)."""
    return {r["ord"]: json.loads(r["attrs"]) for r in rows.filter("kind = 'group' and array_path = ''").select("ord", "attrs").collect()}


def tables_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, arrays and chunks of scanned rows, each with its member (the file's place in the list)."""
    f = rows.filter("kind = 'file'")
    member = F.col("ord").cast("int").alias("member")
    files = f.select(member, (F.col("ord") + 1).alias("file_id"), "uri", F.lit(None).cast("string").alias("etag"), "size", F.lit(None).cast("double").alias("mtime"))
    a = rows.filter("kind = 'array'")
    affine = F.when(F.col("base").isNotNull(), F.struct((F.col("ord") + 1).alias("file_id"), "base", "strides", "chunkbytes"))
    arrays = a.select(member, "array_path", "dtype", "shape", "chunks", "dims", "fill_value", "compressor", "filters", "attrs", F.when(F.col("base").isNull(), "explicit").otherwise("affine").alias("map_kind"), affine.alias("affine"))
    c = rows.filter("kind = 'chunk'")
    chunks = c.select(member, "array_path", "chunk_lin", "state", F.when(F.col("state") == schema.VIRTUAL, F.col("ord") + 1).alias("file_id"), "offset", "nbytes", "inline")
    return files, arrays, chunks


def manifest_of(rows: DataFrame, attrs: dict | None = None, provenance: dict | None = None, held: tuple = ()) -> Manifest:
    """The manifest of one file's scanned rows."""
    files, arrays, chunks = (t.drop("member") for t in tables_of(rows))
    return Manifest(files, arrays, chunks, attrs or {}, provenance or {}, held)
