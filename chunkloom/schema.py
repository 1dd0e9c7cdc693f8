"""Schemas of the manifest's tables and the element types of arrays."""

from __future__ import annotations

import re

import numpy as np

FILES = "file_id long, uri string, etag string, size long, mtime double"
ARRAYS = (
    "array_path string, dtype string, shape array<long>, chunks array<long>, dims array<string>, fill_value string, compressor string, "
    "filters array<string>, attrs string, map_kind string, affine struct<file_id:long,base:long,strides:array<long>,chunkbytes:long>"
)
CHUNKS = "array_path string, chunk_lin long, state string, file_id long, offset long, nbytes long, inline binary"

MISSING, INLINE, VIRTUAL = "missing", "inline", "virtual"
#: Fixed values of the saved formats: the file index of a missing and of an inline chunk, and
#: the length that means a whole object.
MISSING_INDEX, INLINE_INDEX, WHOLE_OBJECT = 0, 2**32 - 1, 2**63 - 1

#: Numpy type strings of the array elements and the Spark types that hold them.
SPARK_TYPES = {
    "|b1": "boolean", "|i1": "tinyint", "<i2": "smallint", "<i4": "int", "<i8": "bigint", "|u1": "smallint", "<u2": "int", "<u4": "bigint",
    "<u8": "decimal(20,0)", "<f2": "float", "<f4": "float", "<f8": "double", "<c8": "struct<re:float,im:float>", "<c16": "struct<re:double,im:double>",
}


class UnsupportedType(ValueError):
    pass


def check_dtype(dtype: str, where: str = "") -> str:
    """A supported type string, in its usual spelling; big-endian and compound types are refused by name."""
    if re.fullmatch(r"\|S[1-9][0-9]*", dtype):
        return dtype
    if dtype.startswith(">") and dtype[1:] not in ("i1", "u1", "b1"):
        raise UnsupportedType(f"{where}: big-endian elements ({dtype}) are not supported")
    d = np.dtype(dtype)
    if d.itemsize == 1 and d.kind in "iub":
        return "|" + d.str[1:]
    if d.str not in SPARK_TYPES:
        raise UnsupportedType(f"{where}: elements of type {dtype} are not supported")
    return d.str


def spark_type(dtype: str) -> str:
    return "string" if dtype.startswith("|S") else SPARK_TYPES[check_dtype(dtype)]


def fill_of(dtype: str, fill: str | None):
    """The fill value's JSON spelling as a numpy scalar; None without one."""
    if fill is None:
        return None
    d = np.dtype(dtype)
    if d.kind == "S":
        return np.bytes_(fill.encode())
    if d.kind == "f":
        return d.type({"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(fill, fill))
    if d.kind == "c":
        import json

        re_, im = json.loads(fill)
        return d.type(complex(float(re_), float(im)))
    if d.kind == "b":
        return np.bool_(str(fill).lower() in ("true", "1"))
    return d.type(int(float(fill)) if "." in fill or "e" in fill.lower() else int(fill))
