"""HDF5 and NetCDF-4 metadata, from the public file format specification.

Read: superblocks 0 to 3, object headers 1 and 2, groups by symbol table, compact or dense
links, contiguous and chunked layouts (every chunk index), the filter pipeline, compact and
dense attributes, dimension scales, variable-length strings. Anything else is refused by name.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions import codecs
from . import h5index
from .base import Array, FormatError, Group, Reader, register_driver

MAGIC = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 2**64 - 1
#: Filter ids and the codecs they stand for.
REFUSED_FILTERS = {4: "szip", 5: "nbit", 6: "scaleoffset", 32000: "lzf", 32004: "lz4", 32008: "bitshuffle"}
NEWER_INDEX = {3: "fixed array", 4: "extensible array", 5: "btree2"}
BLOSC_NAMES = {0: "blosclz", 1: "lz4", 2: "lz4hc", 3: "snappy", 4: "zlib", 5: "zstd"}
#: Bytes of what a layout message says about each of them before the index's address.
ABOUT_INDEX = {3: 1, 4: 5, 5: 6}
BOOKKEEPING = {"DIMENSION_LIST", "REFERENCE_LIST", "CLASS", "NAME", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_NCProperties", "_nc3_strict"}


@dataclass
class Type:
    kind: int
    size: int
    dtype: str | None  # numpy type string of what can be stored; None otherwise
    vlen_string: bool = False
    big: bool = False


@dataclass
class Object:
    address: int
    space: list[int] | None = None
    most: list[int] | None = None  # the largest extents; UNDEFINED is unlimited
    type: Type | None = None
    layout: tuple | None = None
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    fill: bytes | None = None
    attrs: dict = field(default_factory=dict)
    links: dict[str, int] = field(default_factory=dict)
    is_group: bool = False


class File:
    def __init__(self, r: Reader):
        self.r = r
        head = r.at(0, min(r.size, 8))
        if head[:3] == b"CDF":
            raise FormatError(f"{r.uri}: a classic NetCDF file, which is not HDF5")
        at = 0
        while r.at(at, 8) != MAGIC:
            at = at * 2 or 512
            if at + 8 > r.size:
                raise FormatError(f"{r.uri}: no HDF5 signature")
        version = r.at(at + 8, 1)[0]
        if version in (0, 1):
            so, sl = r.at(at + 13, 2)
            p = at + (24 if version == 0 else 28)
            self.base = self._u(p, so)
            entry = p + 4 * so
            self._sizes(so, sl)
            self.root = self._u(entry + so, so)
        elif version in (2, 3):
            so, sl = r.at(at + 9, 2)
            self._sizes(so, sl)
            self.base = self._u(at + 12, so)
            self.root = self._u(at + 12 + 3 * so, so)
        else:
            raise FormatError(f"{r.uri}: superblock version {version} is not supported")
        self._cache: dict[int, Object] = {}

    def _sizes(self, so: int, sl: int) -> None:
        if so != 8 or sl != 8:
            raise FormatError(f"{self.r.uri}: offsets of {so} and lengths of {sl} bytes are not supported")

    def _u(self, at: int, n: int) -> int:
        return int.from_bytes(self.r.at(at, n), "little")

    def at(self, address: int, n: int) -> bytes:
        return self.r.at(self.base + address, n)

    # --- object headers

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self.at(address, 16)
        if head[:4] == b"OHDR":
            flags, p = head[5], address + 6
            p += 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            n = int.from_bytes(self.at(p, width), "little")
            blocks, extra = [(p + width, n)], 2 * bool(flags & 4)
            while blocks:
                start, n = blocks.pop(0)
                data, q = self.at(start, n), 0
                while q + 4 + extra <= len(data):
                    kind, size = data[q], int.from_bytes(data[q + 1 : q + 3], "little")
                    body = data[q + 4 + extra : q + 4 + extra + size]
                    if kind == 0x10:
                        where, length = struct.unpack("<QQ", body[:16])
                        blocks.append((where + 4, length - 8))
                    else:
                        yield kind, body
                    q += 4 + extra + size
            return
        if head[0] != 1:
            raise FormatError(f"{self.r.uri}: object header version {head[0]} at {address}")
        count, _, size = struct.unpack_from("<HII", head, 2)
        blocks = [(address + 16, size)]
        while blocks and count > 0:
            start, n = blocks.pop(0)
            data, q = self.at(start, n), 0
            while q + 8 <= len(data) and count > 0:
                kind, size = struct.unpack_from("<HH", data, q)
                body = data[q + 8 : q + 8 + size]
                if kind == 0x10:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                else:
                    yield kind, body
                q += 8 + size
                count -= 1

    def object(self, address: int) -> Object:
        if address in self._cache:
            return self._cache[address]
        o = self._cache[address] = Object(address)
        attrs = []
        for kind, b in self._messages(address):
            if kind == 0x01:
                o.space, o.most = self._space(b), self._most(b)
            elif kind == 0x03:
                o.type = self._type(b)[0]
            elif kind == 0x05:
                o.fill = self._fill(b)
            elif kind == 0x04 and o.fill is None and len(b) > 4:
                o.fill = b[4 : 4 + struct.unpack_from("<I", b)[0]] or None
            elif kind == 0x06:
                o.is_group = True
                name, where = self._link(b)
                if where is not None:
                    o.links[name] = where
            elif kind == 0x02:
                o.is_group = True
                at = 2 + 8 * bool(b[1] & 1)
                heap, tree = struct.unpack_from("<QQ", b, at)
                for body in self._dense(heap, tree, 4):
                    name, where = self._link(body)
                    if where is not None:
                        o.links[name] = where
            elif kind == 0x08:
                o.layout = self._layout(b)
            elif kind == 0x0B:
                o.filters = self._filters(b)
            elif kind == 0x0C:
                attrs.append(b)
            elif kind == 0x15:
                at = 2 + 2 * bool(b[1] & 1)
                heap, tree = struct.unpack_from("<QQ", b, at)
                attrs += self._dense(heap, tree, 0)
            elif kind == 0x11:
                o.is_group = True
                tree, heap = struct.unpack("<QQ", b[:16])
                o.links |= dict(self._symbols(tree, heap))
        for b in attrs:
            name, value = self._attribute(b)
            o.attrs[name] = value
        return o

    def _dense(self, heap: int, tree: int, key: int) -> list[bytes]:
        """Messages in a fractal heap, listed by a B-tree whose records hold heap ids from byte `key` on."""
        if heap == UNDEFINED:
            return []
        try:
            h = h5index.Heap(self.at, heap)
            ids = [r[key : key + (7 if key else 8)] for r in h5index.records(self.at, tree)]
            return [h.get(i) for i in ids]
        except FormatError as e:
            raise FormatError(f"{self.r.uri}: {e}") from e

    @staticmethod
    def _most(b: bytes) -> list[int] | None:
        version, rank, flags = b[0], b[1], b[2]
        if (version == 2 and b[3] == 2) or not rank:
            return None
        p = (8 if version == 1 else 4) + (8 * rank if flags & 1 else 0)
        return list(struct.unpack_from(f"<{rank}Q", b, p))

    @staticmethod
    def _space(b: bytes) -> list[int] | None:
        version, rank, flags = b[0], b[1], b[2]
        if version == 2 and b[3] == 2:
            return None
        p = 8 if version == 1 else 4
        return list(struct.unpack_from(f"<{rank}Q", b, p))

    def _type(self, b: bytes) -> tuple[Type, int]:
        kind, version = b[0] & 15, b[0] >> 4
        bits, size = int.from_bytes(b[1:4], "little"), struct.unpack_from("<I", b, 4)[0]
        big = bool(bits & 1) and size > 1
        if kind == 0:
            return Type(kind, size, f"{'>' if big else '|' if size == 1 else '<'}{'i' if bits & 8 else 'u'}{size}", big=big), 12
        if kind == 1:
            return Type(kind, size, f"{'>' if big else '<'}f{size}" if size in (2, 4, 8) else None, big=big), 20
        if kind == 3:
            return Type(kind, size, f"|S{size}"), 8
        if kind == 8:
            base, n = self._type(b[8:])
            return Type(kind, size, base.dtype, big=base.big), 8 + n
        if kind == 9:
            return Type(kind, size, None, vlen_string=bits & 15 == 1), 8
        if kind == 6:
            return Type(kind, size, self._complex(b, bits & 0xFFFF, version, size)), len(b)
        return Type(kind, size, None), 8

    def _complex(self, b: bytes, n: int, version: int, size: int) -> str | None:
        """A pair of equal little-endian floats named r and i is a complex number."""
        if n != 2:
            return None
        p, found = 8, []
        for _ in range(2):
            end = b.index(b"\0", p)
            name = b[p:end]
            p = p + (len(name) // 8 + 1) * 8 if version < 3 else end + 1
            width = 4 if version < 3 else (size.bit_length() + 7) // 8
            p += width + (28 if version == 1 else 0)
            t, used = self._type(b[p:])
            p += used
            found.append((name, t.dtype))
        if found[0][1] == found[1][1] in ("<f4", "<f8") and [f[0] for f in found] == [b"r", b"i"]:
            return f"<c{size}"
        return None

    @staticmethod
    def _fill(b: bytes) -> bytes | None:
        if b[0] in (1, 2):
            if b[0] == 2 and not b[3]:
                return None
            (n,) = struct.unpack_from("<i", b, 4)
            return b[8 : 8 + n] if n > 0 else None
        if b[0] == 3 and b[1] & 0x20:
            (n,) = struct.unpack_from("<I", b, 2)
            return b[6 : 6 + n] or None
        return None

    def _link(self, b: bytes) -> tuple[str, int | None]:
        flags, p, kind = b[1], 2, 0
        if flags & 8:
            kind, p = b[p], p + 1
        p += 8 * bool(flags & 4) + bool(flags & 16)
        width = 1 << (flags & 3)
        n = int.from_bytes(b[p : p + width], "little")
        name = b[p + width : p + width + n].decode()
        return name, struct.unpack_from("<Q", b, p + width + n)[0] if kind == 0 else None

    def _symbols(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        names = struct.unpack("<Q", self.at(heap + 24, 8))[0]
        todo = [tree]
        while todo:
            node = todo.pop()
            head = self.at(node, 8)
            if head[:4] == b"SNOD":
                n = struct.unpack_from("<H", head, 6)[0]
                data = self.at(node + 8, 40 * n)
                for i in range(n):
                    name, address, cache = struct.unpack_from("<QQI", data, 40 * i)
                    if cache != 2:  # a soft link points nowhere here
                        yield self._text(names + name), address
                continue
            if head[:4] != b"TREE":
                raise FormatError(f"{self.r.uri}: no group node at {node}")
            n = struct.unpack_from("<H", head, 6)[0]
            data = self.at(node + 24, 16 * n + 8)
            todo += [struct.unpack_from("<Q", data, 16 * i + 8)[0] for i in range(n)]

    def _text(self, address: int) -> str:
        out = b""
        while b"\0" not in out:
            left = self.r.size - self.base - address - len(out)
            if left <= 0:
                raise FormatError(f"{self.r.uri}: a name without end")
            out += self.at(address + len(out), min(64, left))
        return out.split(b"\0")[0].decode()

    def _layout(self, b: bytes) -> tuple:
        version = b[0]
        if version == 3:
            kind = b[1]
            if kind == 0:
                return ("compact",)
            if kind == 1:
                return ("contiguous", *struct.unpack_from("<QQ", b, 2))
            nd = b[2]
            (tree,) = struct.unpack_from("<Q", b, 3)
            return ("btree", tree, list(struct.unpack_from(f"<{nd}I", b, 11)))
        if version == 4:
            kind = b[1]
            if kind == 0:
                return ("compact",)
            if kind == 1:
                return ("contiguous", *struct.unpack_from("<QQ", b, 2))
            if kind == 3:
                return ("virtual",)
            flags, nd, width = b[2], b[3], b[4]
            dims = [int.from_bytes(b[5 + i * width : 5 + (i + 1) * width], "little") for i in range(nd)]
            p = 5 + nd * width
            index = b[p]
            p += 1
            if index == 1:
                size = None
                if flags & 2:
                    size, _ = struct.unpack_from("<QI", b, p)
                    p += 12
                return ("single", struct.unpack_from("<Q", b, p)[0], dims, size)
            if index == 2:
                return ("implicit", struct.unpack_from("<Q", b, p)[0], dims)
            if index in NEWER_INDEX:
                return (NEWER_INDEX[index], struct.unpack_from("<Q", b, p + ABOUT_INDEX[index])[0], dims)
            return ("newer", f"index type {index}")
        return ("newer", f"layout version {version}")

    @staticmethod
    def _filters(b: bytes) -> list[tuple[int, list[int]]]:
        version, n = b[0], b[1]
        p, out = (8 if version == 1 else 2), []
        for _ in range(n):
            (fid,) = struct.unpack_from("<H", b, p)
            p += 2
            named = 0
            if version == 1 or fid >= 256:
                (named,) = struct.unpack_from("<H", b, p)
                p += 2
            _, count = struct.unpack_from("<HH", b, p)
            p += 4 + (named + (-named % 8 if version == 1 else 0))
            out.append((fid, list(struct.unpack_from(f"<{count}I", b, p))))
            p += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    # --- values

    def _heap_object(self, collection: int, index: int) -> bytes:
        head = self.at(collection, 16)
        if head[:4] != b"GCOL":
            raise FormatError(f"{self.r.uri}: no global heap at {collection}")
        size = struct.unpack_from("<Q", head, 8)[0]
        data, p = self.at(collection, size), 16
        while p + 16 <= size:
            i, _, n = struct.unpack_from("<HHxxxxQ", data, p)
            if i == index:
                return data[p + 16 : p + 16 + n]
            if i == 0:
                break
            p += 16 + n + (-n % 8)
        raise FormatError(f"{self.r.uri}: no object {index} in the heap at {collection}")

    def vlen(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        for p in range(0, len(raw) - 15, 16):
            n, where, index = struct.unpack_from("<IQI", raw, p)
            yield n, self._heap_object(where, index) if n and where not in (0, UNDEFINED) else b""

    def _attribute(self, b: bytes) -> tuple[str, object]:
        version = b[0]
        ln, lt, ls = struct.unpack_from("<HHH", b, 2)
        p = 9 if version == 3 else 8
        pad = (lambda n: n + (-n % 8)) if version == 1 else (lambda n: n)
        name = b[p : p + ln].split(b"\0")[0].decode()
        p += pad(ln)
        raw_type, p = b[p : p + lt], p + pad(lt)
        space, p = self._space(b[p : p + ls]), p + pad(ls)
        t, _ = self._type(raw_type)
        n = int(np.prod(space, dtype=np.int64)) if space else 1
        raw = b[p : p + n * t.size]
        if space is None:
            return name, None
        if t.vlen_string:
            v = [x[:k].split(b"\0")[0].decode("utf-8", "replace") for k, x in self.vlen(raw)]
        elif t.kind == 3:
            v = [raw[i * t.size : (i + 1) * t.size].split(b"\0")[0].decode("utf-8", "replace") for i in range(n)]
        elif t.kind == 7:
            v = [int.from_bytes(raw[i : i + 8], "little") for i in range(0, n * t.size, t.size)]
        elif t.kind == 9:
            v = [[int.from_bytes(x[8 * i : 8 * i + 8], "little") for i in range(k)] for k, x in self.vlen(raw)]
        elif t.dtype:
            v = np.frombuffer(raw, t.dtype, n).tolist()
        else:
            return name, None
        return name, v if space else v[0]

    # --- chunks

    def btree_chunks(self, tree: int, chunks: list[int], shape: list[int], where: str) -> Iterator[tuple[int, int, int]]:
        nd = len(shape)
        counts = [-(-n // c) for n, c in zip(shape, chunks)]
        key = 8 + 8 * (nd + 1)
        todo = [tree] if tree != UNDEFINED else []
        while todo:
            node = todo.pop()
            head = self.at(node, 24)
            if head[:4] != b"TREE" or head[4] != 1:
                raise FormatError(f"{self.r.uri}: {where}: no chunk node at {node}")
            level, n = head[5], struct.unpack_from("<H", head, 6)[0]
            data = self.at(node + 24, n * (key + 8))
            if level:
                self.r.prefetch((self.base + struct.unpack_from("<Q", data, i * (key + 8) + key)[0], 24 + n * (key + 8)) for i in range(n))
            for i in range(n):
                p = i * (key + 8)
                size, mask = struct.unpack_from("<II", data, p)
                (child,) = struct.unpack_from("<Q", data, p + key)
                if level:
                    todo.append(child)
                    continue
                if mask:
                    raise FormatError(f"{self.r.uri}: {where}: a chunk that skips filters (mask {mask})")
                lin = 0
                for d, offset in enumerate(struct.unpack_from(f"<{nd}Q", data, p + 8)):
                    lin = lin * counts[d] + offset // chunks[d]
                yield lin, self.base + child, size


    def indexed_chunks(self, kind: str, address: int, chunks: list[int], o: Object, where: str) -> Iterator[tuple[int, int, int]]:
        """(chunk number, offset, size) by one of the newer chunk indexes."""
        shape, filtered = o.space, bool(o.filters)
        counts = [-(-n // c) for n, c in zip(shape, chunks)]
        plain = o.type.size * int(np.prod(chunks, dtype=np.int64))
        try:
            if kind == "btree2":
                found = h5index.tree_chunks(self.at, address, len(shape), filtered)
            else:
                array = h5index.fixed_array if kind == "fixed array" else h5index.extensible_array
                most = o.most or shape
                found = ((h5index.grid_index(i, shape, most, chunks), *rest) for i, *rest in array(self.at, address))
            for index, place, size, mask in found:
                if any(i >= n for i, n in zip(index, counts)):
                    continue  # beyond what the dataset holds now
                if mask:
                    raise FormatError(f"{where}: a chunk that skips filters (mask {mask})")
                lin = 0
                for i, n in zip(index, counts):
                    lin = lin * n + i
                yield lin, self.base + place, plain if size is None else size
        except FormatError as e:
            raise FormatError(f"{self.r.uri}: {where}: {e}") from e


def _codecs(filters: list[tuple[int, list[int]]], size: int, where: str) -> tuple[dict | None, list[dict]]:
    """Byte filters in their order; a deflate or zstd that comes last is the compressor."""
    out = []
    for fid, cd in filters:
        if fid == 1:
            out.append({"id": "zlib", "level": cd[0] if cd else 6})
        elif fid == 2:
            out.append({"id": "shuffle", "elementsize": cd[0] if cd else size})
        elif fid == 3:
            out.append({"id": "fletcher32"})
        elif fid == 32001:
            out.append({"id": "blosc", "cname": BLOSC_NAMES.get(cd[6] if len(cd) > 6 else 0, "blosclz"), "clevel": cd[4] if len(cd) > 4 else 5, "shuffle": cd[5] if len(cd) > 5 else 1})
        elif fid == 32015:
            out.append({"id": "zstd", "level": cd[0] if cd else 3})
        else:
            raise FormatError(f"{where}: filter {REFUSED_FILTERS.get(fid, fid)} is not supported")
    if out and out[-1]["id"] in ("zlib", "zstd", "blosc"):
        return out[-1], out[:-1]
    return None, out


def _dims(f: File, o: Object, names: dict[int, str], path: str) -> list[str]:
    n = len(o.space or [])
    refs = o.attrs.get("DIMENSION_LIST")
    if isinstance(refs, list) and len(refs) == n and all(r and r[0] in names for r in refs):
        return [names[r[0]] for r in refs]
    if o.attrs.get("CLASS") == "DIMENSION_SCALE" and n == 1:
        return [path.rpartition("/")[2]]
    return [f"dim_{i}" for i in range(n)]


def _array(f: File, o: Object, path: str, names: dict[int, str]) -> Array | None:
    where, t, shape = f"{f.r.uri}: {path}", o.type, o.space
    if shape is None or t is None or o.layout is None:
        return None
    attrs = {k: v for k, v in o.attrs.items() if k not in BOOKKEEPING and v is not None}
    dims = _dims(f, o, names, path)
    if t.vlen_string:
        if o.layout[0] == "contiguous":
            raw = f.at(o.layout[1], int(np.prod(shape, dtype=np.int64)) * 16) if o.layout[1] != UNDEFINED else b""
        else:
            raw = _references(f, o, path)
        texts = [x[:k] for k, x in f.vlen(raw)] or [b""] * int(np.prod(shape, dtype=np.int64))
        size = max(1, *map(len, texts)) if texts else 1
        return Array(path, f"|S{size}", shape, [max(1, n) for n in shape], dims, None, None, [], attrs, None, (), {0: b"".join(x.ljust(size, b"\0") for x in texts)})
    if t.big:
        raise FormatError(f"{where}: big-endian elements are not supported")
    if t.dtype is None:
        raise FormatError(f"{where}: elements of class {t.kind} are not supported")
    fill = None
    if o.fill is not None and t.kind != 3 and len(o.fill) == t.size:
        fill = np.frombuffer(o.fill, t.dtype)[0].item()
    codec, filters = _codecs(o.filters, t.size, where)
    return _placed(f, o, Array(path, t.dtype, shape, list(shape), dims, fill, codec, filters, attrs))


def _references(f: File, o: Object, path: str) -> bytes:
    """The references of a chunked dataset of strings, in order; zeros where no chunk is."""
    codec, filters = _codecs(o.filters, o.type.size, f"{f.r.uri}: {path}")
    a = _placed(f, o, Array(path, "|V16", o.space, list(o.space), None, None, codec, filters))
    counts = [-(-n // c) for n, c in zip(a.shape, a.chunks)]
    out = np.zeros(a.shape, "V16")
    places = a.places
    if a.affine:
        base, strides, size = a.affine
        places = [(k, base + sum(int(i) * s for i, s in zip(np.unravel_index(k, counts), strides)), size) for k in range(int(np.prod(counts)))]
    for k, offset, n in places:
        block = codecs.decode_chunk(f.r.at(offset, n), "|V16", a.chunks, json.dumps(codec) if codec else None, [json.dumps(x) for x in filters])
        at = tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(np.unravel_index(k, counts), a.chunks, a.shape))
        out[at] = block[tuple(slice(0, s.stop - s.start) for s in at)]
    return out.tobytes()


def _placed(f: File, o: Object, a: Array) -> Array:
    """The array with its chunk shape and where its chunks are."""
    t, shape, path, kind = o.type, o.space, a.path, o.layout[0]
    where = f"{f.r.uri}: {path}"
    if kind == "contiguous":
        a.chunks = [max(1, n) for n in shape]
        _, address, size = o.layout
        if address != UNDEFINED and size:
            a.affine = (f.base + address, [0] * len(shape), size)
        elif t.kind == 3:
            a.inline = {0: b"\0" * (t.size * int(np.prod(shape, dtype=np.int64)))}
        return a
    if kind == "btree":
        a.chunks = o.layout[2][: len(shape)]
        a.places = f.btree_chunks(o.layout[1], a.chunks, shape, path)
        return a
    if kind in NEWER_INDEX.values():
        a.chunks = o.layout[2][: len(shape)]
        a.places = f.indexed_chunks(kind, o.layout[1], a.chunks, o, path)
        return a
    if kind == "single":
        a.chunks = o.layout[2][: len(shape)]
        if o.layout[1] != UNDEFINED:
            a.places = [(0, f.base + o.layout[1], o.layout[3] or t.size * int(np.prod(a.chunks, dtype=np.int64)))]
        return a
    if kind == "implicit":
        a.chunks = o.layout[2][: len(shape)]
        size = t.size * int(np.prod(a.chunks, dtype=np.int64))
        counts = [-(-n // c) for n, c in zip(shape, a.chunks)]
        strides = [size * int(np.prod(counts[d + 1 :], dtype=np.int64)) for d in range(len(counts))]
        a.affine = (f.base + o.layout[1], strides, size)
        return a
    what = o.layout[1] if kind == "newer" else kind
    raise FormatError(f"{where}: {what} storage is not supported")


def parse(r: Reader, options: dict) -> Iterator[Array]:
    """Options: group (a group, or one dataset), siblings (arrays that those refer to; true)."""
    f = File(r)
    paths: dict[str, int] = {}
    groups: dict[str, dict] = {}
    seen: set[int] = set()
    todo = [("", f.root)]
    while todo:
        path, address = todo.pop()
        o = f.object(address)
        if address in seen and o.is_group:
            continue
        seen.add(address)
        if o.is_group:
            groups[path] = {k: v for k, v in o.attrs.items() if k not in BOOKKEEPING and v is not None}
            f.r.prefetch((f.base + a, 512) for a in o.links.values())
            todo += [(f"{path}/{n}".lstrip("/"), a) for n, a in o.links.items()]
        else:
            paths[path] = address
    names = {a: p.rpartition("/")[2] for p, a in paths.items()}
    group = options.get("group", "/").strip("/")
    wanted = {p for p in paths if not group or p == group or p.startswith(group + "/")}
    if not wanted and group:
        raise FormatError(f"{r.uri}: there is no group or dataset {group!r}")
    if options.get("siblings", True):
        open_ = list(wanted)
        by_address = {a: p for p, a in paths.items()}
        while open_:
            p = open_.pop()
            o = f.object(paths[p])
            more = [by_address[a] for x in (o.attrs.get("DIMENSION_LIST") or []) if isinstance(x, list) for a in x if a in by_address]
            for key in ("coordinates", "grid_mapping"):
                for n in str(o.attrs.get(key) or "").split():
                    more += [q for q in (f"{p.rpartition('/')[0]}/{n}".lstrip("/"), n) if q in paths][:1]
            for q in more:
                if q not in wanted:
                    wanted.add(q)
                    open_.append(q)
    for path, attrs in sorted(groups.items()):
        if attrs and (not group or path == group or path.startswith(group + "/")):
            yield Group("" if path == group else path, attrs)
    for p in sorted(wanted):
        a = _array(f, f.object(paths[p]), p, names)
        if a is not None:
            if p == group:
                a.path = p.rpartition("/")[2]
            yield a


register_driver("hdf5", parse, ("h5", "hdf5", "he5", "nc", "nc4"))
