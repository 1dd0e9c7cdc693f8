"""Small source files made from table rows: the catalog's queries scan them, tests bend them.

Each writer makes one file's bytes. `write_parts` deals rows out by a key and writes a file for
each on the executors, into a folder that driver and executors share.
"""

from __future__ import annotations

import io
import math
import struct
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOWHERE = 2**64 - 1


# --- HDF5

#: Datatype messages of the specification by numpy type.
H5_TYPES = {
    "<i4": struct.pack("<BBBBI", 0x10, 8, 0, 0, 4) + struct.pack("<HH", 0, 32), "<i8": struct.pack("<BBBBI", 0x10, 8, 0, 0, 8) + struct.pack("<HH", 0, 64),
    "<u2": struct.pack("<BBBBI", 0x10, 0, 0, 0, 2) + struct.pack("<HH", 0, 16), "|u1": struct.pack("<BBBBI", 0x10, 0, 0, 0, 1) + struct.pack("<HH", 0, 8),
    "<f4": struct.pack("<BBBBI", 0x11, 0x20, 31, 0, 4) + struct.pack("<HHBBBBI", 0, 32, 23, 8, 0, 23, 127),
    "<f8": struct.pack("<BBBBI", 0x11, 0x20, 63, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023),
}
VLEN_TEXT = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x10, 0, 0, 0, 1) + struct.pack("<HH", 0, 8)


@dataclass
class Dataset:
    values: np.ndarray | list[str]  # a list: variable-length strings
    chunks: tuple[int, ...] | None = None  # None: contiguous
    index: str = "btree1"  # btree1, fixed, extensible, btree2 or implicit
    deflate: bool = False
    shuffle: bool = False
    attrs: dict = field(default_factory=dict)
    fill: object = None
    absent: tuple[int, ...] = ()  # numbers of chunks that were never written
    scales: tuple[str, ...] = ()  # datasets of the same group, one a dimension


class H5Writer:
    """Superblock 0, version 1 object headers; groups by symbol table or by dense links."""

    def __init__(self):
        self.buf = bytearray(96)

    def put(self, data: bytes) -> int:
        self.buf += b"\0" * (-len(self.buf) % 8)
        at = len(self.buf)
        self.buf += data
        return at

    @staticmethod
    def message(kind: int, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 8)
        return struct.pack("<HHB3x", kind, len(body), 0) + body

    def header(self, messages: list[bytes]) -> int:
        body = b"".join(messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    @staticmethod
    def space(shape, free: bool = False) -> bytes:
        if not shape:
            return struct.pack("<BBB5x", 1, 0, 0)
        most = (NOWHERE, *shape[1:]) if free else ()
        return struct.pack("<BBB5x", 1, len(shape), 1 if free else 0) + struct.pack(f"<{len(shape) + len(most)}Q", *shape, *most)

    def attribute(self, name: str, value) -> bytes:
        if isinstance(value, str):
            raw = value.encode()
            kind, data, space = struct.pack("<BBBBI", 0x13, 0, 0, 0, max(1, len(raw))), raw or b"\0", self.space(())
        else:
            a = np.asarray(value, "<i8" if np.asarray(value).dtype.kind in "iu" else "<f8")
            kind, data, space = H5_TYPES[a.dtype.str], a.tobytes(), self.space(a.shape)
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        label = name.encode() + b"\0"
        return struct.pack("<BxHHH", 1, len(label), len(kind), len(space)) + pad(label) + pad(kind) + pad(space) + data

    def text_heap(self, texts: list[str]) -> bytes:
        """The strings in a global heap; their references."""
        body, refs = bytearray(), []
        for i, t in enumerate(texts, 1):
            raw = t.encode()
            refs.append((len(raw), i))
            body += struct.pack("<HHxxxxQ", i, 1, len(raw)) + raw + b"\0" * (-len(raw) % 8)
        at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body) + 16) + body + b"\0" * 16)
        return b"".join(struct.pack("<IQI", n, at if n else 0, i) for n, i in refs)

    def dimension_list(self, scales: list[int]) -> bytes:
        """The attribute that refers to each dimension's scale."""
        body = b"".join(struct.pack("<HHxxxxQQ", i, 1, 8, at) for i, at in enumerate(scales, 1))
        heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body) + 16) + body + b"\0" * 16)
        kind = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
        label, space = b"DIMENSION_LIST\0".ljust(16, b"\0"), self.space((len(scales),))
        data = b"".join(struct.pack("<IQI", 1, heap, i) for i in range(1, len(scales) + 1))
        return struct.pack("<BxHHH", 1, 15, len(kind), len(space)) + label + kind + space + data

    def dataset(self, d: Dataset, scales: list[int] | None = None) -> int:
        texts = isinstance(d.values, list)
        a = None if texts else np.ascontiguousarray(d.values)
        shape = (len(d.values),) if texts else a.shape
        out = [self.message(1, self.space(shape, free=d.index == "extensible")), self.message(3, VLEN_TEXT if texts else H5_TYPES["|u1" if a.dtype.str == "|u1" else a.dtype.str])]
        if d.fill is not None:
            raw = np.array(d.fill, a.dtype).tobytes()
            out.append(self.message(5, struct.pack("<BBBBi", 2, 1, 0, 1, len(raw)) + raw))
        if d.chunks is None:
            data = self.text_heap(d.values) if texts else a.tobytes()
            out.append(self.message(8, struct.pack("<BBQQ", 3, 1, self.put(data) if data else NOWHERE, len(data))))
        else:
            a = np.frombuffer(self.text_heap(d.values), "V16") if texts else a
            out.append(self.message(8, self.chunked(a, d)))
            filters = ([struct.pack("<HHHHI4x", 2, 0, 0, 1, a.dtype.itemsize)] if d.shuffle else []) + ([struct.pack("<HHHHI4x", 1, 0, 0, 1, 6)] if d.deflate else [])
            if filters:
                out.append(self.message(11, struct.pack("<BB6x", 1, len(filters)) + b"".join(filters)))
        out += [self.message(12, self.attribute(k, v)) for k, v in d.attrs.items()]
        if scales:
            out.append(self.message(12, self.dimension_list(scales)))
        return self.header(out)

    def chunked(self, a: np.ndarray, d: Dataset) -> bytes:
        counts = [-(-n // c) for n, c in zip(a.shape, d.chunks)]
        places = []  # (index, address or NOWHERE, size)
        for k in range(math.prod(counts)):
            index = np.unravel_index(k, counts)
            if k in d.absent:
                places.append((index, NOWHERE, 0))
                continue
            block = np.zeros(d.chunks, a.dtype)
            part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, d.chunks))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            data = block.tobytes()
            if d.shuffle:
                data = np.frombuffer(data, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
            if d.deflate:
                data = zlib.compress(data, 6)
            # An implicit index is one stretch of chunks in order, so nothing may come between.
            at = self.put(data) if d.index != "implicit" or not places else len(self.buf)
            if d.index == "implicit" and places:
                self.buf += data
            places.append((index, at, len(data)))
        there = [p for p in places if p[1] != NOWHERE]
        size = a.dtype.itemsize
        if d.index == "btree1":
            node = b"TREE" + struct.pack("<BBHQQ", 1, 0, len(there), NOWHERE, NOWHERE)
            for index, at, n in there:
                node += struct.pack("<II", n, 0) + struct.pack(f"<{len(index) + 1}Q", *[int(i) * c for i, c in zip(index, d.chunks)], 0) + struct.pack("<Q", at)
            node += struct.pack("<II", 0, 0) + struct.pack(f"<{a.ndim + 1}Q", *a.shape, 0)
            return struct.pack("<BBBQ", 3, 2, a.ndim + 1, self.put(node)) + struct.pack(f"<{a.ndim + 1}I", *d.chunks, size)
        filtered = d.deflate or d.shuffle
        entry = (lambda at, n: struct.pack("<QII", at, n, 0)) if filtered else (lambda at, n: struct.pack("<Q", at))
        nothing, width = entry(NOWHERE, 0), 16 if filtered else 8
        client = bytes([1 if filtered else 0])
        cells = [entry(at, n) for _, at, n in places]
        if d.index == "implicit":
            kind, about, at = 2, b"", places[0][1]
        elif d.index == "fixed":
            bits = 3  # pages of eight entries
            if len(cells) > 8:
                pages = [b"".join(cells[k : k + 8]) + b"\0" * 4 for k in range(0, len(cells), 8)]
                mask = bytearray(-(-len(pages) // 8))
                for k in range(len(pages)):
                    mask[k // 8] |= 0x80 >> k % 8
                body = bytes(mask) + b"\0" * 4 + b"".join(pages)
            else:
                body = b"".join(cells) + b"\0" * 4
            block = self.put(b"FADB\0" + client + struct.pack("<Q", 0) + body)
            at = self.put(b"FAHD\0" + client + bytes([width, bits]) + struct.pack("<QQ", len(cells), block) + b"\0" * 4)
            kind, about = 3, bytes([bits])
        elif d.index == "extensible":
            kind, about, at = 4, bytes([32, 4, 4, 4, 3]), self.extensible(cells, nothing, width, client)
        else:
            kind, about, at = 5, struct.pack("<IBB", 4096, 100, 40), self.btree2(there, filtered)
        dims = struct.pack(f"<{a.ndim + 1}I", *d.chunks, size)
        return bytes([4, 2, 0, a.ndim + 1, 4]) + dims + bytes([kind]) + about + struct.pack("<Q", at)

    def extensible(self, cells: list[bytes], nothing: bytes, width: int, client: bytes) -> int:
        """32 bits of elements, 4 in the index block, blocks of 4 and more, 4 pointers, pages of 8."""
        in_index, least, pointers, page, offset = 4, 4, 4, 8, 4
        supers = 1 + 32 - 2
        direct, n_direct = 4, 2 * (pointers - 1)
        own, left = cells[:in_index], cells[in_index:]

        def block(part: list[bytes], count: int) -> int:
            part = part + [nothing] * (count - len(part))
            if count > page:
                body = b"\0" * 4 + b"".join(b"".join(part[k : k + page]) + b"\0" * 4 for k in range(0, count, page))
            else:
                body = b"".join(part) + b"\0" * 4
            return self.put(b"EADB\0" + client + struct.pack("<Q", 0) + b"\0" * offset + body)

        places, above = [], []
        for s in range(supers):
            n, each = 1 << (s // 2), least << ((s + 1) // 2)
            addresses, used = [], []
            for _ in range(n):
                part, left = left[:each], left[each:]
                addresses.append(block(part, each) if part else NOWHERE)
                used.append(bool(part))
            if s < direct:
                places += addresses
            elif any(used):
                pages = each // page if each > page else 0
                mask = b"".join((b"\xff" if u else b"\0") * -(-pages // 8) for u in used)
                above.append(self.put(b"EASB\0" + client + struct.pack("<Q", 0) + b"\0" * offset + mask + struct.pack(f"<{n}Q", *addresses) + b"\0" * 4))
            else:
                above.append(NOWHERE)
        own += [nothing] * (in_index - len(own))
        index = self.put(b"EAIB\0" + client + struct.pack("<Q", 0) + b"".join(own) + struct.pack(f"<{n_direct + len(above)}Q", *places[:n_direct], *above) + b"\0" * 4)
        return self.put(b"EAHD\0" + client + bytes([width, 32, in_index, least, pointers, 3]) + struct.pack("<6QQ", 0, 0, 0, 0, len(cells), len(cells), index) + b"\0" * 4)

    def tree(self, kind: int, rows: list[bytes], node: int = 4096) -> int:
        """A version 2 B-tree: a leaf, or a root over leaves."""
        size = len(rows[0]) if rows else 8
        most = (node - 10) // size
        leaf = lambda part: self.put(b"BTLF\0" + bytes([kind]) + b"".join(part) + b"\0" * 4)
        if len(rows) <= most:
            root, n, depth = leaf(rows), len(rows), 0
        else:
            between, children, k = [], [], 0
            while k < len(rows):
                children.append(rows[k : k + most])
                k += most
                if k < len(rows) - 1:
                    between.append(rows[k])
                    k += 1
                elif k == len(rows) - 1:  # a last record of its own goes below
                    between.append(children[-1].pop())
                    children.append(rows[k:])
                    k += 1
            own = (most.bit_length() - 1) // 8 + 1
            body = b"".join(between) + b"".join(struct.pack("<Q", leaf(c)) + len(c).to_bytes(own, "little") for c in children)
            root, n, depth = self.put((b"BTIN\0" + bytes([kind]) + body).ljust(node, b"\0")), len(between), 1
        return self.put(b"BTHD\0" + bytes([kind]) + struct.pack("<IHHBBQHQ", node, size, depth, 100, 40, root, n, len(rows)) + b"\0" * 4)

    def btree2(self, there: list[tuple], filtered: bool) -> int:
        rows = []
        for index, at, n in there:
            head = struct.pack("<QII", at, n, 0) if filtered else struct.pack("<Q", at)
            rows.append(head + struct.pack(f"<{len(index)}Q", *map(int, index)))
        return self.tree(11 if filtered else 10, rows)

    def heap(self, objects: list[bytes], bits: int) -> tuple[int, list[bytes]]:
        """A fractal heap of direct blocks of 512 bytes, under an indirect block if there are several;
        its address and the objects' ids."""
        offset, start, width = bits // 8, 512, 4
        room = 13 + offset
        blocks, ids = [bytearray(room)], []
        for o in objects:
            if len(blocks[-1]) + len(o) > start:
                blocks.append(bytearray(room))
            where = (len(blocks) - 1) * start + len(blocks[-1])
            ids.append(b"\0" + where.to_bytes(offset, "little") + struct.pack("<H", len(o)))
            blocks[-1] += o
        places = [self.put((b"FHDB\0" + bytes(8 + offset) + bytes(b[room:])).ljust(start, b"\0")) for b in blocks[: 2 * width]]
        if len(blocks) > 2 * width:
            raise ValueError("too much for the two rows of blocks that are written here")
        rows = 0
        root = places[0]
        if len(blocks) > 1:
            rows = 2
            root = self.put(b"FHIB\0" + bytes(8 + offset) + struct.pack(f"<{2 * width}Q", *places, *[NOWHERE] * (2 * width - len(places))) + b"\0" * 4)
        head = b"FRHP\0" + struct.pack("<HHBI", 1 + offset + 2, 0, 0, 4096) + bytes(8) + struct.pack("<Q", NOWHERE) + bytes(8) + struct.pack("<Q", NOWHERE) + bytes(8 * 8)
        head += struct.pack("<HQQHHQH", width, start, 65536, bits, 1, root, rows) + b"\0" * 4
        return self.put(head), ids

    def group(self, links: dict[str, int], attrs: dict, dense: bool = False) -> int:
        own = [self.message(12, self.attribute(k, v)) for k, v in attrs.items()]
        if dense:
            bodies = [bytes([1, 0, len(n.encode())]) + n.encode() + struct.pack("<Q", at) for n, at in sorted(links.items())]
            heap, ids = self.heap(bodies, 32)
            tree = self.tree(5, [struct.pack("<I", zlib.crc32(b)) + i for b, i in sorted(zip(bodies, ids), key=lambda x: zlib.crc32(x[0]))])
            info = self.message(2, struct.pack("<BBQQ", 0, 0, heap, tree))
            if attrs:
                bodies = [self.attribute(k, v) for k, v in attrs.items()]
                heap, ids = self.heap(bodies, 40)
                tree = self.tree(8, [i + bytes(9) for i in ids])
                own = [self.message(0x15, struct.pack("<BBQQ", 0, 0, heap, tree))]
            return self.header([info, *own])
        names, offsets = bytearray(8), []
        links = dict(sorted(links.items()))
        for n in links:
            offsets.append(len(names))
            names += n.encode() + b"\0"
            names += b"\0" * (-len(names) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.put(bytes(names))))
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(links)) + b"".join(struct.pack("<QQII16x", o, a, 0, 0) for o, a in zip(offsets, links.values())))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node, 0))
        return self.header([self.message(0x11, struct.pack("<QQ", tree, heap)), *own])

    def file(self, tree: dict, attrs: dict | None = None, dense: bool = False) -> bytes:
        """tree: names to Dataset, or to (tree, attrs) for a group."""

        def build(tree, attrs):
            made = {}
            for k, v in sorted(tree.items(), key=lambda x: isinstance(x[1], Dataset) and bool(x[1].scales)):  # scales come first
                made[k] = self.dataset(v, [made[s] for s in v.scales]) if isinstance(v, Dataset) else build(*v)
            return self.group(made, attrs, dense)

        root = build(tree, attrs or {})
        head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.buf), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.buf[: len(head)] = head
        return bytes(self.buf)


# --- TIFF


@dataclass
class TiffPage:
    values: np.ndarray  # y, x or y, x, band or (planar) band, y, x
    tile: tuple[int, int] | None = None  # None: strips
    rows: int = 16  # to a strip
    codec: str = "none"  # none, deflate, zstd or lzw
    predictor: bool = False
    planar: bool = False
    tags: dict = field(default_factory=dict)  # tag: (type code, values)


def _lzw(data: bytes) -> bytes:
    """A clear code every 200 literals keeps all codes at nine bits; valid, if not small."""
    bits = n = 0
    for k, byte in enumerate(data):
        if k % 200 == 0:
            bits, n = bits << 9 | 256, n + 9
        bits, n = bits << 9 | byte, n + 9
    bits, n = bits << 9 | 257, n + 9
    return (bits << -n % 8).to_bytes(-(-n // 8), "big")


def _encode(block: np.ndarray, p: TiffPage) -> bytes:
    if p.predictor:
        raw = block.view(f"<u{block.dtype.itemsize}").copy()
        raw[:, 1:] -= raw[:, :-1].copy()
        block = raw
    data = block.tobytes()
    if p.codec == "deflate":
        return zlib.compress(data, 6)
    if p.codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return _lzw(data) if p.codec == "lzw" else data


def tiff(pages: list[TiffPage], big: bool = False) -> bytes:
    """A little-endian TIFF or BigTIFF."""
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    link, codes = (8 if big else 4), {3: "H", 4: "I", 12: "d", 16: "Q"}
    for p in pages:
        a = p.values
        planes = list(a) if p.planar else [a]
        h, w = planes[0].shape[:2]
        bands = a.shape[0] if p.planar else a.shape[2] if a.ndim == 3 else 1
        th, tw = p.tile or (min(p.rows, h), w)
        places = []
        for plane in planes:
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = plane[y : y + th, x : x + tw]
                    if p.tile:
                        block = np.pad(block, [(0, th - block.shape[0]), (0, tw - block.shape[1])] + [(0, 0)] * (block.ndim - 2))
                    data = _encode(np.ascontiguousarray(block), p)
                    places.append((len(out), len(data)))
                    out += data
        d = a.dtype
        tags = {
            256: (4, [w]), 257: (4, [h]), 258: (3, [8 * d.itemsize] * bands), 259: (3, [{"none": 1, "lzw": 5, "deflate": 8, "zstd": 50000}[p.codec]]), 277: (3, [bands]),
            284: (3, [2 if p.planar else 1]), 317: (3, [2 if p.predictor else 1]), 339: (3, [{"u": 1, "i": 2, "f": 3}[d.kind]] * bands),
        }
        tags |= {322: (4, [tw]), 323: (4, [th]), 324: (4, [o for o, _ in places]), 325: (4, [n for _, n in places])} if p.tile else {278: (4, [th]), 273: (4, [o for o, _ in places]), 279: (4, [n for _, n in places])}
        tags |= p.tags
        out += b"\0" * (-len(out) % 2)
        at = len(out)
        out[link : link + (8 if big else 4)] = struct.pack("<Q" if big else "<I", at)
        n, word = len(tags), 8 if big else 4
        extra_at, extra = at + (8 if big else 2) + n * (20 if big else 12) + word, b""
        body = struct.pack("<Q" if big else "<H", n)
        for tag, (kind, values) in sorted(tags.items()):
            raw = values.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{codes[kind]}", *values)
            body += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(raw) if kind == 2 else len(values))
            if len(raw) <= word:
                body += raw.ljust(word, b"\0")
            else:
                body += struct.pack("<Q" if big else "<I", extra_at + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        out += body
        link = len(out)
        out += b"\0" * word + extra
    return bytes(out)


def geo_tags(x0: float, y0: float, step: float, epsg: int, nodata: str | None = None) -> dict:
    """Scale, tiepoint and a projected system's code, pixels being areas."""
    tags = {33550: (12, [step, step, 0.0]), 33922: (12, [0, 0, 0, x0, y0, 0]), 34735: (3, [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, epsg])}
    return tags | ({42113: (2, nodata)} if nodata else {})


# --- JPEG 2000 and zip


def jp2(tiles: list[list[bytes]], columns: int, side: int = 64, boxed: bool = True) -> bytes:
    """A JP2 file whose tiles (each a list of tile-parts) hold any bytes: its structure is right, its
    wavelets are not."""
    rows = -(-len(tiles) // columns)
    siz = struct.pack(">HIIIIIIIIH", 0, columns * side, rows * side, 0, 0, side, side, 0, 0, 1) + bytes([7, 1, 1])
    out = b"\xff\x4f\xff\x51" + struct.pack(">H", len(siz) + 2) + siz
    for k, parts in enumerate(tiles):
        for i, body in enumerate(parts):
            out += struct.pack(">HHHIBB", 0xFF90, 10, k, 12 + 2 + len(body), i, len(parts)) + b"\xff\x93" + body
    out += b"\xff\xd9"
    if not boxed:
        return out
    return b"\0\0\0\x0cjP  \r\n\x87\n" + struct.pack(">I4s", 20, b"ftyp") + b"jp2 \0\0\0\0jp2 " + struct.pack(">I4s", len(out) + 8, b"jp2c") + out


def archive(members: list[tuple[str, bytes]], stored: Callable[[int], bool] = lambda i: False) -> bytes:
    """A zip file; members are deflated but for those whose number is `stored`."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, data) in enumerate(members):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if stored(i) else zipfile.ZIP_DEFLATED)
    return out.getvalue()


# --- writing


def write_parts(rows: DataFrame, key: str, make: Callable[[int, list[dict]], tuple[str, bytes]], directory: str) -> list[str]:
    """One file for each value of `key` (a long), in order of the values: make(value, its rows) gives
    its name and bytes. The rows of a value are one file's, so they fit in a task. Returns paths."""
    import os

    local = directory[len("file://") :] if directory.startswith("file://") else directory

    def run(batches):
        names, now, held = [], None, []

        def put():
            name, data = make(now, held)
            to = os.path.join(local, name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(f"{to}.part", "wb") as f:
                f.write(data)
            os.replace(f"{to}.part", to)
            names.append((now, to))

        for b in batches:
            for r in b.to_pylist():
                if r[key] != now:
                    if now is not None:
                        put()
                    now, held = r[key], []
                held.append(r)
        if now is not None:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.int64()), pa.array([n for _, n in names], pa.string())], names=["key", "path"])

    order = [c for c in rows.columns if c != key]
    dealt = rows.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("long")).repartition(key).sortWithinPartitions(key, *order[:1])
    return [r["path"] for r in dealt.mapInArrow(run, "key long, path string").orderBy("key").collect()]
