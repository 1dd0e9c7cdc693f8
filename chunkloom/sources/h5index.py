"""The newer structures of HDF5 files: chunk indexes (fixed and extensible arrays, version 2
B-trees) and fractal heaps, which hold the links and attributes of large groups."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

from .base import FormatError

UNDEFINED = 2**64 - 1
At = Callable[[int, int], bytes]  # bytes at an address


def _need(data: bytes, sign: bytes, what: str) -> None:
    if data[:4] != sign:
        raise FormatError(f"no {what} ({sign.decode()}) where one should be")


def _log2(n: int) -> int:
    return n.bit_length() - 1


def _width(most: int) -> int:
    """Bytes that numbers up to `most` are stored in."""
    return _log2(most) // 8 + 1 if most else 1


def _bit(bits: bytes, i: int) -> bool:
    return bool(bits[i // 8] & (0x80 >> i % 8))


# --- version 2 B-trees


def records(at: At, address: int) -> Iterator[bytes]:
    """All records of a version 2 B-tree, in order."""
    if address == UNDEFINED:
        return
    head = at(address, 38)
    _need(head, b"BTHD", "B-tree")
    node, size, depth = struct.unpack_from("<IHH", head, 6)
    root, count = struct.unpack_from("<QH", head, 16)
    if root == UNDEFINED or not count:
        return
    # Records that a node of each level holds at most, and that all nodes below one do.
    most, under = [(node - 10) // size], [(node - 10) // size]
    own = _width(most[0])
    for _ in range(depth):
        pointer = 8 + own + (_width(under[-1]) if len(most) > 1 else 0)
        most.append((node - 10 - pointer) // (size + pointer))
        under.append((most[-1] + 1) * under[-1] + most[-1])

    def walk(address: int, count: int, level: int) -> Iterator[bytes]:
        data = at(address, node if level else 10 + count * size)
        _need(data, b"BTIN" if level else b"BTLF", "B-tree node")
        rows = [data[6 + i * size : 6 + (i + 1) * size] for i in range(count)]
        if not level:
            yield from rows
            return
        below = _width(under[level - 1]) if level > 1 else 0
        p = 6 + count * size
        for i in range(count + 1):
            (child,) = struct.unpack_from("<Q", data, p)
            n = int.from_bytes(data[p + 8 : p + 8 + own], "little")
            p += 8 + own + below
            yield from walk(child, n, level - 1)
            if i < count:
                yield rows[i]

    yield from walk(root, count, depth)


# --- chunk indexes: (position in the index, address, size or None, filter mask)

Entry = tuple[int, int, int | None, int]


def _entries(data: bytes, first: int, count: int, size: int, filtered: bool) -> Iterator[Entry]:
    for i in range(count):
        p = i * size
        (address,) = struct.unpack_from("<Q", data, p)
        if address == UNDEFINED:
            continue
        if filtered:
            yield first + i, address, int.from_bytes(data[p + 8 : p + size - 4], "little"), struct.unpack_from("<I", data, p + size - 4)[0]
        else:
            yield first + i, address, None, 0


def fixed_array(at: At, address: int) -> Iterator[Entry]:
    if address == UNDEFINED:
        return
    head = at(address, 28)
    _need(head, b"FAHD", "fixed array")
    filtered, size, page_bits = head[5] == 1, head[6], head[7]
    total, block = struct.unpack_from("<QQ", head, 8)
    if block == UNDEFINED:
        return
    _need(at(block, 4), b"FADB", "fixed array block")
    page = 1 << page_bits
    if total <= page:
        yield from _entries(at(block + 14, total * size), 0, total, size, filtered)
        return
    pages = -(-total // page)
    bits = at(block + 14, -(-pages // 8))
    start = block + 14 + len(bits) + 4
    for k in range(pages):
        n = min(page, total - k * page)
        if _bit(bits, k):
            yield from _entries(at(start + k * (page * size + 4), n * size), k * page, n, size, filtered)


def extensible_array(at: At, address: int) -> Iterator[Entry]:
    if address == UNDEFINED:
        return
    head = at(address, 68)
    _need(head, b"EAHD", "extensible array")
    filtered, size, max_bits, in_index, least, least_blocks, page_bits = head[5] == 1, *head[6:12]
    (index,) = struct.unpack_from("<Q", head, 60)
    if index == UNDEFINED:
        return
    page, offset = 1 << page_bits, -(-max_bits // 8)
    supers = 1 + max_bits - _log2(least)
    blocks_of = lambda s: 1 << (s // 2)
    size_of = lambda s: least << ((s + 1) // 2)
    direct = 2 * _log2(least_blocks)  # super blocks whose blocks the index block lists itself
    n_direct, n_super = 2 * (least_blocks - 1), supers - direct
    data = at(index, 14 + in_index * size + 8 * (n_direct + n_super))
    _need(data, b"EAIB", "index block")
    yield from _entries(data[14:], 0, in_index, size, filtered)
    p = 14 + in_index * size
    places = struct.unpack_from(f"<{n_direct + n_super}Q", data, p)

    def block(address: int, first: int, count: int, initialized: Callable[[int], bool]) -> Iterator[Entry]:
        _need(at(address, 4), b"EADB", "data block")
        start = address + 14 + offset
        if count <= page:
            yield from _entries(at(start, count * size), first, count, size, filtered)
            return
        for k in range(count // page):
            if initialized(k):
                yield from _entries(at(start + 4 + k * (page * size + 4), page * size), first + k * page, page, size, filtered)

    first, k = in_index, 0
    for s in range(direct):
        for _ in range(blocks_of(s)):
            if places[k] != UNDEFINED:
                yield from block(places[k], first, size_of(s), lambda _: True)
            first, k = first + size_of(s), k + 1
    for j in range(n_super):
        s = direct + j
        n, each = blocks_of(s), size_of(s)
        if places[n_direct + j] != UNDEFINED:
            pages = each // page if each > page else 0
            mask = -(-pages // 8)
            body = at(places[n_direct + j], 14 + offset + n * mask + 8 * n)
            _need(body, b"EASB", "super block")
            bits, own = body[14 + offset :], struct.unpack_from(f"<{n}Q", body, 14 + offset + n * mask)
            for i, where in enumerate(own):
                if where != UNDEFINED:
                    yield from block(where, first + i * each, each, lambda k, i=i: _bit(bits[i * mask :], k))
        first += n * each


def tree_chunks(at: At, address: int, rank: int, filtered: bool) -> Iterator[tuple[list[int], int, int | None, int]]:
    """(chunk index by dimension, address, size or None, filter mask) of a version 2 B-tree."""
    for r in records(at, address):
        (where,) = struct.unpack_from("<Q", r, 0)
        index = list(struct.unpack_from(f"<{rank}Q", r, len(r) - 8 * rank))
        if filtered:
            p = len(r) - 8 * rank - 4
            yield index, where, int.from_bytes(r[8:p], "little"), struct.unpack_from("<I", r, p)[0]
        else:
            yield index, where, None, 0


def unravel(i: int, counts: list[int]) -> list[int]:
    out = []
    for n in reversed(counts):
        out.append(i % n)
        i //= n
    return out[::-1]


def grid_index(i: int, shape: list[int], most: list[int], chunks: list[int]) -> list[int]:
    """The chunk index of a position: positions count through the largest extents the dataset may
    have, the unlimited dimension slowest."""
    counts = [-(-(n if m == UNDEFINED else m) // c) for n, m, c in zip(shape, most, chunks)]
    free = [d for d, m in enumerate(most) if m == UNDEFINED]
    order = [*free, *[d for d in range(len(counts)) if d not in free]] if len(free) == 1 else list(range(len(counts)))
    turned = [counts[d] for d in order]
    if len(free) == 1:
        below = math.prod(turned[1:])
        at = [i // below, *unravel(i % below, turned[1:])]
    else:
        at = unravel(i, turned)
    out = [0] * len(counts)
    for d, x in zip(order, at):
        out[d] = x
    return out


# --- fractal heaps


class Heap:
    """Objects of a fractal heap by their ids: managed ones (in blocks) and tiny ones (in the id)."""

    def __init__(self, at: At, address: int):
        head = at(address, 142)
        _need(head, b"FRHP", "fractal heap")
        self.at = at
        filters, self.checked = struct.unpack_from("<H", head, 7)[0], bool(head[9] & 2)
        if filters:
            raise FormatError("a fractal heap with filters is not supported")
        self.width, self.start, self.most_direct = struct.unpack_from("<HQQ", head, 110)
        bits, _ = struct.unpack_from("<HH", head, 128)
        self.root, self.rows = struct.unpack_from("<QH", head, 132)
        self.offset = -(-bits // 8)

    def get(self, key: bytes) -> bytes:
        kind = key[0] >> 4 & 3
        if kind == 2:
            return key[1 : 2 + (key[0] & 15)]
        if kind == 1:
            raise FormatError("a huge object of a fractal heap is not supported")
        where, n = int.from_bytes(key[1 : 1 + self.offset], "little"), int.from_bytes(key[1 + self.offset :], "little")
        if not self.rows:
            return self.at(self.root + where, n)
        return self._find(self.root, self.rows, 0, where, n)

    def _row_size(self, r: int) -> int:
        return self.start if r < 2 else self.start << (r - 1)

    def _find(self, address: int, rows: int, base: int, where: int, n: int) -> bytes:
        """The object in an indirect block, whose first byte of heap space is `base`."""
        direct = _log2(self.most_direct // self.start) + 2  # rows of direct blocks
        data = self.at(address, 13 + self.offset + 8 * self.width * rows)
        _need(data, b"FHIB", "indirect heap block")
        places = struct.unpack_from(f"<{self.width * rows}Q", data, 13 + self.offset)
        for r in range(rows):
            size = self._row_size(r)
            if where < base + size * self.width:
                k = (where - base) // size
                child = places[r * self.width + k]
                if child == UNDEFINED:
                    break
                if r < direct:
                    return self.at(child + where - base - k * size, n)
                below = _log2(size) - _log2(self.start * self.width) + 1
                return self._find(child, below, base + k * size, where, n)
            base += size * self.width
        raise FormatError(f"no object at {where} of a fractal heap")
