"""JPEG 2000: one chunk per tile of the codestream, found by walking its tile-parts."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

from .base import Array, FormatError, Reader, register_driver

# Fixed values of the format.
SIGNATURE = b"\0\0\0\x0cjP  \r\n\x87\n"
SOC, SIZ, SOT, EOC, PPM = 0xFF4F, 0xFF51, 0xFF90, 0xFFD9, 0xFF60


def codestream(r: Reader) -> tuple[int, int]:
    """Where the codestream begins and ends."""
    if r.at(0, 2) == b"\xff\x4f":
        return 0, r.size
    if r.at(0, min(12, r.size)) != SIGNATURE:
        raise FormatError(f"{r.uri}: neither a JP2 file nor a codestream")
    at = 0
    while at + 8 <= r.size:
        n, kind = struct.unpack(">I4s", r.at(at, 8))
        head = 8
        if n == 1:
            (n,) = struct.unpack(">Q", r.at(at + 8, 8))
            head = 16
        elif n == 0:
            n = r.size - at
        if kind == b"jp2c":
            return at + head, at + n
        if n < head:
            break
        at += n
    raise FormatError(f"{r.uri}: no codestream box")


def standalone(header: bytes, data: bytes) -> bytes:
    """The bytes of one tile as a codestream of its own: the main header with an image that is the
    tile, its tile-parts numbered 0. For decoders that are registered as a codec."""
    at = 2
    while struct.unpack_from(">H", header, at)[0] != SIZ:
        at += 2 + struct.unpack_from(">H", header, at + 2)[0]
    x1, y1, x0, y0, tw, th, tx0, ty0 = struct.unpack_from(">8I", header, at + 6)
    (tile,) = struct.unpack_from(">H", data, 4)
    p, q = tile % -(-(x1 - tx0) // tw), tile // -(-(x1 - tx0) // tw)
    left, top = max(tx0 + p * tw, x0), max(ty0 + q * th, y0)
    right, bottom = min(tx0 + (p + 1) * tw, x1), min(ty0 + (q + 1) * th, y1)
    own = bytearray(header)
    struct.pack_into(">8I", own, at + 6, right, bottom, left, top, tw, th, tx0 + p * tw, ty0 + q * th)
    out, pos = bytearray(data), 0
    while pos + 12 <= len(out):
        marker, _, _, n = struct.unpack_from(">HHHI", out, pos)
        if marker != SOT:
            break
        struct.pack_into(">H", out, pos + 4, 0)
        if not n:
            break
        pos += n
    return bytes(own) + bytes(out) + struct.pack(">H", EOC)


def parse(r: Reader, options: dict) -> Iterator[Array]:
    if options.get("level") not in (None, 0):
        raise FormatError(f"{r.uri}: only level 0 can be scanned")
    at, end = codestream(r)
    pos, size = at + 2, None
    while True:
        marker, n = struct.unpack(">HH", r.at(pos, 4))
        if marker == SOT:
            pos_header = pos
            break
        if marker == PPM:
            raise FormatError(f"{r.uri}: packed packet headers (PPM) are not supported")
        if marker == SIZ:
            size = r.at(pos + 4, n - 2)
        pos += 2 + n
    if size is None:
        raise FormatError(f"{r.uri}: no SIZ marker")
    _, x1, y1, x0, y0, tw, th, tx0, ty0, comps = struct.unpack_from(">HIIIIIIIIH", size)
    if comps != 1:
        raise FormatError(f"{r.uri}: {comps} components; one is supported")
    depth, dx, dy = size[36], size[37], size[38]
    if (dx, dy) != (1, 1):
        raise FormatError(f"{r.uri}: subsampled components are not supported")
    if (tx0, ty0) != (x0, y0):
        raise FormatError(f"{r.uri}: the tile grid does not begin at the image")
    w, h = x1 - x0, y1 - y0
    nx, ny = -(-w // tw), -(-h // th)
    bits = (depth & 127) + 1
    dtype = ("i" if depth & 128 else "u") + str(1 if bits <= 8 else 2 if bits <= 16 else 4)
    parts: dict[int, list[tuple[int, int]]] = {}
    while pos + 12 <= end:
        marker, _, tile, n = struct.unpack(">HHHI", r.at(pos, 10))
        if marker == EOC:
            break
        if marker != SOT:
            raise FormatError(f"{r.uri}: no tile-part at {pos}")
        n = n or end - 2 - pos
        parts.setdefault(tile, []).append((pos, n))
        pos += n
    if len(parts) != nx * ny or max(parts) >= nx * ny:
        raise FormatError(f"{r.uri}: {len(parts)} of {nx * ny} tiles are there")
    places = []
    for tile in sorted(parts):
        own = parts[tile]
        if any(a + n != b for (a, n), (b, _) in zip(own, own[1:])):
            raise FormatError(f"{r.uri}: tile {tile} is interleaved with others")
        places.append((tile, own[0][0], sum(n for _, n in own)))
    head = r.at(at, pos_header - at)
    codec = {"id": "jpeg2000_tile", "header": base64.b64encode(head).decode(), "tiles": [ny, nx]}
    yield Array("0/data", ("|" if dtype[1] == "1" else "<") + dtype, [h, w], [th, tw], ["y", "x"], None, codec, [], {}, None, places)


register_driver("jpeg2000", parse, ("jp2", "j2k", "j2c", "jpc"))
