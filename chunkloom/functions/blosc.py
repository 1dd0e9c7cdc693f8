"""Blosc 1 frames undone: blocks of streams by blosclz, LZ4, zlib or zstd, then (bit) shuffle."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the frame's flags.
SHUFFLED, COPIED, BIT_SHUFFLED, WHOLE_BLOCKS = 1, 2, 4, 16
FORMATS = {0: "blosclz", 1: "lz4", 3: "zlib", 4: "zstd"}


def blosclz(data: bytes, size: int) -> bytes:
    """Literal runs and matches: a control byte below 32 begins a run, another a match of its top
    three bits' length at a distance of 13 bits, 8191 of which stand for 16 more."""
    out, p, first = bytearray(), 0, True
    while p < len(data) and len(out) < size:
        control = data[p] & 31 if first else data[p]
        p, first = p + 1, False
        if control < 32:
            out += data[p : p + control + 1]
            p += control + 1
            continue
        length, high = control >> 5, control & 31
        if length == 7:
            while True:
                length += data[p]
                p += 1
                if data[p - 1] != 255:
                    break
        distance = (high << 8) | data[p]
        p += 1
        if distance == 8191:
            distance += int.from_bytes(data[p : p + 2], "big")
            p += 2
        start, n = len(out) - distance - 1, length + 2
        if start < 0:
            raise ValueError("a blosclz match begins before the data")
        if distance + 1 >= n:
            out += out[start : start + n]
        else:
            unit = bytes(out[start:])
            out += (unit * (n // len(unit) + 1))[:n]
    return bytes(out)


def _stream(data: bytes, size: int, kind: str) -> bytes:
    if kind == "lz4":
        import pyarrow as pa

        return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return blosclz(data, size)


def _unshuffled(block: bytes, typesize: int, flags: int) -> bytes:
    n = len(block) // typesize
    if flags & BIT_SHUFFLED:
        n -= n % 8
        bits = np.unpackbits(np.frombuffer(block, np.uint8, n * typesize).reshape(typesize * 8, n // 8), axis=1, bitorder="little")
        return np.packbits(bits.T.reshape(n, typesize * 8), axis=1, bitorder="little").tobytes() + block[n * typesize :]
    if flags & SHUFFLED and typesize > 1:
        return np.frombuffer(block, np.uint8, n * typesize).reshape(typesize, n).T.tobytes() + block[n * typesize :]
    return block


def decompress(data: bytes) -> bytes:
    if len(data) < 16:
        raise ValueError("no blosc frame")
    flags, typesize, nbytes, blocksize, _ = struct.unpack_from("<BBIII", data, 2)
    if flags & COPIED:
        return data[16 : 16 + nbytes]
    if flags >> 5 not in FORMATS:
        raise ValueError(f"blosc streams of format {flags >> 5} are not supported")
    kind, out = FORMATS[flags >> 5], []
    blocks = -(-nbytes // blocksize) if blocksize else 0
    for k, at in enumerate(struct.unpack_from(f"<{blocks}I", data, 16)):
        size = min(blocksize, nbytes - k * blocksize)
        streams = typesize if not flags & WHOLE_BLOCKS and size == blocksize and typesize <= 16 and blocksize // typesize >= 128 else 1
        block = b""
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            part = data[at : at + n]
            block += part if n == size // streams else _stream(part, size // streams, kind)
            at += n
        if len(block) != size:
            raise ValueError(f"a blosc block has {len(block)} of {size} bytes")
        out.append(_unshuffled(block, typesize, flags))
    return b"".join(out)
