"""Codecs of chunk bytes, undone and applied with numpy; a registry that users can extend."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np

from . import blosc


class UnsupportedCodec(ValueError):
    pass


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _shuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    body = np.frombuffer(data, np.uint8, n * size).reshape(n, size).T
    return body.tobytes() + data[n * size :]


def _unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    body = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T
    return body.tobytes() + data[n * size :]


def fletcher32(data: bytes) -> int:
    """HDF5's checksum: two 16-bit sums, each modulo 65535, over big-endian 16-bit words."""
    words = np.frombuffer(data[: len(data) // 2 * 2], ">u2").astype(np.uint64)
    if len(data) % 2:
        words = np.append(words, np.uint64(data[-1] << 8))
    if not len(words):
        return 0
    a = int(words.sum()) % 65535
    b = int((words * np.arange(len(words), 0, -1, dtype=np.uint64) % np.uint64(65535)).sum()) % 65535
    return (b << 16) | a


def _strip_fletcher(data: bytes, cfg: dict) -> bytes:
    body, stored = data[:-4], int.from_bytes(data[-4:], "little")
    if cfg.get("verify") and fletcher32(body) != stored:
        raise ValueError("fletcher32 checksum does not match")
    return body


def lzw(data: bytes) -> bytes:
    """TIFF LZW: codes from the most significant bit, 9 to 12 bits, width grown one code early."""
    if len(data) >= 2 and data[0] == 0 and data[1] & 1:
        raise UnsupportedCodec("old-style LZW is not supported")
    strings: list[bytes] = []
    out: list[bytes] = []
    width, before = 9, b""
    bits = held = 0
    for byte in data:
        bits, held = ((bits << 8) | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = (bits >> held) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            strings, width, before = [], 9, b""
            continue
        known = bytes((code,)) if code < 256 else strings[code - 258] if code - 258 < len(strings) else None
        word = known if known is not None else before + before[:1]
        if before and len(strings) < 3838:
            strings.append(before + word[:1])
        if known is None and code - 258 != len(strings) - 1:
            raise ValueError("LZW code out of range")
        out.append(word)
        before = word
        width = max(9, min(12, (len(strings) + 259).bit_length()))
    return b"".join(out)


def predictor(data: bytes, dtype: np.dtype, columns: int, samples: int, undo: bool) -> bytes:
    """Horizontal differencing of rows of columns x samples, on the elements' raw bits."""
    raw = np.frombuffer(data, np.dtype(f"<u{dtype.itemsize}")).reshape(-1, columns, samples)
    if undo:
        return np.cumsum(raw, axis=1, dtype=raw.dtype).tobytes()
    out = raw.copy()
    out[:, 1:] -= raw[:, :-1]
    return out.tobytes()


Decoder = Callable[[bytes, dict, dict], bytes]
#: id -> (decode, encode); each gets the bytes, the codec's configuration and the array's context
#: (dtype, chunk shape).
_REGISTRY: dict[str, tuple[Decoder, Decoder | None]] = {}
_REJECTED: dict[str, str] = {}


def register_codec(name: str, decode: Decoder, encode: Decoder | None = None) -> None:
    _REGISTRY[name] = (decode, encode)
    _REJECTED.pop(name, None)


def register_rejection(name: str, reason: str) -> None:
    _REJECTED[name] = reason


def _blosc(data: bytes) -> bytes:
    try:
        return blosc.decompress(data)
    except ValueError as e:
        raise UnsupportedCodec(f"blosc: {e}") from e


def extras() -> tuple[dict, dict]:
    """What users registered in this process, for a task to `adopt`."""
    return {k: v for k, v in _REGISTRY.items() if _BUILT_IN.get(k) is not v}, dict(_REJECTED)


def adopt(registered: tuple[dict, dict]) -> None:
    """In a task: the driver's codecs, and no others that an earlier task of this process had."""
    _REGISTRY.clear()
    _REGISTRY.update(_BUILT_IN | registered[0])
    _REJECTED.clear()
    _REJECTED.update(registered[1])


def _columns(cfg: dict, ctx: dict) -> int:
    return cfg.get("columns") or ctx["chunks"][-1 if cfg.get("samples", 1) == 1 else -2]


register_codec("zlib", lambda d, c, x: zlib.decompress(d), lambda d, c, x: zlib.compress(d, c.get("level", 1)))
register_codec("gzip", lambda d, c, x: zlib.decompress(d, 31))
register_codec("zstd", lambda d, c, x: _zstd(d), lambda d, c, x: __import__("zstandard").ZstdCompressor(level=c.get("level", 3)).compress(d))
register_codec("shuffle", lambda d, c, x: _unshuffle(d, c.get("elementsize", 4)), lambda d, c, x: _shuffle(d, c.get("elementsize", 4)))
register_codec("fletcher32", lambda d, c, x: _strip_fletcher(d, c), lambda d, c, x: d + fletcher32(d).to_bytes(4, "little"))
register_codec("blosc", lambda d, c, x: _blosc(d))
register_codec("imagecodecs_lzw", lambda d, c, x: lzw(d))
register_codec(
    "tiff_predictor", lambda d, c, x: predictor(d, np.dtype(x["dtype"]), _columns(c, x), c.get("samples", 1), True),
    lambda d, c, x: predictor(d, np.dtype(x["dtype"]), _columns(c, x), c.get("samples", 1), False),
)


def _delta(d: bytes, c: dict, undo: bool) -> bytes:
    a = np.frombuffer(d, c["dtype"])
    if undo:
        return np.cumsum(a, dtype=a.dtype).tobytes()
    return np.diff(a, prepend=a.dtype.type(0)).astype(a.dtype).tobytes()


register_codec("delta", lambda d, c, x: _delta(d, c, True), lambda d, c, x: _delta(d, c, False))
register_rejection("jpeg2000_tile", "no JPEG 2000 library is at hand; register_codec can add a decoder (sources.jp2.standalone makes a tile a codestream)")
_BUILT_IN = dict(_REGISTRY)


def lookup_codec(name: str) -> tuple[Decoder, Decoder | None]:
    if name in _REJECTED:
        raise UnsupportedCodec(f"codec {name}: {_REJECTED[name]}")
    if name not in _REGISTRY:
        raise UnsupportedCodec(f"codec {name} is not known; register_codec can add it")
    return _REGISTRY[name]


def pipeline(compressor: str | None, filters: list[str] | None) -> list[dict]:
    """Codecs in the order they were applied: filters, then the compressor."""
    return [json.loads(f) for f in filters or []] + ([json.loads(compressor)] if compressor else [])


def decode_chunk(data: bytes, dtype: str, chunks: list[int], compressor: str | None, filters: list[str] | None) -> np.ndarray:
    """Encoded bytes to a chunk of its full shape; a short chunk's rest is zero."""
    ctx = {"dtype": dtype, "chunks": chunks}
    for cfg in reversed(pipeline(compressor, filters)):
        data = lookup_codec(cfg["id"])[0](data, cfg, ctx)
    d = np.dtype(dtype)
    size = int(np.prod(chunks, dtype=np.int64)) if chunks else 1
    data = data[: size * d.itemsize].ljust(size * d.itemsize, b"\0")
    return np.frombuffer(data, d).reshape(tuple(chunks))


def encode_chunk(a: np.ndarray, compressor: str | None = None, filters: list[str] | None = None) -> bytes:
    data, ctx = np.ascontiguousarray(a).tobytes(), {"dtype": a.dtype.str, "chunks": list(a.shape)}
    for cfg in pipeline(compressor, filters):
        encode = lookup_codec(cfg["id"])[1]
        if encode is None:
            raise UnsupportedCodec(f"codec {cfg['id']} cannot encode")
        data = encode(data, cfg, ctx)
    return data
