"""TIFF, BigTIFF, GeoTIFF and COG: directories to arrays of still-encoded tiles and strips.

Arrays are `level/data` and `level/mask` of the one image, or `image/level/...` of several,
with coordinates `x` and `y` and a `spatial_ref` where a transform and a code are given.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from ..functions import crs, geo
from .base import Array, FormatError, Reader, inline_array, register_driver

# Fixed values of the format: byte sizes and struct codes of the field types.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
COMPRESSORS = {1: None, 8: {"id": "zlib", "level": 6}, 32946: {"id": "zlib", "level": 6}, 50000: {"id": "zstd", "level": 3}, 5: {"id": "imagecodecs_lzw"}}
REFUSED = {7: "JPEG", 32773: "PackBits", 50001: "WebP", 6: "old-style JPEG"}


def _directory(r: Reader, at: int, big: bool) -> tuple[dict[int, tuple], int]:
    head, width, word, fmt = (8, 20, 8, "<Q") if big else (2, 12, 4, "<H")
    (n,) = struct.unpack(fmt, r.at(at, head))
    body = r.at(at + head, n * width)
    tags = {}
    for i in range(n):
        tag, kind = struct.unpack_from("<HH", body, i * width)
        (count,) = struct.unpack_from("<Q" if big else "<I", body, i * width + 4)
        if kind not in TYPES:
            continue
        code = TYPES[kind]
        size = count * struct.calcsize("<" + code)
        if size <= word:
            raw = body[i * width + width - word :][:size]
        else:
            (where,) = struct.unpack_from("<Q" if big else "<I", body, i * width + width - word)
            raw = r.at(where, size)
        if kind == 2:
            tags[tag] = raw.split(b"\0")[0].decode("latin-1")
        elif len(code) == 2:
            v = struct.unpack("<" + code * count, raw)
            tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2]))
        else:
            tags[tag] = struct.unpack(f"<{count}{code}", raw)
    (nxt,) = struct.unpack("<Q" if big else "<I", r.at(at + head + n * width, word))
    return tags, nxt


def directories(r: Reader) -> list[dict[int, tuple]]:
    """All pages: the chain, each followed by its sub-directories."""
    head = r.at(0, min(16, r.size))
    if head[:2] == b"MM":
        raise FormatError(f"{r.uri}: big-endian files are not supported")
    if head[:2] != b"II" or len(head) < 8:
        raise FormatError(f"{r.uri}: no TIFF header")
    (magic,) = struct.unpack_from("<H", head, 2)
    if magic not in (42, 43):
        raise FormatError(f"{r.uri}: TIFF version {magic}")
    big = magic == 43
    (at,) = struct.unpack_from("<Q" if big else "<I", head, 8 if big else 4)
    out, seen = [], set()
    while at:
        if at in seen:
            raise FormatError(f"{r.uri}: the directory chain has a cycle")
        seen.add(at)
        tags, nxt = _directory(r, at, big)
        out.append(tags)
        for sub in tags.get(330, ()):
            if sub not in seen:
                seen.add(sub)
                out.append(_directory(r, sub, big)[0] | {-1: (1,)})
        at = nxt
    return out


def _dtype(t: dict, uri: str) -> str:
    bits, fmt = set(t.get(258, (1,))), set(t.get(339, (1,)))
    if len(bits) != 1 or len(fmt) != 1:
        raise FormatError(f"{uri}: samples of different types")
    b, f = bits.pop(), fmt.pop()
    kind = {1: "u", 2: "i", 3: "f", 6: "c"}.get(f)
    if b % 8 or kind is None or (kind == "f" and b not in (16, 32, 64)) or (kind == "c" and b not in (64, 128)) or (kind in "ui" and b not in (8, 16, 32, 64)):
        raise FormatError(f"{uri}: {b}-bit samples of format {f} are not supported")
    return ("|" if b == 8 else "<") + f"{kind}{b // 8}"


def _page(r: Reader, t: dict, path: str, chunkbytes: int, fill) -> Array:
    w, h, n = t[256][0], t[257][0], t.get(277, (1,))[0]
    comp, planar, pred = t.get(259, (1,))[0], t.get(284, (1,))[0], t.get(317, (1,))[0]
    if comp in REFUSED or comp not in COMPRESSORS:
        raise FormatError(f"{r.uri}: {path}: compression {REFUSED.get(comp, comp)} is not supported")
    if pred not in (1, 2):
        raise FormatError(f"{r.uri}: {path}: predictor {pred} is not supported")
    dtype = _dtype(t, r.uri)
    size = np.dtype(dtype).itemsize
    tiled = 324 in t
    cw, ch = (t[322][0], t[323][0]) if tiled else (w, min(t.get(278, (h,))[0], h))
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    gx, gy = -(-w // cw), -(-h // ch)
    planes = n if planar == 2 and n > 1 else 1
    if len(offsets) != gx * gy * planes:
        raise FormatError(f"{r.uri}: {path}: {len(offsets)} chunks for a grid of {gx * gy * planes}")
    per = n if planes == 1 else 1
    filters = [{"id": "tiff_predictor", "samples": per, "columns": cw}] if pred == 2 else []
    if n == 1:
        shape, chunks, dims = [h, w], [ch, cw], ["y", "x"]
    elif planes == 1:
        shape, chunks, dims = [h, w, n], [ch, cw, n], ["y", "x", "band"]
    else:
        shape, chunks, dims = [n, h, w], [1, ch, cw], ["band", "y", "x"]
    a = Array(path, dtype, shape, chunks, dims, fill, COMPRESSORS[comp], filters)
    row = w * per * size
    contiguous = all(o + c == p for o, c, p in zip(offsets, counts, offsets[1:]))
    if not tiled and comp == 1 and pred == 1 and planes == 1 and contiguous and sum(counts) == row * h:
        step = max(k for k in range(1, min(h, max(1, chunkbytes // row)) + 1) if h % k == 0)
        a.chunks = [step, *chunks[1:]]
        a.affine = (offsets[0], [step * row] + [0] * (len(shape) - 1), step * row)
        return a
    # A short last strip decodes to fewer rows; the reader pads a chunk's missing bytes.
    a.places = ((k, o, c) for k, (o, c) in enumerate(zip(offsets, counts)) if c)
    return a


def _transform(t: dict) -> np.ndarray | None:
    if 34264 in t and len(t[34264]) >= 16:
        return np.array(t[34264][:16], float)
    if 33550 in t and 33922 in t:
        (sx, sy, sz), tie = t[33550][:3], t[33922]
        return np.array([sx, 0, 0, tie[3] - tie[0] * sx, 0, -sy, 0, tie[4] + tie[1] * sy, 0, 0, sz, 0, 0, 0, 0, 1], float)
    return None


def assign(pages: list[dict]) -> list[tuple[int, int, str, int]]:
    """(image, level, role, page) of pages: a primary begins an image, smaller overviews are its
    levels by falling width, masks go with the level of their size."""
    images: list[list[int]] = []
    masks: list[tuple[int, int]] = []
    for i, t in enumerate(pages):
        sft = t.get(254, (0,))[0]
        if sft & 4:
            masks.append((len(images) - 1, i))
        elif sft & 1 or -1 in t:
            if images and t[256][0] < pages[images[-1][0]][256][0]:
                images[-1].append(i)
        else:
            images.append([i])
    out = []
    for k, own in enumerate(images):
        order = [own[0], *sorted(own[1:], key=lambda i: -pages[i][256][0])]
        out += [(k, level, "data", i) for level, i in enumerate(order)]
        for image, i in masks:
            level = next((lv for lv, j in enumerate(order) if image == k and pages[j][256] == pages[i][256] and pages[j][257] == pages[i][257]), None)
            if level is not None:
                out.append((k, level, "mask", i))
    return out


def parse(r: Reader, options: dict) -> Iterator[Array]:
    """Options: level (one level only), chunkbytes (target for contiguous strips, 8 MiB)."""
    pages = directories(r)
    placed = assign(pages)
    level = options.get("level")
    if level is not None and not any(lv == level for _, lv, _, _ in placed):
        raise FormatError(f"{r.uri}: there is no level {level}")
    many = len({k for k, _, _, _ in placed}) > 1
    primary = {k: pages[i] for k, lv, role, i in placed if lv == 0 and role == "data"}
    for k, lv, role, i in placed:
        if level is not None and lv != level:
            continue
        t, first = pages[i], primary[k]
        head = f"{k}/{lv}" if many else str(lv)
        nodata = geo.parse_nodata(t.get(42113) or first.get(42113)) if role == "data" else None
        dtype = _dtype(t, r.uri)
        fill = None if nodata is None else nodata if dtype[1] in "fc" else int(nodata) if nodata == nodata else None
        a = _page(r, t, f"{head}/{role}", options.get("chunkbytes", 8 << 20), fill)
        m = _transform(t)
        if m is None and (m := _transform(first)) is not None:
            m = m.copy()
            m[0] *= first[256][0] / t[256][0]
            m[5] *= first[257][0] / t[257][0]
        keys = geo.decode_geokeys(list(t.get(34735) or first.get(34735) or [0, 0, 0, 0]), list(t.get(34736) or first.get(34736) or []), t.get(34737) or first.get(34737) or "")
        epsg = geo.epsg_of_geokeys(keys)
        if m is not None or epsg is not None:
            a.attrs["grid_mapping"] = "spatial_ref"
        yield a
        if role == "data" and (m is not None or epsg is not None):
            attrs = {"GeoTransform": " ".join(repr(float(x)) for x in (m[3], m[0], m[1], m[7], m[4], m[5]))} if m is not None else {}
            attrs |= crs.grid_mapping(epsg, keys)
            if epsg is not None:
                attrs["spatial_epsg"] = epsg
            yield inline_array(f"{head}/spatial_ref", np.array(0, "<i4"), [], attrs)
        if role == "data" and m is not None and m[1] == 0 and m[4] == 0:
            half = 0.0 if keys.get(1025) == 2 else 0.5
            yield inline_array(f"{head}/x", m[3] + (np.arange(t[256][0]) + half) * m[0], ["x"])
            yield inline_array(f"{head}/y", m[7] + (np.arange(t[257][0]) + half) * m[5], ["y"])


register_driver("geotiff", parse, ("tif", "tiff"))
