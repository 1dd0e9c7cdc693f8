"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories (classic and BigTIFF, either byte
order), decodes PackBits, LZW or deflate strips and tiles, undoes the horizontal
predictor and puts the samples together. A writer for the same layouts is here so
that any bytes can be stored as a TIFF and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batcher, text_batches

# Fixed values of the TIFF 6.0 and BigTIFF formats.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


#: No coding yields more bytes for one: a 12-bit LZW code stands for 4096 bytes at most.
MOST_EXPANSION = 4096


class TiffError(ValueError):
    pass


#: What reading a damaged file may raise.
FAULTS = (ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error, zlib.error)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 and more equal bytes as repeats, all else as literals of up to 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cut = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], cut])
    sizes = np.diff(np.append(starts, len(a)))
    out, lit = bytearray(), 0

    def literals(to):
        nonlocal lit
        while lit < to:
            n = min(128, to - lit)
            out.append(n - 1)
            out.extend(data[lit : lit + n])
            lit += n

    for i in np.flatnonzero(sizes >= 3):
        s, n = int(starts[i]), int(sizes[i])
        literals(s)
        while n >= 2:
            k = min(128, n)
            out += bytes((257 - k, data[s]))
            s, n = s + k, n - k
        lit = s
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n == 128:
            i += 1
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc = held = 0
    out = bytearray()

    def put(code, width):
        nonlocal acc, held
        acc = (acc << width) | code
        held += width
        while held >= 8:
            held -= 8
            out.append((acc >> held) & 255)
        acc &= (1 << held) - 1

    base = {bytes((i,)): i for i in range(256)}
    table, nxt, width = dict(base), 258, 9
    put(256, 9)
    w = b""
    for i in range(len(data)):
        wc = w + data[i : i + 1]
        if wc in table:
            w = wc
            continue
        put(table[w], width)
        table[wc] = nxt
        nxt += 1
        if nxt == 4094:
            put(256, width)
            table, nxt, width = dict(base), 258, 9
        elif nxt > (1 << width) - 1 and width < 12:
            width += 1
        w = data[i : i + 1]
    if w:
        put(table[w], width)
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Most significant bit first; the code width grows one code early, as TIFF has it."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, prev = list(base), 9, None
    out = bytearray()
    acc = held = 0
    for byte in data:
        acc = ((acc << 8) | byte) & 0xFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = (acc >> held) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if prev is None:
            if code > 255:
                raise TiffError("LZW stream does not begin with a literal")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = prev + prev[:1]
            else:
                raise TiffError("LZW code out of range")
            if len(table) < 4096:
                table.append(prev + entry[:1])
        out += entry
        prev = entry
        if len(out) >= size:
            break
        if len(table) + 1 > (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out[:size])


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


DECODERS = {NONE: lambda d, n: d[:n], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: packbits_decode}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    data: bytes  # samples in row order, little-endian, planes one after another if planar


def _directory(buf: bytes, at: int, e: str, big: bool) -> tuple[dict[int, tuple], int]:
    head, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    (n,) = struct.unpack_from(e + head, buf, at)
    first = at + struct.calcsize(head)
    tags = {}
    for i in range(n):
        p = first + entry * i
        tag, kind = struct.unpack_from(e + "HH", buf, p)
        (count,) = struct.unpack_from(e + ("Q" if big else "I"), buf, p + 4)
        where = p + entry - word
        if kind in TYPE_CODES:
            size = count * struct.calcsize(TYPE_CODES[kind])
            if size > word:
                (where,) = struct.unpack_from(e + ("Q" if big else "I"), buf, where)
            if where + size > len(buf):
                raise TiffError(f"tag {tag} lies beyond the file")
            tags[tag] = struct.unpack_from(f"{e}{count}{TYPE_CODES[kind]}", buf, where)
    (nxt,) = struct.unpack_from(e + ("Q" if big else "I"), buf, first + entry * n)
    return tags, nxt


def _undo_predictor(block: np.ndarray) -> np.ndarray:
    """block: rows x columns x samples, differences along the columns, wrapping."""
    return np.cumsum(block, axis=1, dtype=block.dtype)


def _page(buf: bytes, number: int, t: dict[int, tuple], e: str) -> Page:
    one = lambda tag, default=None: t[tag][0] if tag in t else default
    w, h = one(WIDTH), one(LENGTH)
    if not w or not h:
        raise TiffError("a directory without image size")
    bits = t.get(BITS, (1,))
    spp, fmt, comp = one(SAMPLES, 1), one(SAMPLE_FORMAT, 1), one(COMPRESSION, 1)
    planar, predictor = one(PLANAR, 1), one(PREDICTOR, 1)
    if len(set(bits)) != 1 or bits[0] not in (8, 16, 32, 64):
        raise TiffError(f"bits per sample {bits}")
    if comp not in DECODERS:
        raise TiffError(f"compression {comp}")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    dt = np.dtype(f"{e}u{bits[0] // 8}")
    planes, per = (spp, 1) if planar == 2 else (1, spp)
    tiled = TILE_OFFSETS in t
    bw, bh = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[STRIP_OFFSETS], t.get(STRIP_COUNTS))
    if counts is None:
        raise TiffError("strips without byte counts")
    if not bw or not bh or not spp:
        raise TiffError("strips, tiles or pixels without size")
    nx, ny = -(-w // bw), -(-h // bh)
    if len(offsets) < nx * ny * planes:
        raise TiffError("too few strips or tiles")
    if planes * per * w * h * dt.itemsize > MOST_EXPANSION * min(len(buf), sum(counts)):
        raise TiffError("more samples than the file can hold")
    out = np.zeros((planes, h, w, per), dt)
    for k in range(nx * ny * planes):
        plane, j = divmod(k, nx * ny)
        y, x = j // nx * bh, j % nx * bw
        rows = bh if tiled else min(bh, h - y)
        size = rows * bw * per * dt.itemsize
        raw = DECODERS[comp](buf[offsets[k] : offsets[k] + counts[k]], size)
        if len(raw) < size:
            raise TiffError(f"strip or tile {k} is short")
        block = np.frombuffer(raw, dt, rows * bw * per).reshape(rows, bw, per)
        if predictor == 2:
            block = _undo_predictor(block.astype(dt.newbyteorder("=")))
        out[plane, y : y + rows, x : x + bw] = block[: h - y, : w - x]
    return Page(number, w, h, spp, bits[0], fmt, comp, out.astype(dt.newbyteorder("<")).tobytes())


def read_pages(buf: bytes) -> Iterator[Page]:
    e = {b"II": "<", b"MM": ">"}.get(bytes(buf[:2]))
    if e is None or len(buf) < 8:
        raise TiffError("no TIFF header")
    (magic,) = struct.unpack_from(e + "H", buf, 2)
    if magic not in (42, 43):
        raise TiffError(f"TIFF version {magic}")
    (at,) = struct.unpack_from(e + ("Q" if magic == 43 else "I"), buf, 8 if magic == 43 else 4)
    seen, number = set(), 0
    while at:
        if at in seen or at >= len(buf):
            raise TiffError("the directory chain does not end")
        seen.add(at)
        try:
            tags, nxt = _directory(buf, at, e, magic == 43)
            yield _page(buf, number, tags, e)
        except struct.error as err:
            raise TiffError(str(err)) from err
        at, number = nxt, number + 1


def write_page(parts: list[bytes], at: int, samples: np.ndarray, compression: int, predictor: int, tile: tuple[int, int] | None, rows_per_strip: int) -> tuple[dict, int]:
    """Append the encoded strips or tiles of one 8-bit page; its tags, and where the file now ends."""
    h, w = samples.shape
    bh, bw = tile or (min(rows_per_strip, h), w)
    offsets, counts = [], []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            block = samples[y : y + bh, x : x + bw]
            if tile and block.shape != (bh, bw):
                block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            enc = ENCODERS[compression](block.tobytes())
            parts.append(enc)
            offsets.append(at)
            counts.append(len(enc))
            at += len(enc)
    tags = {WIDTH: (4, [w]), LENGTH: (4, [h]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
    if tile:
        tags |= {TILE_WIDTH: (4, [bw]), TILE_LENGTH: (4, [bh]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)}
    else:
        tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [bh]), STRIP_COUNTS: (4, counts)}
    return tags, at


def write_tiff(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None]], rows_per_strip: int = 32) -> bytes:
    """pages: (rows x columns of uint8, compression, predictor, tile or None for strips)."""
    parts, at, directories = [b"II*\0\0\0\0\0"], 8, []
    for samples, compression, predictor, tile in pages:
        tags, at = write_page(parts, at, samples, compression, predictor, tile, rows_per_strip)
        directories.append(tags)
    links, first = [], 0
    for tags in directories:
        if at % 2:
            parts.append(b"\0")
            at += 1
        body, extra, beyond = bytearray(struct.pack("<H", len(tags))), bytearray(), at + 2 + 12 * len(tags) + 4
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
            if len(raw) > 4:
                body += struct.pack("<HHII", tag, kind, len(values), beyond + len(extra))
                extra += raw
            else:
                body += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        links.append((at, len(body), bytes(body), bytes(extra)))
        at += len(body) + 4 + len(extra)
        parts.append(links[-1])
    for i, x in enumerate(links):
        nxt = links[i + 1][0] if i + 1 < len(links) else 0
        parts[parts.index(x)] = x[2] + struct.pack("<I", nxt) + x[3]
    first = links[0][0] if links else 0
    parts[0] = b"II*\0" + struct.pack("<I", first)
    return b"".join(parts)


@dataclass(frozen=True)
class Layout:
    """How a payload is laid out: pages of `width` columns and up to `rows` rows."""

    width: int = 576
    rows: int = 256
    codecs: tuple[int, ...] = (DEFLATE, LZW, PACKBITS, NONE)  # taken in turn by a file's pages


def store_bytes(payload: bytes, layout: Layout = Layout()) -> bytes:
    """A multi-page TIFF of the payload (a positive multiple of the width): strips with
    predictor on even pages, tiles without on odd ones. The payload's crc32 says with which
    of the codecs its pages begin, so all codecs are met evenly and equal payloads are equal files."""
    begin = zlib.crc32(payload)
    image = np.frombuffer(payload, np.uint8).reshape(-1, layout.width)
    pages = []
    for i, y in enumerate(range(0, len(image), layout.rows)):
        pages.append((image[y : y + layout.rows], layout.codecs[(begin + i) % len(layout.codecs)], *((2, None) if i % 2 == 0 else (1, (64, layout.width)))))
    return write_tiff(pages, rows_per_strip=64)


def padded(data: bytes, multiple: int = 576) -> bytes:
    return data + b"\xff" * (max(multiple, -(-len(data) // multiple) * multiple) - len(data))


PAGE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("media", pa.binary()), ("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()),
    ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("data", pa.binary()), ("error", pa.string()),
])
PAGE_DDL = "doc_id long, media binary, page int, n_pages int, width int, height int, samples int, bits int, compression int, data binary, error string"


MEDIA_SCHEMA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("n_bytes", pa.int64())])
MEDIA_DDL = "doc_id long, media binary, n_bytes long"
DIGEST_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32()),
])
DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
Batches = Iterator[pa.RecordBatch]


def store(batches: Batches, layout: Layout = Layout()) -> Batches:
    """Batches of (doc_id, text) to batches of MEDIA_SCHEMA."""
    out = Batcher(MEDIA_SCHEMA)
    for b in text_batches(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = store_bytes(padded(raw, layout.width), layout)
            if out.add((doc_id, media, len(raw)), len(media)):
                yield out.flush()
    yield out.flush()


def pages_of(batches: Batches) -> Batches:
    """Batches that begin with (doc_id, media) to batches of PAGE_SCHEMA; the pages of a file
    follow each other."""
    out = Batcher(PAGE_SCHEMA)
    for b in text_batches(batches):
        for doc_id, buf in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                if not buf:
                    raise TiffError("no file")
                pages = list(read_pages(buf))
                if not pages:
                    raise TiffError("no page")
                rows = [(doc_id, buf if i == 0 else None, p.number, len(pages), p.width, p.height, p.samples, p.bits, p.compression, p.data, None) for i, p in enumerate(pages)]
            except FAULTS as err:
                rows = [(doc_id, buf, -1, 1, None, None, None, None, None, None, str(err) or type(err).__name__)]
            for row in rows:
                if out.add(row, len(row[9] or b"") + len(row[1] or b"")):
                    yield out.flush()
    yield out.flush()


def digests(batches: Batches) -> Batches:
    """Batches of PAGE_SCHEMA, a file's pages one after another, to batches of DIGEST_SCHEMA."""
    out, held, media = Batcher(DIGEST_SCHEMA), [], b""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "media", "page", "n_pages", "data", "error")]
        for doc_id, buf, page, n_pages, data, error in zip(*cols):
            if error is not None:
                raise TiffError(f"document {doc_id}: {error}")
            if page == 0:
                held, media = [], buf
            held.append(data)
            if page + 1 < n_pages:
                continue
            payload = b"".join(held)
            # UTF-8 never holds byte 255, so the padding is what rstrip takes off.
            row = (
                doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), features(payload, n_pages), n_pages,
            )
            if out.add(row, 400):
                yield out.flush()
    yield out.flush()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def texts_as_media(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty), padded, as a TIFF file."""
    return _texts(docs).mapInArrow(lambda batches: store(batches, layout), MEDIA_DDL)


def media_pages(media: DataFrame) -> DataFrame:
    """One row per page of each TIFF in column `media`. The file itself is on its first page's row.

    A null, empty or broken file gives one row with page -1 and the reason in `error`;
    pages before the fault are not emitted. Repeated rows give repeated pages, an empty table
    none; other columns are ignored.
    """
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(pages_of, PAGE_DDL)


def features(payload: bytes, n_pages: int) -> str:
    """Size, mean and a sixteen-bin histogram of the samples."""
    a = np.frombuffer(payload, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    return f"pages={n_pages};n={len(a)};mean={a.mean() if len(a) else 0:.4f};hist=" + ",".join(map(str, bins))


def media_digest(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Store each text as media, read it back page by page, and digest what was read.

    The three steps pass batches on within one task, so the pages of a file reach the digest
    one after another whatever Spark does with rows, and nothing is shuffled or grouped.
    Null texts are empty; equal texts have equal values; an empty table gives no rows.
    """
    return _texts(docs).mapInArrow(lambda batches: digests(pages_of(store(batches, layout))), DIGEST_DDL)
