"""TIFF as a media column: a page walker, decoders for PackBits, LZW and deflate strips and tiles, and a writer.

``tiff_pages`` gives one row for each page of each file; ``tiff_documents`` folds the same walk into one row
a file; ``text_to_tiff`` stores UTF-8 payloads as 8-bit samples. Files are decoded one at a time inside Arrow
batches: a worker holds one piece of a batch, never a group of rows.

Defined results. A null or empty file, a broken header or a directory chain that is cut short gives a row with
``error`` set (page 0 for files without any page) and null samples; pages before the fault are still given. A page
that cannot be decoded is such a row in its place, and the walk goes on with the next directory. Samples of 1, 2
and 4 bits are given one a byte. A
directory chain that comes back to itself ends there with an error. Extra columns are carried only if named.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_of

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
COMPRESSION_NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC = 256, 257, 258, 259, 262
_FILL_ORDER = 266
_STRIP_OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _STRIP_COUNTS = 273, 277, 278, 279
_PLANAR, _PREDICTOR = 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_TYPES = {1: "B", 3: "H", 4: "I"}
_TYPE_BYTES = {1: 1, 3: 2, 4: 4}
#: A page of more bytes is a fault, not an allocation; a dimension of more does not fit its column.
MOST_PAGE_BYTES, MOST_SIDE = 1 << 28, (1 << 31) - 1
_CLEAR, _END, _FIRST = 256, 257, 258
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


class TiffError(ValueError):
    """What is wrong with a file."""


# ---------------------------------------------------------------- compression


def packbits_encode(row: bytes) -> bytes:
    """Runs of three or more as runs, the rest literally, for one row."""
    out, at = bytearray(), 0
    for m in _RUN.finditer(row):
        _literal(out, row[at : m.start()])
        out += bytes((257 - (m.end() - m.start()), row[m.start()]))
        at = m.end()
    _literal(out, row[at:])
    return bytes(out)


def _literal(out: bytearray, plain: bytes) -> None:
    for i in range(0, len(plain), 128):
        part = plain[i : i + 128]
        out.append(len(part) - 1)
        out += part


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, end, held = [], 0, len(data), 0
    while i < end and held < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
            held += n + 1
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
            held += 257 - n
        else:
            i += 1
    return b"".join(out)


def _lzw_widths(n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code; widths grow one code early."""
    following = _FIRST + np.arange(n)
    return 9 + (following >= 512) + (following >= 1024) + (following >= 2048)


_LZW_WIDTHS = _lzw_widths(4096)


def lzw_encode(data: bytes) -> bytes:
    """MSB-first variable-width codes; the table is cleared before it is full."""
    codes, widths = [_CLEAR], [np.array([9])]
    i, n = 0, len(data)
    while i < n:
        table: dict[int, int] = {}
        get, following, begun, cur = table.get, _FIRST, len(codes), data[i]
        i += 1
        while i < n and following < 4094:
            key = (cur << 8) | data[i]
            longer = get(key)
            if longer is None:
                codes.append(cur)
                table[key] = following
                following += 1
                cur = data[i]
            else:
                cur = longer
            i += 1
        codes.append(cur)
        widths.append(_LZW_WIDTHS[: len(codes) - begun])
        if i < n:
            codes.append(_CLEAR)
            widths.append(np.array([12]))
    codes.append(_END)
    widths.append(_LZW_WIDTHS[len(widths[-1]) : len(widths[-1]) + 1] if n else np.array([9]))
    code, width = np.array(codes, np.int32), np.concatenate(widths)
    shift = width[:, None] - 1 - np.arange(12)
    bits = (code[:, None] >> np.maximum(shift, 0)) & 1
    return np.packbits(bits[shift >= 0].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """The bytes of an LZW stream; decoding ends with the table in which ``size`` bytes are reached."""
    held = 0
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    at, end, out = 0, 8 * len(data), []
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    while True:
        places = at + np.concatenate([[0], np.cumsum(_LZW_WIDTHS)])
        fit = int(np.searchsorted(places, end, "right")) - 1
        if fit <= 0:
            break
        p, w = places[:fit], _LZW_WIDTHS[:fit]
        i = p >> 3
        codes = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) >> (24 - (p & 7) - w)) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        stop = int(stops[0]) if len(stops) else fit
        table, last = list(base), b""
        add, emit = table.append, out.append
        for code in codes[:stop].tolist():
            if last:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise TiffError("LZW code out of range")
                add(last + entry[:1])
            elif code < _CLEAR:
                entry = base[code]
            else:
                raise TiffError("LZW code out of range")
            emit(entry)
            last = entry
        held += sum(map(len, out[-stop:])) if stop else 0
        if stop == fit or codes[stop] == _END or size is not None and held >= size:
            break
        at = int(places[stop + 1])
    return b"".join(out)


def _decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size) if size else b""
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {how} is not supported")


# ---------------------------------------------------------------- reading


@dataclass
class Fault:
    """A page that cannot be decoded."""

    page: int
    error: str


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def _next(file: bytes, at: int, order: str) -> int:
    """The place of the directory after the one at ``at``, 0 after the last."""
    if at + 2 > len(file):
        raise TiffError("directory outside the file")
    (n,) = struct.unpack_from(order + "H", file, at)
    if at + 6 + 12 * n > len(file):
        raise TiffError("directory is cut short")
    return struct.unpack_from(order + "I", file, at + 2 + 12 * n)[0]


def _fields(file: bytes, at: int, order: str) -> dict[int, tuple[int, ...]]:
    (n,) = struct.unpack_from(order + "H", file, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", file, at + 2 + 12 * i)
        if kind not in _TYPES or not count:
            continue
        size, place = count * _TYPE_BYTES[kind], at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", file, place)
        if place + size > len(file):
            raise TiffError(f"values of tag {tag} outside the file")
        out[tag] = struct.unpack_from(f"{order}{count}{_TYPES[kind]}", file, place)
    return out


def _block(file: bytes, at: int, n: int, how: int, predictor: int, shape: tuple[int, int, int], kind: np.dtype, bits: int, reverse: bool) -> np.ndarray:
    """Samples of one strip or tile, rows x columns x samples."""
    if at + n > len(file):
        raise TiffError("samples outside the file")
    wide = -(-shape[1] * shape[2] * bits // 8)  # rows begin at whole bytes
    size = shape[0] * wide
    if size > MOST_PAGE_BYTES:
        raise TiffError("a strip or tile is too large")
    data = file[at : at + n]
    plain = _decompress(data.translate(_REVERSED) if reverse else data, how, size)
    if len(plain) < size:
        raise TiffError("a strip or tile is cut short")
    if bits < 8:
        if predictor != 1:
            raise TiffError(f"predictor {predictor} is not supported for {bits} bits")
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        each = (np.frombuffer(plain, np.uint8, size).reshape(shape[0], wide, 1) >> shifts) & ((1 << bits) - 1)
        return each.reshape(shape[0], -1)[:, : shape[1] * shape[2]].reshape(shape)
    got = np.frombuffer(plain, kind, shape[0] * shape[1] * shape[2]).reshape(shape)
    if predictor == 2:
        return np.cumsum(got, axis=1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return got


def _page(file: bytes, number: int, f: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, default: f.get(tag, (default,))[0]
    if _WIDTH not in f or _HEIGHT not in f:
        raise TiffError("no width or height")
    width, height, samples = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
    bits, how, predictor, planar = one(_BITS, 1), one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(f.get(_BITS, (bits,)))) > 1:
        raise TiffError(f"{bits} bits a sample are not supported")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    reverse = bits < 8 and one(_FILL_ORDER, 1) == 2
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE and samples):
        raise TiffError(f"{width} x {height} pixels of {samples} samples are not supported")
    if width * height * samples * kind.itemsize > MOST_PAGE_BYTES:
        raise TiffError("the page is too large")
    tiled = _TILE_OFFSETS in f
    if tiled:
        tw, th = one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0)
        if not tw or not th:
            raise TiffError("no tile size")
        offsets, counts = f[_TILE_OFFSETS], f.get(_TILE_COUNTS, ())
        need = -(-height // th) * -(-width // tw)
    else:
        rows = min(one(_ROWS_PER_STRIP, height), height) or 1
        offsets, counts = f.get(_STRIP_OFFSETS, ()), f.get(_STRIP_COUNTS, ())
        need = -(-height // rows)
    # before anything of the size that the directory claims is made
    if len(offsets) < planes * need or len(counts) < planes * need:
        raise TiffError("fewer strips or tiles than the page needs")
    grid = [(y, x, th, tw) for y in range(0, height, th) for x in range(0, width, tw)] if tiled else [(y, 0, min(rows, height - y), width) for y in range(0, height, rows)]
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    for p in range(planes):
        for i, (y, x, h, w) in enumerate(grid):
            k = p * len(grid) + i
            got = _block(file, offsets[k], counts[k], how, predictor, (h, w, deep), kind, bits, reverse)
            image[y : y + h, x : x + w, p if planes > 1 else slice(None)] = got[: height - y, : width - x, 0 if planes > 1 else slice(None)]
    return Page(number, width, height, samples, bits, how, predictor, tiled, image.tobytes())


def walk(file: bytes | None) -> Iterator[Page | Fault]:
    """The pages of a file in directory order; a fault of one page does not end the walk."""
    if not file or len(file) < 8:
        raise TiffError("not a TIFF file")
    order = {b"II": "<", b"MM": ">"}.get(bytes(file[:2]))
    if order is None or struct.unpack_from(order + "H", file, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", file, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a circle")
        seen.add(at)
        following = _next(file, at, order)
        try:
            page = _page(file, len(seen) - 1, _fields(file, at, order), order)
        except (ValueError, IndexError, OverflowError, struct.error) as e:  # a TiffError is a ValueError
            page = Fault(len(seen) - 1, str(e) or type(e).__name__)
        yield page
        at = following


# ---------------------------------------------------------------- writing


@dataclass(frozen=True)
class Form:
    """How samples are stored."""

    compression: int
    predictor: int = 1
    tiled: bool = False


#: The forms that stored payloads take by their checksum: each compression a third, in strips and tiles, with and without
#: a predictor where the format has one (not for PackBits).
FORMS = tuple(Form(how, p if how != PACKBITS else 1, tiled) for how in (PACKBITS, LZW, DEFLATE) for p in (1, 2) for tiled in (False, True))
PAGE_ROWS, STRIP_ROWS, TILE = 1024, 256, 64


def _compress(block: np.ndarray, form: Form) -> bytes:
    if form.predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
    if form.compression == PACKBITS:
        if block.shape[1] <= 128 and not _RUN.search(block.tobytes()):
            return np.concatenate([np.full((len(block), 1), block.shape[1] - 1, np.uint8), block], axis=1).tobytes()
        return b"".join(packbits_encode(row.tobytes()) for row in block)
    plain = block.tobytes()
    return lzw_encode(plain) if form.compression == LZW else zlib.compress(plain, 1) if form.compression == DEFLATE else plain


def write_tiff(pages: list[np.ndarray], form: Form) -> bytes:
    """Little-endian file of 8-bit single-sample pages (rows x columns)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in pages:
        height, width = image.shape
        if form.tiled:
            full = np.zeros((-(-height // TILE) * TILE, -(-width // TILE) * TILE), np.uint8)
            full[:height, :width] = image
            blocks = [full[y : y + TILE, x : x + TILE] for y in range(0, full.shape[0], TILE) for x in range(0, full.shape[1], TILE)]
        else:
            blocks = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for b in blocks:
            data = _compress(b, form)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        arrays = []
        for values in (offsets, counts):
            arrays.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        n = len(blocks)
        fields = [(_WIDTH, 4, 1, width), (_HEIGHT, 4, 1, height), (_BITS, 3, 1, 8), (_COMPRESSION, 3, 1, form.compression), (_PHOTOMETRIC, 3, 1, 1), (_SAMPLES, 3, 1, 1), (_PREDICTOR, 3, 1, form.predictor)]
        if form.tiled:
            fields += [(_TILE_WIDTH, 3, 1, TILE), (_TILE_HEIGHT, 3, 1, TILE), (_TILE_OFFSETS, 4, n, arrays[0]), (_TILE_COUNTS, 4, n, arrays[1])]
        else:
            fields += [(_STRIP_OFFSETS, 4, n, arrays[0]), (_ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (_STRIP_COUNTS, 4, n, arrays[1])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, kind, count, value in sorted(fields):
            out += struct.pack("<HHII", tag, kind, count, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """The bytes with zeros up to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit or (0 if text else unit))


def store_payload(payload: bytes, width: int = 64) -> bytes:
    """A payload as pages of ``width`` columns; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    form = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], form)


# ---------------------------------------------------------------- DataFrame operators


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [x.as_buffer().to_pybytes() for x in batch.column("text")]
        media = [store_payload(payload_of(x)) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def text_to_tiff(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, media)``, the padded UTF-8 text as a TIFF file.

    A null text is stored like an empty one, whole texts are stored however long; equal texts give equal files. Repeated rows and null ids come
    out as they are, an empty table gives an empty one, and no other column is read.
    """
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


_PAGE_SCHEMA = "doc_id long, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PAGE_SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    for batch in pieces(batches, "media"):
        rows, held = [], 0
        for key, media in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            page = 0
            try:
                for p in walk(media.as_buffer().to_pybytes() if media.is_valid else None):
                    page = p.page + 1
                    if isinstance(p, Fault):
                        rows.append((key, p.page, *[None] * 8, p.error))
                        continue
                    rows.append((key, p.page, p.width, p.height, p.samples, p.bits, COMPRESSION_NAMES[p.compression], p.predictor, p.tiled, p.pixels, None))
                    held += len(p.pixels)
                    if held > 4_000_000:
                        yield made(rows)
                        rows, held = [], 0
            except TiffError as e:
                rows.append((key, page, *[None] * 8, str(e)))
        if rows:
            yield made(rows)


def tiff_pages(files: DataFrame) -> DataFrame:
    """``files(doc_id, media, ...)`` -> one row for each page, with its samples in row order."""
    return files.select("doc_id", "media").mapInArrow(_paged, _PAGE_SCHEMA)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "media"):
        rows = []
        for media in batch.column("media"):
            file = media.as_buffer().to_pybytes() if media.is_valid else b""
            digest, pages, size, tail, total, square, forms, error = hashlib.sha256(), 0, 0, b"", 0, 0, set(), None
            try:
                for p in walk(file):
                    if isinstance(p, Fault):
                        error = error or f"page {p.page}: {p.error}"
                        continue
                    pages, size = pages + 1, size + len(p.pixels)
                    digest.update(p.pixels)
                    tail = (tail + p.pixels)[-64:]
                    x = np.frombuffer(p.pixels, np.uint8).astype(np.int64)
                    total, square = total + int(x.sum()), square + int((x * x).sum())
                    forms.add(f"{COMPRESSION_NAMES[p.compression]}/{p.predictor}/{'tiles' if p.tiled else 'strips'}/{p.width}")
            except TiffError as e:
                error = error or str(e)
            mean = total / size if size else 0.0
            feature = f"pages={pages};form={','.join(sorted(forms))};mean={mean:.4f};var={square / size - mean * mean if size else 0.0:.3f}"
            rows.append((pages, size, digest.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature, error))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["n_pages", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], ["doc_id", "n_bytes", *names])


def tiff_documents(files: DataFrame) -> DataFrame:
    """``files(doc_id, n_bytes, media, ...)`` -> one row a file: its pages walked, decoded and folded in order.

    A null or damaged file is a row with ``error``, as far as it could be read. Repeated rows and null ids come out as they are, an empty
    table gives an empty one, and no other column is read.
    """
    return files.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(
        _folded,
        "doc_id long, n_bytes long, n_pages long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )
