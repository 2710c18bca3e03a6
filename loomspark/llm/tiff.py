"""Media columns: a TIFF reader (and the writer its round trips need)."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import pieces
from loomspark.shipping import map_arrow

# Tags, compressions and predictors of the TIFF 6.0 specification and its supplements.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 18: "Q"}

#: Pages of a file and bytes of a page that are decoded at most, as a file may claim any size; beyond that the file is an error.
PAGES, PAGE_BYTES = 100_000, 1 << 30


class TiffError(ValueError):
    """The bytes are not a TIFF that can be read."""


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(end, a + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes((257 - (m.end() - m.start()), m[1][0]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def _lzw_widths() -> np.ndarray:
    """The width of each code after a clear code, by its place; codes widen one early, and the table has 4096 entries at most."""
    entries = 257 + np.arange(4096 - 257)
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


_WIDTHS = _lzw_widths()
_ENDS = np.cumsum(_WIDTHS)
_SINGLES = [bytes((i,)) for i in range(256)] + [b"", b""]


def unpack_lzw(data: bytes) -> bytes:
    """Codes are cut out a run between clear codes at a time, as their widths follow from their place in it."""
    held = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    bits, out = 8 * len(data), []
    at = 9 if bits >= 9 and (held[0] << 1 | held[1] >> 7) == 256 else 0
    while True:
        fit = int(np.searchsorted(_ENDS, bits - at, side="right"))
        widths, starts = _WIDTHS[:fit], at + _ENDS[:fit] - _WIDTHS[:fit]
        byte = starts >> 3
        codes = (held[byte] << 16 | held[byte + 1] << 8 | held[byte + 2]) >> (24 - (starts & 7) - widths) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes | 1) == 257)
        end = int(stop[0]) if len(stop) else fit
        table, last = list(_SINGLES), b""
        for code in codes[:end].tolist():
            if not last:
                if code > 255:
                    raise TiffError("bad LZW code")
                word = _SINGLES[code]
            elif code < len(table):
                word = table[code]
                table.append(last + word[:1])
            elif code == len(table):
                word = last + last[:1]
                table.append(word)
            else:
                raise TiffError("bad LZW code")
            out.append(word)
            last = word
        if end == len(_WIDTHS):
            raise TiffError("LZW data go on without a clear code")
        if end == fit or codes[end] == 257:
            return b"".join(out)
        at = int(starts[end] + widths[end])


def pack_lzw(data: bytes) -> bytes:
    """Codes are found byte by byte, then written by their widths all at once."""
    runs: list[list[int]] = [[]]
    table: dict[int, int] = {}
    entries, word, put = 258, -1, runs[0].append
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        found = table.get(key)
        if found is not None:
            word = found
            continue
        put(word)
        table[key] = entries
        entries += 1
        word = byte
        if entries == 4095:  # as good as full: a new run
            runs.append([])
            table, entries, put = {}, 258, runs[-1].append
    if word >= 0:
        put(word)
    codes = np.array([256] + [c for i, run in enumerate(runs) for c in (*run, 256 if i + 1 < len(runs) else 257)], np.int64)
    widths = np.concatenate([_WIDTHS[:1], *[_WIDTHS[: len(run) + 1] for run in runs]])
    place = np.arange(12)
    bits = (codes[:, None] >> np.maximum(widths[:, None] - 1 - place, 0)) & 1
    return np.packbits(bits[place < widths[:, None]].astype(np.uint8)).tobytes()


_PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}
_UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: lambda b: zlib.decompress(b), OLD_DEFLATE: lambda b: zlib.decompress(b), PACKBITS: unpack_bits}


def write(pages: Sequence[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of images (height x width [x samples]) of unsigned 8-, 16- or 32-bit samples, or of 0 and 1 as booleans, in strips or in tiles of (height, width).

    predictor is 1 (none), 2 (differences) or, for 16 and 32 bits in big-endian
    order, 3 (differences of the samples' bytes, laid out by significance).
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        image = image if image.dtype == bool else image.astype(image.dtype.newbyteorder(order))
        if tile:
            th, tw = tile
            full = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), image.dtype)
            full[:height, :width] = image
            parts = [full[y : y + th, x : x + tw] for y in range(0, len(full), th) for x in range(0, full.shape[1], tw)]
        else:
            parts = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                moved = part.copy()
                moved[:, 1:] = part[:, 1:] - part[:, :-1]
                part = moved
            elif predictor == 3:
                size = image.dtype.itemsize
                wide = np.ascontiguousarray(part.astype(f">u{size}")).view(np.uint8).reshape(len(part), -1, size).transpose(0, 2, 1).reshape(len(part), -1, samples)
                part = wide.copy()
                part[:, 1:] = wide[:, 1:] - wide[:, :-1]
            if image.dtype == bool:
                part = np.packbits(part.reshape(len(part), -1), axis=1)
            data = _PACK[compression](np.ascontiguousarray(part).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        bits = 1 if image.dtype == bool else image.dtype.itemsize * 8
        entries = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [bits] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [2 if samples >= 3 else 1]), SAMPLES: ("H", [samples]), PREDICTOR: ("H", [predictor])}
        if tile:
            entries |= {TILE_WIDTH: ("I", [tile[1]]), TILE_HEIGHT: ("I", [tile[0]]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", counts)}
        else:
            entries |= {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [rows_per_strip]), STRIP_COUNTS: ("I", counts)}
        fields = b""
        for tag in sorted(entries):
            kind, values = entries[tag]
            data = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(data) > 4:
                out += bytes(len(out) % 2)
                fields += struct.pack(order + "HHII", tag, 3 if kind == "H" else 4, len(values), len(out))
                out += data
            else:
                fields += struct.pack(order + "HHI", tag, 3 if kind == "H" else 4, len(values)) + data.ljust(4, b"\0")
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + fields
        link = len(out)
        out += bytes(4)
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _KINDS:
            continue
        form = f"{order}{count}{_KINDS[kind]}"
        size = struct.calcsize(form)
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if size > len(data):
            raise TiffError("a field is longer than the file")
        fields[tag] = struct.unpack_from(form, data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, following


def _image(data: bytes, order: str, f: dict[int, tuple]) -> Page:
    one = lambda tag, default: f.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, tiled = one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in f
    if bits not in (1, 2, 4, 8, 16, 32, 64) or bits < 8 and predictor != 1 or len(set(f.get(BITS, (bits,)))) > 1:
        raise TiffError(f"samples of {bits} bits aren't read")
    if compression not in _UNPACK or predictor not in (1, 2, 3):
        raise TiffError(f"compression {compression} with predictor {predictor} isn't read")
    if width * height * samples * max(8, bits) // 8 > PAGE_BYTES:
        raise TiffError("a page is too large")
    planes, inner = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    image = np.zeros((height, width, samples), kind)
    if tiled:
        th, tw, offsets, counts = one(TILE_HEIGHT, height), one(TILE_WIDTH, width), f[TILE_OFFSETS], f[TILE_COUNTS]
    else:
        th, tw, offsets = min(one(ROWS_PER_STRIP, height), height), width, f[STRIP_OFFSETS]
        counts = f.get(STRIP_COUNTS, (len(data),) * len(offsets))
    places = [(p, y, x) for p in range(planes) for y in range(0, height, max(th, 1)) for x in range(0, width, max(tw, 1))]
    if len(places) > len(offsets) or len(offsets) > len(counts):
        raise TiffError("strips or tiles are missing")
    for (p, y, x), offset, count in zip(places, offsets, counts):
        rows = th if tiled else min(th, height - y)
        raw = _UNPACK[compression](data[offset : offset + count])
        line = tw * inner * kind.itemsize if bits >= 8 else -(-tw * inner * bits // 8)
        need = rows * line
        if len(raw) < need:
            raise TiffError("a strip or tile is too short")
        if bits < 8:  # samples of less than a byte; each line begins with a whole one
            ones = np.unpackbits(np.frombuffer(raw[:need], np.uint8).reshape(rows, line), axis=1)[:, : tw * inner * bits].reshape(rows, tw, inner, bits)
            part = (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        elif predictor == 3:
            planes_of = np.frombuffer(raw[:need], np.uint8).reshape(rows, tw * inner * kind.itemsize)
            summed = np.cumsum(planes_of.reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, tw * inner)
            part = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">u{kind.itemsize}").reshape(rows, tw, inner)
        else:
            part = np.frombuffer(raw[:need], kind).reshape(rows, tw, inner)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        h, w = min(rows, height - y), min(tw, width - x)
        image[y : y + h, x : x + w, p : p + inner] = part[:h, :w]
    return Page(width, height, samples, bits, compression, predictor, tiled, image.tobytes())


def read(data: bytes) -> list[Page]:
    """The pages of a TIFF, in the order of its directories; samples keep the file's byte order, and those of less than a byte get one each."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    pages, seen = [], set()
    try:
        while at:
            if at in seen or len(pages) >= PAGES:
                raise TiffError("the directories don't end")
            seen.add(at)
            fields, at = _directory(data, order, at)
            pages.append(_image(data, order, fields))
    except (struct.error, zlib.error, KeyError, IndexError) as e:
        raise TiffError(f"broken: {e}") from e
    return pages


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, error string, pixels binary, histogram array<int>"


def read_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each TIFF in a binary column, with the columns of PAGE_SCHEMA beside media's own (which give way to those names).

    histogram counts the bytes of all samples by their upper four bits. A null,
    empty or broken file gives one row with page -1, an error and null pixels,
    as does one of more than PAGES pages or with a page of more than PAGE_BYTES;
    a file without pages gives none. Repeated rows are read alike, and an empty
    table gives no rows.
    """
    own = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    media = media.drop(*[x for x in own if x != column])
    names, place = media.columns, media.columns.index(column)
    kinds = [*[pa.int32()] * 7, pa.bool_(), pa.string(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, 4 << 20):
                rows, source = [], []
                for i, x in enumerate(piece.column(place)):
                    try:
                        found = [(n, *p[:7], None, p.pixels, np.bincount(np.frombuffer(p.pixels, np.uint8) >> 4, minlength=16)) for n, p in enumerate(read(x.as_py() or b""))]
                    except TiffError as e:
                        found = [(-1, *[None] * 7, str(e), None, None)]
                    rows += found
                    source += [i] * len(found)
                if rows:
                    kept = piece.take(pa.array(source, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[*names, *own])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return map_arrow(media, run, f"{fields}, {PAGE_SCHEMA}")


ROW = 192


def image_of(text: str | None) -> bytes:
    """A text as a TIFF of 8-bit samples, ROW wide: its UTF-8 bytes, filled up with spaces to a positive multiple of ROW.

    The bytes' checksum chooses between deflate strips with a predictor,
    deflate tiles, PackBits strips and LZW strips, so that equal texts have
    equal files.
    """
    data = (text or "").encode("utf-8", "replace")
    data = data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")
    image = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    way = zlib.crc32(data) % 4
    return write([image], compression=(DEFLATE, DEFLATE, PACKBITS, LZW)[way], predictor=2 if way == 0 else 1, tile=(64, 64) if way == 1 else None)


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 length and its image_of.

    Null texts are empty ones. A text is one page however long it is; one above
    PAGE_BYTES could not be read back. Null ids and repeated rows have rows of
    their own; no rows give no rows; other columns are ignored.
    """
    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                texts = piece.column("text").to_pylist()
                sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array([image_of(t) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_arrow(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")
