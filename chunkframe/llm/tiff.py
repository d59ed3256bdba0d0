"""TIFF pages: walk the image directories, decode strips or tiles, undo predictors, one row per page.

Read: both byte orders, chained directories, strips and tiles, chunky and planar samples of
8, 16 or 32 bits (unsigned, or 32-bit float), no compression, PackBits, LZW and deflate, the
horizontal and the floating-point predictor. Written (for round trips): 8-bit grey pages in
strips or tiles with any of these four.

Defined cases: a null or malformed file gives one row with ``error`` set and null pixels, and so does one whose
directory promises more pixels than its bytes can hold, or none; a very long text is a file of many pages; an
empty table gives an empty result; repeated rows give repeated rows and ties equal values; a column named like the results
cannot be the key, others are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map

# Fixed values of the format: tag numbers, compression numbers, bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, T_WIDTH, T_HEIGHT, T_OFFSETS, T_COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: No compression here makes more than so many bytes of one (LZW: 4095 from 12 bits).
MOST_EXPANDED = 2731
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count byte, then that many literal bytes or one to repeat."""
    out, i, n, end = [], 0, 0, len(data)
    while n < size and i < end:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i, n = i + 2 + k, n + k + 1
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i, n = i + 2, n + 257 - k
        else:
            i += 1
    return b"".join(out)[:size]


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as repeats, everything else as literals."""
    a = np.frombuffer(data, np.uint8)
    cut = np.concatenate(([0], np.nonzero(np.diff(a))[0] + 1, [len(a)])) if len(a) else np.array([0])
    long = np.nonzero(np.diff(cut) >= 3)[0]
    out, at = [], 0

    def literal(stop: int) -> None:
        for i in range(at, stop, 128):
            out.append(bytes([min(128, stop - i) - 1]) + data[i : min(stop, i + 128)])

    for k in long.tolist():
        start, stop = int(cut[k]), int(cut[k + 1])
        literal(start)
        for i in range(start, stop, 128):
            n = min(128, stop - i)
            out.append(bytes([257 - n if n > 1 else 0, data[start]]))
        at = stop
    literal(len(data))
    return b"".join(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, n, bits, held, width, last = first[:], [], 0, 0, 0, 9, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = first[:], 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        n += len(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if n >= size:
            break
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """The writer's side of ``lzw_decode``."""
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    new = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = new
        new += 1
        if new == 4095:
            put(256, 12)
            table, width, new = {bytes([k]): k for k in range(256)}, 9, 258
        elif new >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        new += 1
        if new >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if held:
        put(0, 8 - held)
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)  # no more than asked for
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    raise ValueError(f"compression {compression}")


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags: dict[int, tuple] = {}
        entries = struct.unpack_from(order + "H", data, at)[0]
        for e in range(at + 2, at + 2 + 12 * entries, 12):
            tag, kind, n = struct.unpack_from(order + "HHI", data, e)
            if kind in TYPES:
                form = f"{order}{n}{TYPES[kind]}"
                where = e + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
                tags[tag] = struct.unpack_from(form, data, where)
        yield _page(data, order, tags, len(seen) - 1)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * entries)[0]


def _page(data: bytes, order: str, tags: dict[int, tuple], number: int) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples, bits = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and samples > 1
    base = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4"}.get((bits, one(FORMAT, 1)))
    if base is None:
        raise ValueError(f"{bits} bits a sample, sample format {one(FORMAT, 1)}")
    kind, planes, deep = np.dtype(order + base), samples if planar else 1, 1 if planar else samples
    tiled = T_OFFSETS in tags
    wide, high = (tags[T_WIDTH][0], tags[T_HEIGHT][0]) if tiled else (width, min(one(ROWS, height), height))
    offsets, counts = (tags[T_OFFSETS], tags[T_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    if min(width, height, samples, wide, high) < 1:
        raise ValueError(f"page {number}: an extent of 0")
    if width * height * samples * kind.itemsize > MOST_EXPANDED * len(data):
        raise ValueError(f"page {number}: more pixels than {len(data)} bytes can hold")
    if tiled and wide * high > MOST_EXPANDED * len(data):
        raise ValueError(f"page {number}: larger tiles than {len(data)} bytes can hold")
    across, down = -(-width // wide), -(-height // high)
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    for plane in range(planes):
        for k in range(across * down):
            y, x = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - y)
            i = plane * across * down + k
            size = rows * wide * deep * kind.itemsize
            raw = expand(data[offsets[i] : offsets[i] + counts[i]], compression, size)
            if len(raw) != size:
                raise ValueError(f"page {number}, part {k}: {len(raw)} bytes of {size}")
            if predictor == 3:  # bytes by significance, differences along the row
                part = np.frombuffer(raw, np.uint8).reshape(rows, -1, deep)
                part = np.add.accumulate(part, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, wide * deep)
                part = np.ascontiguousarray(part.transpose(0, 2, 1)).view(">" + base).reshape(rows, wide, deep)
            else:
                part = np.frombuffer(raw, kind).reshape(rows, wide, deep)
                if predictor == 2:
                    part = np.add.accumulate(part.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
            part = part[: height - y, : width - x]
            at = slice(plane, plane + 1) if planar else slice(None)
            image[y : y + part.shape[0], x : x + part.shape[1], at] = part
    return Page(number, width, height, samples, bits, compression, image)


def write_grey(images: list[np.ndarray], compression: int | list[int] = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = 64, order: str = "<") -> bytes:
    """A file of 8-bit grey pages, in strips of ``rows`` or tiles of ``tile`` (a multiple of 16); ``compression``: of all, or of each."""
    by_number = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits, LZW: lzw_encode}
    each = [compression] * len(images) if isinstance(compression, int) else compression
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, compression in zip(images, each, strict=True):
        shrink = by_number[compression]
        height, width = image.shape
        high, wide = (tile, tile) if tile else (rows, width)
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = image[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part.dtype.type(0))
                raw = shrink(part.tobytes())
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {T_WIDTH: [wide], T_HEIGHT: [high], T_OFFSETS: offsets, T_COUNTS: counts} if tile else {OFFSETS: offsets, ROWS: [high], COUNTS: counts}
        entries = []
        for tag, v in sorted(tags.items()):
            value = struct.pack(f"{order}{len(v)}I", *v)
            if len(value) > 4:
                value, at = struct.pack(order + "I", len(out)), value
                out += at
            entries.append(struct.pack(order + "HHI", tag, 4, len(v)) + value)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def feature(image: np.ndarray) -> str:
    """Mean, spread, mean step along rows, and a 64-bit hash of which of 8 by 8 cells are over the mean."""
    a = image.reshape(image.shape[0], -1)
    edges = lambda n: np.unique(np.linspace(0, n, 9).astype(int)[:-1])
    rows, cols = edges(a.shape[0]), edges(a.shape[1])
    sums = np.add.reduceat(np.add.reduceat(a, rows, axis=0, dtype=np.int64), cols, axis=1)
    sizes = np.outer(np.diff([*rows, a.shape[0]]), np.diff([*cols, a.shape[1]]))
    mean = int(sums.sum()) / a.size
    bits = 0
    for b in (sums > mean * sizes).ravel():
        bits = bits << 1 | int(b)
    counts = np.bincount(a.ravel(), minlength=256) if a.dtype == np.uint8 else None
    spread = float(np.sqrt(max(0.0, float((counts * np.arange(256.0) ** 2).sum()) / a.size - mean * mean))) if counts is not None else float(a.std())
    step = float(np.abs(np.diff(a.astype(np.int16) if a.dtype == np.uint8 else a.astype(float), axis=1)).mean()) if a.shape[1] > 1 else 0.0
    return f"{mean:.3f};{spread:.3f};{step:.3f};{bits:016x}"


def tiff_pages(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, page, width, height, samples, bits, compression, pixels, feature, error), one row per page."""
    kind = dict(files.dtypes)[key]
    names = ("page", "width", "height", "samples", "bits", "compression", "pixels", "feature", "error")

    def run(x):
        out = {k: [] for k in (key, *names)}
        for k, data in zip(x[key], x[column], strict=True):
            rows = []
            try:
                rows = [(p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), feature(p.pixels), None) for p in pages(data or b"")]
            except (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error, zlib.error) as e:
                rows.append((*[None] * 8, f"{type(e).__name__}: {e}"[:200]))
            for row in rows:
                out[key].append(k)
                for name, v in zip(names, row, strict=True):
                    out[name].append(v)
        return out

    return arrow_map(files.select(key, column), run, f"`{key}` {kind}, page int, width int, height int, samples int, bits int, compression int, pixels binary, feature string, error string")


#: The query's files: pages 576 samples wide. The first has a row by LZW, the second one by PackBits, all others at most so many rows by deflate.
PAYLOAD_WIDTH, PAGE_ROWS = 576, 4096


def text_files(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a TIFF file, padded with 255 to whole rows.

    All files are laid out alike, so that each decoder is at work: a page for the first row, by LZW, one for the
    second, by PackBits, and pages of up to ``PAGE_ROWS`` for the rest, by deflate; all with differences along the rows.
    """

    def run(x):
        out = {"doc_id": x["doc_id"], "n_bytes": [], "media": []}
        for t in x["text"]:
            raw = (t or "").encode()
            payload = raw + b"\xff" * (PAYLOAD_WIDTH - len(raw) if not raw else -len(raw) % PAYLOAD_WIDTH)
            image = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH)
            cuts = [0, 1, *range(2, len(image), PAGE_ROWS)]
            parts = [p for p in np.split(image, cuts[1:]) if len(p)]
            out["n_bytes"].append(len(raw))
            out["media"].append(write_grey(parts, ([LZW, PACKBITS] + [DEFLATE] * len(parts))[: len(parts)], predictor=2))
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def payload_digests(files: DataFrame) -> DataFrame:
    """Digests of what each file of ``text_files`` stores, read back page by page."""

    def run(x):
        out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages")}
        for doc_id, n, data in zip(x["doc_id"], x["n_bytes"], x["media"], strict=True):
            sha, size, tail, features = hashlib.sha256(), 0, b"", []
            for p in pages(data):
                raw = p.pixels.tobytes()
                sha.update(raw)
                size, tail = size + len(raw), (tail + raw[-32:])[-32:]
                features.append(feature(p.pixels))
            for name, v in zip(out, (doc_id, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), "|".join(features), len(features)), strict=True):
                out[name].append(v)
        return out

    return arrow_map(files, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")
