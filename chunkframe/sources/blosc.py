"""Blosc frames: a buffer cut into blocks, each shuffled by bytes or bits and compressed on its own.

A frame has a header of 16 bytes, the offset of every block, and the blocks; a block is one stream, or one for each byte of
an element. LZ4, snappy, zlib and zstd streams go through their libraries; the format's own codec (blosclz) is
decoded here. Frames are written with zstd, lz4 or zlib. A frame that is cut short, or says what cannot be, is a ``ValueError``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

# The codes of the header's last three flag bits, the other flag bits, and when a block is split into streams.
CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, WHOLE_BLOCKS = 1, 2, 4, 16
HEADER, MOST_STREAMS, LEAST_STREAM = 16, 16, 128
NEAR, SHUFFLES = 8191, {"noshuffle": 0, "shuffle": 1, "bitshuffle": 2}
#: The size of the blocks that are written.
BLOCK = 256 << 10


def shuffled(data: bytes, size: int) -> bytes:
    """The first bytes of all elements, then the second ones, and so on; what is no whole element stays at the end."""
    n = len(data) // size * size
    return np.frombuffer(data, np.uint8, n).reshape(-1, size).T.tobytes() + data[n:]


def unshuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data, np.uint8, n).reshape(size, -1).T.tobytes() + data[n:]


def bits_shuffled(data: bytes, size: int) -> bytes:
    """The first bits of all elements, and so on; blocks whose number of elements is no multiple of 8 stay as they are."""
    n = len(data) // size
    if n % 8:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(n, size), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def bits_unshuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size
    if n % 8:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def blosclz(data: bytes, size: int) -> bytes:
    """A stream of literals and of copies from what was already read, near (13 bits) or far (16 bits more)."""
    out, at, first = bytearray(), 0, True
    while at < len(data):
        control, at = data[at], at + 1
        if first:
            control, first = control & 31, False
        if control < 32:
            if at + control + 1 > len(data):
                raise ValueError("a stream ends within its literals")
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length, back = (control >> 5) - 1, (control & 31) << 8
        try:
            if length == 6:
                while True:
                    more, at = data[at], at + 1
                    length += more
                    if more != 255:
                        break
            low, at = data[at], at + 1
            if low == 255 and back == 31 << 8:
                back, at = (data[at] << 8) + data[at + 1] + NEAR, at + 2
            else:
                back += low
        except IndexError:
            raise ValueError("a stream ends within a copy") from None
        back, length = back + 1, length + 3
        if back > len(out) or len(out) + length > size:
            raise ValueError("a copy from before the stream, or beyond its end")
        piece = bytes(out[-back:]) if back >= length else bytes(out[-back:]) * -(-length // back)
        out += piece[:length]
    return bytes(out)


def _stream(data: bytes, codec: str, size: int) -> bytes:
    try:
        if codec == "blosclz":
            out = blosclz(data, size)
        elif codec == "zlib":
            out = zlib.decompressobj().decompress(data, size + 1)
        else:
            out = pa.decompress(data, decompressed_size=size, codec={"lz4": "lz4_raw"}.get(codec, codec), asbytes=True)
    except (zlib.error, OSError, pa.ArrowException) as e:
        raise ValueError(f"a {codec} stream: {e}") from None
    if len(out) != size:
        raise ValueError(f"a {codec} stream of {len(out)} bytes, {size} expected")
    return out


def decode(frame: bytes) -> bytes:
    if len(frame) < HEADER:
        raise ValueError("a frame without its header")
    flags, size = frame[2], max(frame[3], 1)
    total, block, stored = (int(v) for v in np.frombuffer(frame, "<u4", 3, 4))
    if frame[0] not in (1, 2) or stored != len(frame) or (total and not block):
        raise ValueError("a frame whose header does not fit it")
    if flags & STORED:
        if len(frame) != HEADER + total:
            raise ValueError("a frame whose header does not fit it")
        return frame[HEADER:]
    if not total:
        return b""
    codec = CODECS.get(flags >> 5)
    blocks = -(-total // block)
    if codec is None or HEADER + 4 * blocks > len(frame):
        raise ValueError("a frame of an unknown codec, or without its blocks")
    out = []
    for i, at in enumerate(np.frombuffer(frame, "<u4", blocks, HEADER).tolist()):
        length = min(block, total - i * block)
        split = not flags & WHOLE_BLOCKS and size <= MOST_STREAMS and block // size >= LEAST_STREAM and length == block
        streams = size if split else 1
        parts, each = [], length // streams
        for _ in range(streams):
            if at + 4 > len(frame):
                raise ValueError("a block beyond the frame")
            packed = int.from_bytes(frame[at : at + 4], "little")
            at += 4
            if packed > len(frame) - at:
                raise ValueError("a stream beyond the frame")
            parts.append(frame[at : at + packed] if packed == each else _stream(frame[at : at + packed], codec, each))
            at += packed
        data = b"".join(parts)
        if flags & BIT_SHUFFLE:
            data = bits_unshuffled(data, size)
        elif flags & BYTE_SHUFFLE and size > 1:
            data = unshuffled(data, size)
        out.append(data)
    return b"".join(out)


def encode(data: bytes, size: int, codec: str = "zstd", level: int = 5, shuffle: int = 1, block: int = 0) -> bytes:
    """``shuffle``: 0 none, 1 bytes, 2 bits, -1 bits for single bytes and bytes for others; ``block`` 0: ``BLOCK``."""
    if codec not in ("zstd", "lz4", "zlib"):
        raise ValueError(f"frames are not written with {codec}")
    shuffle = (2 if size == 1 else 1) if shuffle == -1 else shuffle
    step = min(max((block or BLOCK) // (8 * size) * 8 * size, 8 * size), max(len(data), 1))
    split = codec == "lz4" and size <= MOST_STREAMS and step // size >= LEAST_STREAM and step % size == 0
    flags = {v: k for k, v in CODECS.items()}[codec] << 5 | (BYTE_SHUFFLE if shuffle == 1 and size > 1 else BIT_SHUFFLE if shuffle == 2 else 0) | (0 if split else WHOLE_BLOCKS)
    squeeze = (lambda d: zlib.compress(d, level)) if codec == "zlib" else pa.Codec("lz4_raw" if codec == "lz4" else codec, **({"compression_level": level} if codec == "zstd" else {})).compress
    body, starts, first = [], [], HEADER + 4 * -(-len(data) // step)
    for i in range(0, len(data), step):
        piece = data[i : i + step]
        piece = bits_shuffled(piece, size) if flags & BIT_SHUFFLE else shuffled(piece, size) if flags & BYTE_SHUFFLE else piece
        each = len(piece) // size if split and len(piece) == step else len(piece)
        starts.append(first)
        for j in range(0, len(piece), each):
            raw = piece[j : j + each]
            packed = bytes(squeeze(raw))
            packed = packed if len(packed) < len(raw) else raw
            body.append(len(packed).to_bytes(4, "little") + packed)
            first += len(body[-1])
    head = lambda f, n: bytes([2, 1, f, size]) + np.array([len(data), step if data else 0, n], "<u4").tobytes()
    if first >= HEADER + len(data):
        return head(flags | STORED, HEADER + len(data)) + data
    return head(flags, first) + np.array(starts, "<u4").tobytes() + b"".join(body)
