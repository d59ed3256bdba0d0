"""The Castagnoli checksum over numpy columns: a buffer is cut into lanes whose checksums are made side by side and combined.

Without its initial value and last inversion the checksum is linear, and leading zeros don't change it. So lanes start at 0,
and two neighbours combine as shift(first) ^ second, where shift carries a checksum past as many zero bytes as the
second has; shifts are tables of 4 x 256 numbers, squared for twice the bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Fixed value: the polynomial, lowest power in the highest bit.
POLYNOMIAL = 0x82F63B78
#: Bytes of a lane at least.
LANE = 1024


@cache
def _bytes_table() -> np.ndarray:
    """The checksum of each single byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = t >> np.uint32(1) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return t


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0][crc & 255] ^ shift[1][crc >> 8 & 255] ^ shift[2][crc >> 16 & 255] ^ shift[3][crc >> 24]


@cache
def _shift(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of a checksum, by each of its four bytes."""
    if power == 0:
        one = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
        return one >> np.uint32(8) ^ _bytes_table()[one & 255]
    half = _shift(power - 1)
    return np.stack([_apply(half, half[i]) for i in range(4)])


def crc32c(data: bytes) -> int:
    size = len(data)
    lanes = 1 << max((size // LANE).bit_length() - 1, 0)
    width = max(-(-size // lanes), 1)
    power = (width - 1).bit_length()  # lanes as long as a power of two, so that shifts are squares of each other
    width = 1 << power
    lanes = 1 << max(-(-size // width) - 1, 0).bit_length()
    rows = np.zeros(lanes * width, np.uint8)
    rows[lanes * width - size :] = np.frombuffer(data, np.uint8)
    columns, table = np.ascontiguousarray(rows.reshape(lanes, width).T), _bytes_table()
    crc = np.zeros(lanes, np.uint32)
    for column in columns:
        crc = crc >> np.uint32(8) ^ table[(crc ^ column) & 255]
    while len(crc) > 1:
        crc, power = _apply(_shift(power), crc[0::2]) ^ crc[1::2], power + 1
    start, left, power = np.array([0xFFFFFFFF], np.uint32), size, 0
    while left:
        if left & 1:
            start = _apply(_shift(power), start)
        left, power = left >> 1, power + 1
    return int(crc[0] ^ start[0]) ^ 0xFFFFFFFF
