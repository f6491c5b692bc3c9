"""CRC-32C (Castagnoli) of many byte strings at once, and the masked form that record files use."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0x82F63B78
_STRIPE = 512
#: Added to a rotated checksum, so that data which hold checksums do not check themselves.
_MASK = 0xA282EAD8


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


def _word_tables() -> list[np.ndarray]:
    """Four tables that take four bytes in one step, the first byte's last."""
    tables = [_byte_table()]
    for _ in range(3):
        last = tables[-1]
        tables.append(tables[0][last & 255] ^ (last >> np.uint32(8)))
    return tables


def _advance(tables: list[np.ndarray], state: np.ndarray) -> np.ndarray:
    return tables[3][state & 255] ^ tables[2][state >> 8 & 255] ^ tables[1][state >> 16 & 255] ^ tables[0][state >> 24]


def _zeros_tables(tables: list[np.ndarray]) -> list[list[int]]:
    """Tables that move a checksum over one stripe of zero bytes, one for each of its four bytes."""
    out = []
    for shift in (0, 8, 16, 24):
        state = np.arange(256, dtype=np.uint32) << np.uint32(shift)
        for _ in range(_STRIPE // 4):
            state = _advance(tables, state)
        out.append(state.tolist())
    return out


_TABLES = _word_tables()
_ZEROS = _zeros_tables(_TABLES)


def crc32c(strings: list[bytes]) -> list[int]:
    """The checksum of each string.

    Strings are cut into stripes of equal length, zeros in front; zeros do not change a checksum that starts at 0.
    All stripes advance together, and each string's stripes are then put together. The usual start of all ones
    is the same as inverting the first four bytes.
    """
    counts = [max(1, -(-len(s) // _STRIPE)) for s in strings]
    data = np.zeros(sum(counts) * _STRIPE, np.uint8)
    end = 0
    for s, n in zip(strings, counts):
        end += n * _STRIPE
        start = end - len(s)
        data[start:end] = np.frombuffer(s, np.uint8)
        data[start:min(start + 4, end)] ^= 0xFF
    words = np.ascontiguousarray(data.view("<u4").reshape(-1, _STRIPE // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for word in words:
        state = _advance(_TABLES, state ^ word)
    stripes = state.tolist()
    out, at = [], 0
    z0, z1, z2, z3 = _ZEROS
    for s, n in zip(strings, counts):
        value = stripes[at]
        for k in range(at + 1, at + n):
            value = z0[value & 255] ^ z1[value >> 8 & 255] ^ z2[value >> 16 & 255] ^ z3[value >> 24] ^ stripes[k]
        at += n
        if len(s) < 4:
            value = _short(s)
            out.append(value)
        else:
            out.append(value ^ 0xFFFFFFFF)
    return out


def _short(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = int(_TABLES[0][(value ^ byte) & 255]) ^ value >> 8
    return value ^ 0xFFFFFFFF


def masked(checksum: int) -> int:
    return ((checksum >> 15 | checksum << 17) + _MASK) & 0xFFFFFFFF
