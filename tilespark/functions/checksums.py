"""CRC-32C (Castagnoli), which Zarr ends shards' indexes and chunks with."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL, _LANES = 0x82F63B78, 256


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(_POLYNOMIAL), x >> 1)
    return x.astype(np.uint32)


_BYTE = _table()
_LIST = _BYTE.tolist()


def crc32c(data: bytes) -> int:
    """Long inputs are cut into lanes that advance side by side; a register moves over a
    lane's length by a linear map, whose columns advance with them."""
    register, rest = 0xFFFFFFFF, data
    steps = len(data) // _LANES
    if steps >= 16:
        body = np.zeros((_LANES + 32, steps), np.uint8)
        body[:_LANES] = np.frombuffer(data, np.uint8, _LANES * steps).reshape(_LANES, steps)
        state = np.zeros(_LANES + 32, np.uint32)
        state[_LANES:] = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for column in np.ascontiguousarray(body.T):
            state = _BYTE[(state ^ column) & 0xFF] ^ state >> 8
        columns = state[_LANES:].tolist()
        for lane in state[:_LANES].tolist():
            moved = 0
            for k in range(32):
                if register >> k & 1:
                    moved ^= columns[k]
            register = moved ^ lane
        rest = data[_LANES * steps :]
    for byte in rest:
        register = _LIST[(register ^ byte) & 0xFF] ^ register >> 8
    return register ^ 0xFFFFFFFF
