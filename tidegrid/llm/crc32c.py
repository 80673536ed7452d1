"""CRC-32C (Castagnoli) of many byte strings at once, in numpy.

A CRC is linear over GF(2). The contribution of a 16-bit word to the register at
the end of its run of sixteen words comes from one table per place; runs are then
folded pairwise, shifting the left one past the right one by table, and blocks of
a message one after another. Every step works on all messages at once.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78  # reflected
RUN, LEVELS = 16, 3
BLOCK = 2 * RUN << LEVELS  # bytes


def _tables():
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = (byte >> 1) ^ np.where(byte & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    word = np.arange(1 << 16, dtype=np.uint32)
    first = byte[word & 255]
    word_crc = (first >> 8) ^ byte[(first ^ (word >> 8)) & 255]

    def step(c):  # one zero byte
        return (c >> 8) ^ byte[c & 255]

    places = [word_crc]  # of the last word of a run, the one before it, ...
    for _ in range(RUN - 1):
        places.append(step(step(places[-1])))
    low, high = word, word << 16
    for _ in range(2 * RUN):
        low, high = step(low), step(high)
    shifts = [(low, high)]  # past one run, two, four, ...
    for _ in range(LEVELS):
        shifts.append(tuple(_shift(t, shifts[-1]) for t in shifts[-1]))
    return places[::-1], shifts


def _shift(state: np.ndarray, table) -> np.ndarray:
    return table[0][state & 0xFFFF] ^ table[1][state >> 16]


_PLACES, _SHIFTS = _tables()


def crc32c(messages: list[bytes]) -> np.ndarray:
    """The CRC-32C of each message (uint32). Messages have at least four bytes."""
    if not messages:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(m) for m in messages], np.int64)
    if sizes.min() < 4:
        raise ValueError("messages of under four bytes are not framed")
    blocks = -(-sizes // BLOCK)
    pads = blocks * BLOCK - sizes
    parts = []
    for m, pad in zip(messages, pads.tolist(), strict=True):  # zeros in front leave a zero register as it is
        parts += (bytes(pad), (int.from_bytes(m[:4], "little") ^ 0xFFFFFFFF).to_bytes(4, "little"), m[4:])
    words = np.frombuffer(b"".join(parts), "<u2").reshape(-1, RUN)
    state = _PLACES[0][words[:, 0]]
    for k in range(1, RUN):
        state ^= _PLACES[k][words[:, k]]
    state = state.reshape(-1, BLOCK // (2 * RUN))
    for level in range(LEVELS):
        state = _shift(state[:, 0::2], _SHIFTS[level]) ^ state[:, 1::2]
    state = state[:, 0]
    start = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    order = np.argsort(-blocks, kind="stable")
    start, left = start[order], blocks[order]
    register = np.zeros(len(messages), np.uint32)
    for k in range(int(left[0])):
        n = int(np.searchsorted(-left, -k, side="left"))  # records that have a block k
        register[:n] = _shift(register[:n], _SHIFTS[LEVELS]) ^ state[start[:n] + k]
    out = np.empty_like(register)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as record files store it: rotated and offset by a constant."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
