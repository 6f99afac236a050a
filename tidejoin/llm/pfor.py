"""Patched frame-of-reference pages for unsigned 32-bit ids.

A page holds ids in blocks of 256. Each block subtracts its minimum, packs the low bits of the differences at the
width that covers 90 % of them, and lists the rest as exceptions (position, high bits). Layout, little-endian:

    magic "PFR1", n_ids u32, n_blocks u32
    block starts: u32[n_blocks + 1], byte offsets into the body
    body, per block: base u32, width u8, 0 u8, n_exceptions u16, packed u32[8 * width],
                     exception positions u8[n_exceptions], exception high bits u32[n_exceptions]

Packed words are interleaved: lane j of 8 holds the values j, j + 8, ... of the block in `width` words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFR1"
BLOCK, LANES = 256, 8
PER_LANE = BLOCK // LANES
PERCENTILE = 0.9


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value; exact, as a double holds every 32-bit integer."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """v: [rows, PER_LANE, LANES] of uint32 below 2**width; returns [rows, width, LANES]."""
    out = np.zeros((v.shape[0], width, LANES), np.uint32)
    for k in range(PER_LANE if width else 0):
        word, shift = divmod(k * width, 32)
        out[:, word] |= v[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, k] >> np.uint32(32 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((words.shape[0], PER_LANE, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(PER_LANE if width else 0):
        word, shift = divmod(k * width, 32)
        x = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, k] = x & mask
    return out


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint32)
    n, n_blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return MAGIC + struct.pack("<III", 0, 0, 0)
    full = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    grid = full.reshape(n_blocks, BLOCK)
    base = grid.min(axis=1)
    delta = grid - base[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bit_length(np.partition(delta, at, axis=1)[:, at])
    bodies: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        d = delta[rows]
        low = d & np.uint32((1 << int(w)) - 1)
        high = d >> np.uint32(w) if w < 32 else np.zeros_like(d)
        packed = _pack(low.reshape(len(rows), PER_LANE, LANES), int(w)).tobytes()
        row, pos = np.nonzero(high)
        places, values = pos.astype(np.uint8).tobytes(), high[row, pos].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(row, minlength=len(rows))).tolist()
        size, e = 4 * LANES * int(w), 0
        for i, (r, m, f) in enumerate(zip(rows.tolist(), base[rows].tolist(), ends, strict=True)):
            bodies[r] = b"".join((struct.pack("<IBBH", m, w, 0, f - e), packed[i * size : (i + 1) * size], places[e:f], values[4 * e : 4 * f]))
            e = f
    starts = np.zeros(n_blocks + 1, np.uint32)
    np.cumsum([len(b) for b in bodies], out=starts[1:])
    return MAGIC + struct.pack("<II", n, n_blocks) + starts.astype("<u4").tobytes() + b"".join(bodies)


def decode(page: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last - 1 (default: all); the block starts let a reader skip the others."""
    if page[:4] != MAGIC:
        raise ValueError("not a page")
    n, n_blocks = struct.unpack_from("<II", page, 4)
    starts = np.frombuffer(page, "<u4", n_blocks + 1, 12)
    body = 12 + 4 * (n_blocks + 1)
    last = n_blocks if last is None else min(last, n_blocks)
    count = max(0, last - first)
    if not count:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(page, np.uint8)
    at = body + starts[first:last].astype(np.int64)
    head = raw[at[:, None] + np.arange(8)]
    base = head[:, :4].copy().view("<u4")[:, 0]
    width, n_exc = head[:, 4].astype(np.int64), head[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.empty((count, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = 4 * LANES * int(w)
        packed = b"".join([page[p : p + size] for p in (at[rows] + 8).tolist()])
        words = np.frombuffer(packed, "<u4").reshape(len(rows), int(w), LANES)
        out[rows] = _unpack(words, int(w)).reshape(len(rows), BLOCK)
    outlying = np.flatnonzero(n_exc)
    if len(outlying):
        k = n_exc[outlying]
        spans = list(zip((at[outlying] + 8 + 4 * LANES * width[outlying]).tolist(), k.tolist(), strict=True))
        pos = np.frombuffer(b"".join([page[p : p + m] for p, m in spans]), np.uint8)
        high = np.frombuffer(b"".join([page[p + m : p + 5 * m] for p, m in spans]), "<u4")
        out[np.repeat(outlying, k), pos] |= high << np.repeat(width[outlying], k).astype(np.uint32)
    out += base[:, None]
    flat = out.reshape(-1)
    return flat[: min(n, last * BLOCK) - first * BLOCK]
