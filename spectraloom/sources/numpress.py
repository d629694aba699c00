"""MS-Numpress: number arrays as fixed-point integers in half bytes (linear, positive integers) or as short logarithms.

Fixed values of the format: the scale is a big-endian double at the front; integers are a head half byte and then half bytes from the
lowest on. A head up to 8 is the number of leading zero half bytes left out; beyond that, head - 8 is the number of leading ones.
"""

from __future__ import annotations

import numpy as np


def _halves(data: bytes) -> list[int]:
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(2 * len(raw), np.uint8)
    out[0::2], out[1::2] = raw >> 4, raw & 15
    return out.tolist()


def _ints(data: bytes) -> list[int]:
    """All integers of 32 bits; a last lone half byte of 0 is padding."""
    h, at, out = _halves(data), 0, []
    n = len(h)
    while at < n:
        head = h[at]
        if at == n - 1 and head == 0:
            break
        left = 8 - (head if head <= 8 else head - 8)
        if at + 1 + left > n:
            raise ValueError("a number is cut off")
        x = 0
        for k in range(left):
            x |= h[at + 1 + k] << (4 * k)
        if head > 8:
            x |= (0xFFFFFFFF << (4 * left)) & 0xFFFFFFFF
        out.append(x - (1 << 32) if x >> 31 else x)
        at += 1 + left
    return out


def _packed(values: list[int]) -> bytes:
    h: list[int] = []
    for v in values:
        if not -(1 << 31) <= v < 1 << 31:
            raise ValueError("a number needs over 32 bits: use a smaller scale")
        x = v & 0xFFFFFFFF
        digits = [x >> (4 * k) & 15 for k in range(8)]
        top, most = digits[7], 8
        fill = 0 if top == 0 else 15 if top == 15 else None
        lead = 0
        if fill is not None:
            most = 8 if fill == 0 else 7
            while lead < most and digits[7 - lead] == fill:
                lead += 1
        h.append(lead + (8 if fill == 15 else 0))
        h += digits[: 8 - lead]
    if len(h) % 2:
        h.append(0)
    a = np.array(h, np.uint8)
    return (a[0::2] << 4 | a[1::2]).tobytes()


def _scale(data: bytes) -> float:
    if len(data) < 8:
        raise ValueError("no scale")
    return float(np.frombuffer(data[:8], ">f8")[0])


def decode_linear(data: bytes) -> np.ndarray:
    """Each integer is the difference from the line through the two before it."""
    if not data:
        return np.zeros(0)
    scale = _scale(data)
    first = np.frombuffer(data[8 : 8 + (len(data) - 8) // 4 * 4][:8], "<i4").tolist()
    out = first[:2]
    if len(data) > 16:
        for d in _ints(data[16:]):
            out.append(2 * out[-1] - out[-2] + d)
    return np.array(out, float) / scale


def encode_linear(values: np.ndarray, scale: float = 1e5) -> bytes:
    v = np.floor(np.asarray(values, float) * scale + 0.5).astype(np.int64).tolist()
    head = np.array([scale], ">f8").tobytes() + np.array(v[:2], "<i4").tobytes()
    return head + _packed([v[i] - 2 * v[i - 1] + v[i - 2] for i in range(2, len(v))])


def decode_pic(data: bytes) -> np.ndarray:
    return np.array(_ints(data), float)


def encode_pic(values: np.ndarray) -> bytes:
    return _packed(np.floor(np.asarray(values, float) + 0.5).astype(np.int64).tolist())


def decode_slof(data: bytes) -> np.ndarray:
    return np.expm1(np.frombuffer(data[8:], "<u2") / _scale(data)) if data else np.zeros(0)


def encode_slof(values: np.ndarray, scale: float | None = None) -> bytes:
    v = np.log1p(np.asarray(values, float))
    if scale is None:
        scale = np.floor(65535.0 / max(v.max(initial=0.0), 1e-9))
    return np.array([scale], ">f8").tobytes() + np.floor(v * scale + 0.5).astype("<u2").tobytes()


#: Terms of the compressions: decoder, and whether zlib comes on top.
DECODERS = {
    "MS:1002312": (decode_linear, False), "MS:1002313": (decode_pic, False), "MS:1002314": (decode_slof, False),
    "MS:1002746": (decode_linear, True), "MS:1002747": (decode_pic, True), "MS:1002748": (decode_slof, True),
}
