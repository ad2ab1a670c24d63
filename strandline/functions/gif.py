"""Animated GIF files: frames as boxes of what changed, packed with a growing dictionary."""

from __future__ import annotations

import numpy as np


def packed(pixels: bytes, bits: int) -> bytes:
    """LZW codes of pixels below 2 ** bits, in sub-blocks."""
    bits = max(2, bits)
    clear, end = 1 << bits, (1 << bits) + 1
    table = {(-1, k): k for k in range(1 << bits)}
    out, held, n, size, known = bytearray(), 0, 0, bits + 1, -1

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += size
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    for p in pixels:
        if (known, p) in table:
            known = table[known, p]
            continue
        put(known)
        new = len(table) + 2
        table[known, p] = new
        if new == 1 << size and size < 12:
            size += 1
        elif new >= 4095:
            put(clear)
            table = {(-1, k): k for k in range(1 << bits)}
            size = bits + 1
        known = p
    if known >= 0:
        put(known)
    put(end)
    if n:
        out.append(held & 255)
    blocks = b"".join(bytes([len(out[i : i + 255])]) + out[i : i + 255] for i in range(0, len(out), 255))
    return bytes([bits]) + blocks + b"\0"


def changed_box(before: np.ndarray | None, now: np.ndarray) -> tuple[int, int, int, int]:
    """(x, y, width, height) around what differs; one pixel if nothing does."""
    if before is None:
        return 0, 0, now.shape[1], now.shape[0]
    y, x = np.nonzero(before != now)
    if not len(x):
        return 0, 0, 1, 1
    return int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)


def animation(frames: list[np.ndarray], palette: list[tuple[int, int, int]], delay: int = 3) -> bytes:
    """A file of frames of palette places, looped; delay is in hundredths of a second."""
    bits = max(1, (len(palette) - 1).bit_length())
    h, w = frames[0].shape
    out = bytearray(b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0xF0 | bits - 1, 0, 0]))
    for c in [*palette, *[(0, 0, 0)] * ((1 << bits) - len(palette))]:
        out += bytes(c)
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    before = None
    for f in frames:
        x, y, bw, bh = changed_box(before, f)
        out += b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\0\0" + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, bw, bh)) + b"\0"
        out += packed(f[y : y + bh, x : x + bw].astype(np.uint8).tobytes(), bits)
        before = f
    return bytes(out + b"\x3b")


def boxes(data: bytes) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the frames of a file."""
    if data[:6] not in (b"GIF89a", b"GIF87a"):
        raise ValueError("not a GIF file")
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 128 else 0)
    out = []
    while data[at] != 0x3B:
        if data[at] == 0x21:  # an extension: its label, then blocks
            at += 2
        else:
            out.append(tuple(int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7)))
            at += 10 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 128 else 0) + 1
        while data[at]:
            at += data[at] + 1
        at += 1
    return out
