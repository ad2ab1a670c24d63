"""Adaptive binary range coder: each bit is coded with the chance, in 256ths, that it is 0."""

from __future__ import annotations


class Encoder:
    """Bits to bytes. The interval [low, low + range) is cut at 1 + ((range - 1) * p >> 8) for p in 0 .. 255.

    low is kept as one integer of any length and shifted out at the end of each byte, so a carry is plain addition.
    """

    def __init__(self):
        self.low, self.range, self.shifted, self.total = 0, 255, 0, 0
        self.out = bytearray()
        self.bit(0, 128)

    def bit(self, bit: int, p: int) -> None:
        split = 1 + ((self.range - 1) * p >> 8)
        if bit:
            self.low += split
            self.range -= split
        else:
            self.range = split
        shift = 8 - self.range.bit_length()
        if shift > 0:
            self.range <<= shift
            self.low <<= shift
            self.shifted += shift
            self.total += shift
            self._spill()

    def _spill(self) -> None:
        """Moves settled bytes out: a carry can only reach the low 32 bits and a run of 0xff before them."""
        while self.shifted > 64:
            keep = self.shifted - 8
            top, self.low = self.low >> (keep + 8), self.low & ((1 << (keep + 8)) - 1)
            self.shifted = keep
            self._put(top)

    def _put(self, byte: int) -> None:
        if byte > 0xFF:
            k = len(self.out) - 1
            while self.out[k] == 0xFF:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        self.out.append(byte & 0xFF)

    def finish(self) -> bytes:
        """Flushes with 32 zero bits of even chance; the three bytes that the decoder can do without are left out. A last
        byte that looks like a frame marker (110xxxxx) is followed by a zero."""
        for _ in range(32):
            self.bit(0, 128)
        total = self.shifted + 8
        low = self.low
        whole = -(-total // 8) * 8
        low <<= whole - total
        rest = low.to_bytes(whole // 8 + 1, "big")
        if rest[0]:
            k = len(self.out) - 1
            while self.out[k] == 0xFF:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        done = (bytes(self.out) + rest[1:])[: self.total // 8 - 2]
        return done + b"\0" if done[-1] & 0xE0 == 0xC0 else done


class Decoder:
    """Bytes to bits, given the same chances; what is behind the end reads as zeros."""

    def __init__(self, data: bytes):
        self.data, self.place = data, 0
        self.value, self.range, self.have = 0, 255, 0
        self._fill()
        self.bit(128)

    def _fill(self) -> None:
        while self.have < 8:
            self.value = self.value << 8 | (self.data[self.place] if self.place < len(self.data) else 0)
            self.place += 1
            self.have += 8

    def bit(self, p: int) -> int:
        split = 1 + ((self.range - 1) * p >> 8)
        edge = split << (self.have - 8)
        if self.value >= edge:
            self.value -= edge
            self.range -= split
            got = 1
        else:
            self.range = split
            got = 0
        shift = 8 - self.range.bit_length()
        if shift > 0:
            self.range <<= shift
            self.have -= shift
            self._fill()
        return got


def encode_tree(coder: Encoder, symbol: int, bits: int, tree: dict[int, int]) -> None:
    """A symbol bit by bit from the top; tree gives the chance of 0 after each prefix (with a leading 1), 128 if unknown."""
    prefix = 1
    for k in range(bits - 1, -1, -1):
        b = symbol >> k & 1
        coder.bit(b, tree.get(prefix, 128))
        prefix = prefix << 1 | b


def decode_tree(coder: Decoder, bits: int, tree: dict[int, int]) -> int:
    prefix = 1
    for _ in range(bits):
        prefix = prefix << 1 | coder.bit(tree.get(prefix, 128))
    return prefix - (1 << bits)


def tree_of(counts: dict[int, int], bits: int) -> dict[int, int]:
    """Chances of 0 after each prefix, in 256ths, from symbol counts."""
    zero: dict[int, int] = {}
    total: dict[int, int] = {}
    for symbol, n in counts.items():
        prefix = 1
        for k in range(bits - 1, -1, -1):
            b = symbol >> k & 1
            total[prefix] = total.get(prefix, 0) + n
            zero[prefix] = zero.get(prefix, 0) + n * (1 - b)
            prefix = prefix << 1 | b
    return {p: max(0, min(255, int(zero[p] / t * 257))) for p, t in total.items() if t}
