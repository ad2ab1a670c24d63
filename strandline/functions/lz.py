"""LZ parsing and coding of short sequences: back-references over symbols, and over the bits of a coded message."""

from __future__ import annotations

from collections.abc import Sequence

from .rangecoder import Decoder, Encoder

WINDOW, LONGEST, SHORTEST = 1 << 10, 255, 3


def parse(seq: Sequence[int], window: int = WINDOW, longest: int = LONGEST, shortest: int = SHORTEST) -> list[tuple]:
    """Greedy parse into (symbol,) and (distance, length): at each place the longest match that starts inside the window
    and ends before the place, the earliest of equals. Candidates share their first `shortest` symbols."""
    starts: dict[tuple, list[int]] = {}
    out: list[tuple] = []
    i, known = 0, 0
    while i < len(seq):
        while known + shortest <= i:
            starts.setdefault(tuple(seq[known : known + shortest]), []).append(known)
            known += 1
        best, where = 0, 0
        for s in starts.get(tuple(seq[i : i + shortest]), []) if i + shortest <= len(seq) else []:
            if s < i - window:
                continue
            n = shortest
            most = min(longest, i - s, len(seq) - i)
            while n < most and seq[s + n] == seq[i + n]:
                n += 1
            if n > best:
                best, where = n, s
        if best >= shortest:
            out.append((i - where, best))
            i += best
        else:
            out.append((seq[i],))
            i += 1
    return out


def expand(tokens: list[tuple]) -> list[int]:
    """The sequence again."""
    out: list[int] = []
    for t in tokens:
        if len(t) == 1:
            out.append(t[0])
        else:
            start = len(out) - t[0]
            out += out[start : start + t[1]]
    return out


def _field(coder: Encoder, value: int, bits: int, slope: int) -> None:
    for k in range(bits):
        coder.bit(value >> k & 1, min(255, 127 + k * slope))


def _read(coder: Decoder, bits: int, slope: int) -> int:
    return sum(coder.bit(min(255, 127 + k * slope)) << k for k in range(bits))


def encode(seq: Sequence[int], symbol_bits: int = 8) -> tuple[bytes, int]:
    """(bytes, chance of a literal in 256ths): a flag, then a symbol, or a length of 8 bits and a distance of 11, low bits
    first and with chances of 0 that rise with the place. The chance comes from the parse itself."""
    return encode_tokens(parse(seq), symbol_bits)


def encode_tokens(tokens: list[tuple], symbol_bits: int = 8) -> tuple[bytes, int]:
    """The same for a sequence that is parsed already."""
    literals = sum(len(t) == 1 for t in tokens)
    p = max(0, min(255, 256 * literals // (len(tokens) + 1)))
    coder = Encoder()
    for t in tokens:
        coder.bit(len(t) - 1, p)
        if len(t) == 1:
            _field(coder, t[0], symbol_bits, 0)
        else:
            _field(coder, t[1], 8, 12)
            _field(coder, t[0], 11, 4)
    return coder.finish(), p


def decode(data: bytes, p: int, count: int, symbol_bits: int = 8) -> list[int]:
    coder, out = Decoder(data), []
    while len(out) < count:
        if coder.bit(p):
            n = _read(coder, 8, 12)
            start = len(out) - _read(coder, 11, 4)
            out += out[start : start + n]
        else:
            out.append(_read(coder, symbol_bits, 0))
    return out


# ---- over coded bits ----


def ue(v: int) -> str:
    """Unsigned exponential Golomb code."""
    code = f"{v + 1:b}"
    return "0" * (len(code) - 1) + code


def reverse_encode(groups: list[str], deepest: int = 18) -> str:
    """Bits of a message of `groups` (the code of each note): 0 and the group, or 1, the number of groups and the distance
    in bits back to where the first of them was written.

    A reference may lead to places that hold references themselves, up to `deepest` of them inside one another. Of the
    longest matches the one that is nearest pays least: a distance costs a ninth of its bits.
    """
    out, depth_at, places = "", [], []  # places[k]: bit where group k can be read from; depth_at[k]: references on the way
    k = 0
    while k < len(groups):
        best, where, score = 0, 0, 0.0
        for s in range(k):
            n = 0
            while s + n < k and k + n < len(groups) and groups[s + n] == groups[k + n] and depth_at[s + n] < deepest and _whole(places, s, n):
                n += 1
            worth = n - (len(out) - places[s][0]).bit_length() // 9
            if n >= 2 and worth > score:
                best, where, score = n, s, worth
        if best and len(ref := "1" + ue(best) + ue(len(out) - places[where][0])) < sum(len(g) + 1 for g in groups[k : k + best]):
            start = len(out)
            out += ref
            for i in range(best):
                places.append((start, i))
                depth_at.append(1 + max(depth_at[where : where + best]))
            k += best
        else:
            places.append((len(out), 0))
            depth_at.append(0)
            out += "0" + groups[k]
            k += 1
    return out


def _whole(places: list[tuple[int, int]], s: int, n: int) -> bool:
    """Whether group s starts a token, so that a reader can begin there."""
    return n > 0 or places[s][1] == 0


#: Groups that are left where no reference is open.
NO_END = 1 << 60


def pull(bits: str, place: tuple[int, int, list[tuple[int, int]]], read_group) -> tuple[object, tuple[int, int, list[tuple[int, int]]]]:
    """The next group, and the place after it: (bit, groups that are left of the innermost reference, the places to go on at
    and groups still to read of the open references around it). A message starts at (0, NO_END, [])."""
    at, left, stack = place
    stack = list(stack)
    while left == 0:
        at, left = stack.pop()
    while bits[at] == "1":
        start = at
        n, at = _ue(bits, at + 1)
        back, at = _ue(bits, at)
        n = min(n, left)
        stack.append((at, left - n))
        at, left = start - back, n
    group, at = read_group(bits, at + 1)
    return group, (at, left - 1, stack)


def reverse_decode(bits: str, count: int, read_group) -> list:
    """`count` groups; read_group(bits, at) gives (group, next place). References are followed with a stack."""
    out, place = [], (0, NO_END, [])
    for _ in range(count):
        group, place = pull(bits, place, read_group)
        out.append(group)
    return out


def _ue(bits: str, at: int) -> tuple[int, int]:
    zeros = bits.index("1", at) - at
    end = at + 2 * zeros + 1
    return int(bits[at + zeros : end], 2) - 1, end
