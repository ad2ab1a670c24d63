"""Huffman codes of a frequency table: tree, codes, encoding, decoding, and packing of bits."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable


def tree(freq: dict[Hashable, int]) -> list[tuple]:
    """Nodes (freq, left, right, symbol) with the root first; leaves have no children. Symbols without occurrences are left
    out. Of equal frequencies the node that was made earlier is taken first, symbols in the order of freq."""
    leaves = [(n, s) for s, n in freq.items() if n > 0]
    heap: list[tuple[int, int, tuple]] = [(n, k, (n, None, None, s)) for k, (n, s) in enumerate(leaves)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a[0] + b[0], a[2], b[2], None)))
        made += 1
    nodes: list[tuple] = []

    queue = [heap[0][2]] if heap else []
    place = 1
    for node in queue:  # grows while it is walked: level order
        n, left, right, symbol = node
        if left is None:
            nodes.append((n, None, None, symbol))
        else:
            nodes.append((n, place, place + 1, None))
            queue += [left, right]
            place += 2
    return nodes


def codes(nodes: list[tuple]) -> dict[Hashable, str]:
    """Symbol to its code of 0 (left) and 1 (right); the only symbol of a table has an empty code."""
    out: dict[Hashable, str] = {}
    stack = [(0, "")] if nodes else []
    while stack:
        k, code = stack.pop()
        _, left, right, symbol = nodes[k]
        if left is None:
            out[symbol] = code
        else:
            stack += [(right, code + "1"), (left, code + "0")]
    return out


def total_bits(freq: dict[Hashable, int]) -> int:
    """Bits of the coded message: the same however ties are broken."""
    return sum(freq[s] * len(c) for s, c in codes(tree(freq)).items())


def encode(symbols: Iterable[Hashable], table: dict[Hashable, str]) -> str:
    """The codes one after the other; a symbol that the table lacks is an error."""
    return "".join([table[s] for s in symbols])


def decode(bits: str, nodes: list[tuple], count: int) -> list[Hashable]:
    """The first `count` symbols."""
    out, k = [], 0
    if nodes and nodes[0][1] is None:
        return [nodes[0][3]] * count
    for b in bits:
        k = nodes[k][2] if b == "1" else nodes[k][1]
        if nodes[k][1] is None:
            out.append(nodes[k][3])
            k = 0
            if len(out) == count:
                break
    return out


def group_reader(trees: list[list[tuple]]):
    """read(bits, at): a symbol of each tree, one after the other, and the place behind them."""

    def read(bits: str, at: int) -> tuple[tuple, int]:
        out = []
        for nodes in trees:
            k = 0
            while nodes[k][1] is not None:
                k, at = nodes[k][2 if bits[at] == "1" else 1], at + 1
            out.append(nodes[k][3])
        return tuple(out), at

    return read


def serialized(nodes: list[tuple], symbols: list[Hashable]) -> list[int]:
    """24-bit numbers, one per inner node: in each half the distance to a child among inner nodes, or 0x800 and the symbol's
    place in `symbols`."""
    inner = [k for k, n in enumerate(nodes) if n[1] is not None]
    at = {k: i for i, k in enumerate(inner)}
    place = {s: i for i, s in enumerate(symbols)}

    def half(parent: int, child: int) -> int:
        return 0x800 | place[nodes[child][3]] if nodes[child][1] is None else at[child] - at[parent]

    return [half(k, nodes[k][1]) | half(k, nodes[k][2]) << 12 for k in inner]


def serialized_bytes(nodes: list[tuple], symbols: list[Hashable]) -> list[int]:
    """16-bit numbers, one per inner node: in each byte the distance to a child among inner nodes, or 0x80 and the symbol's
    place in `symbols`; what does not fit in seven bits is an error."""
    inner = [k for k, n in enumerate(nodes) if n[1] is not None]
    at, place = {k: i for i, k in enumerate(inner)}, {s: i for i, s in enumerate(symbols)}

    def half(parent: int, child: int) -> int:
        leaf = nodes[child][1] is None
        value = place[nodes[child][3]] if leaf else at[child] - at[parent]
        if not 0 <= value < 128:
            raise ValueError("a tree of bytes has at most 128 symbols and distances")
        return 0x80 | value if leaf else value

    return [half(k, nodes[k][1]) | half(k, nodes[k][2]) << 8 for k in inner]


def pack_msb(bits: str) -> bytes:
    """Eight bits to a byte, the first in the highest place; the last byte is filled with zeros."""
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def pack_lsb(bits: str, width: int = 8) -> bytes:
    """`width` bits to a word, the first in the lowest place, words little-endian."""
    bits += "0" * (-len(bits) % width)
    return b"".join(int(bits[i : i + width][::-1], 2).to_bytes(width // 8, "little") for i in range(0, len(bits), width))


def unpack_msb(data: bytes) -> str:
    return "".join(f"{b:08b}" for b in data)


def unpack_lsb(data: bytes) -> str:
    return "".join(f"{b:08b}"[::-1] for b in data)
