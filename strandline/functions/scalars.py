"""Column expressions on symbols, tiles, levels and notes; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(n: Column) -> Column:
    """Bits that hold the numbers 0 .. n - 1; 0 for n <= 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def reversed_bits(v: Column, width: int) -> Column:
    """v with its low `width` bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(v), width, "0")), 2, 10).cast("long")


def golomb(v: Column) -> Column:
    """Unsigned exponential Golomb code of v >= 0, as a string of 0 and 1."""
    code = F.bin(v + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def golomb_bits(v: Column) -> Column:
    """Length of golomb(v)."""
    return 2 * F.length(F.bin(v + 1)) - 1


def signed_golomb(v: Column) -> Column:
    """Exponential Golomb code of a signed v: twice its magnitude, plus one if it is negative."""
    return golomb(F.abs(v) * 2 + F.when(v < 0, 1).otherwise(0))


def probability_byte(p: Column) -> Column:
    """A probability in 256ths, 0 to 255; an undefined one (null) is 0."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(p * 257))), F.lit(0)).cast("long")


def halftone(v: Column, x: Column, y: Column, low: float, high: float) -> Column:
    """1 above a threshold that alternates like a checkerboard, else 0."""
    return F.when((x + y) % 2 == 1, (v > high).cast("int")).otherwise((v > low).cast("int"))


def gray_level(v: Column) -> Column:
    """0, 1 or 2 for v in [0, 1]."""
    return F.greatest(F.lit(0), F.least(F.floor(v * 2.999), F.lit(2))).cast("int")


def mask(tile: Column, threshold: float) -> Column:
    """A tile's lanes as text of 0 and 1, lane 0 first."""
    return F.array_join(F.transform(tile, lambda v: F.when(v > threshold, "1").otherwise("0")), "")


def mask_bits(tile: Column, threshold: float) -> Column:
    """A tile of up to 64 lanes as a bigint, lane 0 in the lowest bit."""
    return F.aggregate(
        F.transform(tile, lambda v, i: F.when(v > threshold, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bigints."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def city_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def flipped_x(tile: Column, side: int) -> Column:
    """Each row of a square tile reversed."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.reverse(F.slice(tile, r * side + 1, side))))


def flipped_y(tile: Column, side: int) -> Column:
    """The rows of a square tile in reverse order."""
    return F.flatten(F.transform(F.sequence(F.lit(side - 1), F.lit(0)), lambda r: F.slice(tile, r * side + 1, side)))


def pitch_hz(note: Column) -> Column:
    """Frequency of a note number, with 440 Hz for 69."""
    return F.pow(F.lit(2.0), (note - 69) / 12.0) * 440.0


def packed_note(note: Column, length: Column, run: Column) -> Column:
    """note, length and run in one number: 8, 5 and 3 bits."""
    return F.shiftleft(note, 8).bitwiseOR(F.shiftleft(length, 3)).bitwiseOR(run)


def logistic(d: Column) -> Column:
    """Contrast curve through (0.5, 0.5)."""
    return 1 / (1 + F.exp(-10 * (d - 0.5)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def strip_place(x: Column, y: Column, width: int, rows: int) -> Column:
    """Place of cell (x, y) when strips of `rows` rows are walked column by column."""
    return F.floor(y / rows) * (rows * width) + x * rows + y % rows


def _packed(bits: Column, unit: int, digits) -> Column:
    """Bits, a string of 0 and 1, in units of `unit` bits, the last filled with 0; digits: hex digits of a unit's bits."""
    n = F.ceil(F.length(bits) / unit).cast("int")
    part = lambda k: F.rpad(F.substring(bits, k * unit + 1, F.lit(unit)), unit, "0")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: digits(part(k)))
    return F.when(F.length(bits) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(parts, "")))


def packed_lsb(bits: Column, unit: int = 8) -> Column:
    """Bits packed in bytes or, with a unit of 32, in little-endian words, the first in the lowest place."""
    byte = lambda b, k: F.lpad(F.conv(F.reverse(F.substring(b, 8 * k + 1, 8)), 2, 16), 2, "0")
    return _packed(bits, unit, lambda b: F.concat(*[byte(b, k) for k in range(unit // 8)]))


def packed_msb(bits: Column) -> Column:
    """Bits packed in bytes, the first in the highest place."""
    return _packed(bits, 8, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0"))


def four_levels(v: Column) -> Column:
    """A value from 0 to 1 as one of four levels, the top two bits of its byte."""
    return F.shiftright(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 255))).cast("int"), 6)


def half_levels(v: Column) -> Column:
    """A value in halves; a tie goes to the even one."""
    return F.bround(v * 2, 0) / 2 + 0.0  # no negative zero


def box_of(at: Column, size: int, boxes: int) -> Column:
    """The box that a place below `size` is in, box k being from k * size // boxes to (k + 1) * size // boxes."""
    return F.ceil((at + 1) * boxes / size) - 1


def variant(tile, number: Column, side: int) -> Column:
    """A tile flipped across (bit 0 of the number), flipped down (bit 1) and inverted (bit 2)."""
    t = F.col(tile) if isinstance(tile, str) else tile
    turn = lambda k, on: F.when(on, side - 1 - k).otherwise(k)
    has = lambda bit: F.shiftright(number.cast("int"), bit).bitwiseAND(1) == 1

    def lane(i: Column) -> Column:
        v = F.get(t, turn(F.floor(i / side).cast("int"), has(1)) * side + turn(i % side, has(0)))
        return F.when(has(2), -v).otherwise(v)

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lane)


def unpacked_note(packed: Column) -> tuple[Column, Column, Column]:
    """(note, length, run) of a note in 16 bits."""
    return F.shiftright(packed, 8), F.shiftright(packed, 3).bitwiseAND(31), packed.bitwiseAND(7)


def phase_step(note: Column, rate: int) -> Column:
    """What a 16-bit phase gains with each sample of a note."""
    return F.floor(pitch_hz(note) * 65536.0 / rate + 0.5).cast("long").bitwiseAND(65535)


def strip_at(place: Column, width: int, rows: int) -> tuple[Column, Column]:
    """(x, y) of a place in strips of `rows` rows: the inverse of strip_place."""
    inside = place % (width * rows)
    return F.floor(inside / rows), F.floor(place / (width * rows)) * rows + inside % rows


def sampled(tile: Column, x: Column, y: Column, side: int) -> Column:
    """A tile's value between four pixels; beyond the last line or column these are repeated."""
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(side - 1)), F.least(y0 + 1, F.lit(side - 1))
    at = lambda a, b: F.get(tile, b * side + a).cast("double")
    return lerp(lerp(at(x0, y0), at(x1, y0), x - x0), lerp(at(x0, y1), at(x1, y1), x - x0), y - y0)
