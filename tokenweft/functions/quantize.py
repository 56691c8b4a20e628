"""Residual quantisation to 1, 2, 4 or 8 bits and bit packing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenweft.functions.vectors import col, let

#: Half of the largest code for each width over one bit.
HALF = {2: 1.5, 4: 7.5, 8: 127.5}
BITS = (1, *HALF)


def check_bits(bits: int) -> int:
    if bits not in BITS:
        raise ValueError(f"residual bits must be one of {BITS}, not {bits}")
    return bits


def quantize(residual: Column | str, bits: int) -> Column:
    """Codes: the sign (over 0) for 1 bit, else the residual clipped to [-1, 1] on an even scale of 2**bits values."""
    if check_bits(bits) == 1:
        return F.transform(col(residual), lambda x: F.when(x > 0, 1).otherwise(0))
    half = HALF[bits]
    return F.transform(col(residual), lambda x: F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1.0) * half).cast("int"))


def dequantize(codes: Column | str, bits: int) -> Column:
    if check_bits(bits) == 1:
        return F.transform(col(codes), lambda c: c.cast("double") * 2.0 - 1.0)
    return F.transform(col(codes), lambda c: c.cast("double") / HALF[bits] - 1.0)


def pack(codes: Column | str, bits: int) -> Column:
    """Codes as bytes, first code in the highest bits; the last byte is filled with zero bits."""
    per = 8 // check_bits(bits)
    c = col(codes)
    byte = lambda v, i: sum((F.shiftleft(F.coalesce(F.get(v, i * per + j), F.lit(0)).cast("int"), bits * (per - 1 - j)) for j in range(per)), F.lit(0))
    n = F.size(c)
    digits = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / per).cast("int") - 1), lambda i: F.lpad(F.hex(byte(v, i)), 2, "0"))
    return F.when(n > 0, F.unhex(F.array_join(let(c, digits), ""))).otherwise(F.lit("").cast("binary"))


def unpack(data: Column | str, bits: int, dim: Column | int) -> Column:
    """The first dim codes of packed bytes."""
    per = 8 // check_bits(bits)
    dim = F.lit(dim) if isinstance(dim, int) else dim

    def codes(text: Column) -> Column:
        """text: one character for each byte."""

        def code(i: Column) -> Column:
            byte = F.ascii(F.substring(text, F.floor(i / per).cast("int") + 1, F.lit(1)))
            if bits == 8:
                return byte
            return F.floor(byte / F.pow(F.lit(2), (F.lit(per - 1) - i % per) * bits)).cast("int") % (1 << bits)

        return F.transform(F.sequence(F.lit(0), dim - 1), code)

    return F.when(dim > 0, let(F.decode(col(data), "ISO-8859-1"), codes)).otherwise(F.array().cast("array<int>"))


def ratio(dim: int, bits: int) -> float:
    """Bytes of a float vector over those of its codes and a two-byte centroid id, to two digits."""
    return round(dim * 4 / (2 + dim // (8 // check_bits(bits))), 2)
