"""Scalar functions on 32-bit values: widths, float bits, ULP distance, IEEE and wrapping arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32


def bit_width(x: Column) -> Column:
    """Bits needed for a non-negative integer; 0 for 0. By digits, as rounded logs are off by one."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def leb128_bytes(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bit_width(x) / 7).cast("int"))


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as a long in [0, 2^32)."""
    signed = F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("long")
    return F.pmod(signed, F.lit(U32))


def bits_float(bits: Column) -> Column:
    signed = F.when(bits >= U32 // 2, bits - U32).otherwise(bits).cast("int")
    return F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), signed).cast("float")


def monotone_key(bits: Column) -> Column:
    """Maps float bits to integers in the floats' order."""
    return F.when(bits >= U32 // 2, F.lit(U32 - 1) - bits).otherwise(bits + U32 // 2)


def ulp_distance(a_bits: Column, b_bits: Column) -> Column:
    """Steps between two floats given as bits; 0 for equal values, so for +0 and -0 too."""
    zeros = a_bits.isin(0, U32 // 2) & b_bits.isin(0, U32 // 2)
    return F.when((a_bits == b_bits) | zeros, F.lit(0)).otherwise(F.abs(monotone_key(a_bits) - monotone_key(b_bits))).cast("long")


def relative_error(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-30))


def normalize_ulp(mean: Column, scale: Column | float = 16.0) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(mean <= 0, F.lit(0.0)).otherwise(1 - F.exp(-mean / F.greatest(scale, F.lit(1e-9))))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b without an error: x/0 is an infinity, 0/0 is NaN."""
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(inf)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def wrap32(x: Column) -> Column:
    """A long as a signed 32-bit integer, modulo 2^32."""
    return (F.pmod(x + U32 // 2, F.lit(U32)) - U32 // 2).cast("int")


def unsigned(x: Column) -> Column:
    return F.pmod(x.cast("long"), F.lit(U32))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fused_multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a b + c in floats, rounded once."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("fma"), a.cast("float"), b.cast("float"), c.cast("float")).cast("float")


def strict_multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a b + c in floats, rounded twice."""
    return (a.cast("float") * b.cast("float")).cast("float") + c.cast("float")
