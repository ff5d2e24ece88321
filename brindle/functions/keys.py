"""Fixed-width, order-preserving binary keys as Column expressions.

Keys compare as unsigned bytes in the order of the values. Fields are joined without framing, so
every field has a fixed width. Signed integers are big-endian with the sign bit flipped; floats
are sign-magnitude bits made monotone, with one NaN (above all) and -0 equal to +0. Float bits
come from the JVM by ``reflect``, so no Python runs. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODING_VERSION = 2
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def _bytes(value: Column, width: int) -> Column:
    """The lowest ``width`` bytes of a long, big-endian."""
    return F.unhex(F.lpad(F.right(F.hex(value), F.lit(2 * width)), 2 * width, "0"))


def key_bool(c: Column) -> Column:
    return F.when(c, F.unhex(F.lit("01"))).when(~c, F.unhex(F.lit("00")))


def key_unsigned(c: Column, width: int) -> Column:
    """Unsigned integers held in a long, or for 8 bytes in any integral type up to DECIMAL(20,0); what doesn't fit fails the job."""
    if width < 8:
        return _bytes(c.cast("bigint"), width)
    wide, word = c.cast("decimal(20,0)"), F.lit(1 << 32)
    high = F.floor(wide / word).cast("decimal(20,0)")
    bad = F.raise_error(F.concat(F.lit("not an unsigned 64-bit number: "), wide.cast("string"))).cast("binary")
    key = F.concat(_bytes(high.cast("bigint"), 4), _bytes((wide - high * word).cast("bigint"), 4))
    return F.when((wide < 0) | (high >= word), bad).otherwise(key)


def key_wide(high: Column, low: Column, *, signed: bool) -> Column:
    """16-byte integers held as two longs, the upper and the lower 64 bits."""
    return F.concat(key_signed(high, 8) if signed else _bytes(high.cast("bigint"), 8), _bytes(low.cast("bigint"), 8))


def key_of(df: DataFrame, *cols: str) -> Column:
    """The joined key of some columns."""
    return F.concat(*[encode(F.col(c), df.schema[c].dataType) for c in cols]) if cols else F.unhex(F.lit(""))


def key_stochastic(df: DataFrame, params: list[str], repetition: str) -> Column:
    """param, then the repetition as 8 unsigned bytes."""
    return F.concat(key_of(df, *params), key_unsigned(F.col(repetition), 8))


def key_dependent(df: DataFrame, params: list[str], source: Column, repetition: str | None = None) -> Column:
    """param, the upstream result's key, and for a stochastic stage its repetition; keys of one parameter stand together."""
    parts = [key_of(df, *params), source]
    return F.concat(*parts, *([key_unsigned(F.col(repetition), 8)] if repetition else []))


def key_signed(c: Column, width: int) -> Column:
    flip = F.lit(-(1 << 63)) if width == 8 else F.lit(1 << (8 * width - 1))
    return _bytes(c.cast("bigint").bitwiseXOR(flip), width)


def key_float(c: Column, width: int = 8) -> Column:
    """Double (8) or float (4) keys; reflect's ToBits calls already give a single NaN."""
    kind, call = ("double", "java.lang.Double', 'doubleToLongBits") if width == 8 else ("float", "java.lang.Float', 'floatToIntBits")
    zero = F.lit(0.0).cast(kind)
    v = F.when(c == 0, zero).otherwise(c.cast(kind))
    cls, method = call.split("', '")
    bits = F.reflect(F.lit(cls), F.lit(method), v).cast("bigint")
    top = F.lit(-(1 << 63)) if width == 8 else F.lit(1 << 31)
    return F.when(c.isNull(), F.lit(None)).otherwise(_bytes(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(top)), width))


def encode(c: Column, kind: T.DataType) -> Column:
    """The key of a column of the given type: scalars, structs field by field, arrays of equal length element by element."""
    name = kind.simpleString()
    if name == "boolean":
        return key_bool(c)
    if name in ("float", "double"):
        return key_float(c, WIDTHS[name])
    if name in WIDTHS:
        return key_signed(c, WIDTHS[name])
    if name == "decimal(20,0)":
        return key_unsigned(c, 8)
    if isinstance(kind, T.StructType):
        parts = [encode(c[f.name], f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else F.unhex(F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.transform(c, lambda x: encode(x, kind.elementType)), F.unhex(F.lit("")), lambda s, x: F.concat(s, x))
    raise TypeError(f"{name} has no fixed-width key")


def width_of(kind: T.DataType, array_length: int | None = None) -> int:
    """Bytes of a key of this type; arrays need their fixed length."""
    if isinstance(kind, T.StructType):
        return sum(width_of(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        if array_length is None:
            raise TypeError("an array key needs a fixed length")
        return array_length * width_of(kind.elementType)
    return 8 if kind.simpleString() == "decimal(20,0)" else WIDTHS[kind.simpleString()]


def with_key(df: DataFrame, *cols: str, out: str = "key", check: bool = True, array_length: int | None = None) -> DataFrame:
    """``df`` with the joined key of some columns; a key of another width than declared fails the job.

    Array columns need their one ``array_length`` to be checked.
    """
    key = key_of(df, *cols)
    if check and (array_length is not None or not any(isinstance(df.schema[c].dataType, T.ArrayType) for c in cols)):
        width = sum(width_of(df.schema[c].dataType, array_length) for c in cols)
        key = F.when(key.isNull() | (F.length(key) == width), key).otherwise(F.raise_error(F.lit(f"key is not {width} bytes wide")).cast("binary"))
    return df.withColumn(out, key)


def source_part(key: Column, param_width: int, source_width: int) -> Column:
    """The upstream key inside a dependent key (parameter, source, ...)."""
    return F.substring(key, param_width + 1, source_width)
