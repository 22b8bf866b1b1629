"""Tagged bytes of values, for import and export: a tag byte, then the payload (numbers are little-endian).

Inside the engine values stay typed columns, so this is only used at the edges. Everything but doubles is built-in
functions; doubles take an Arrow UDF, as SQL has no cast between doubles and bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import VALUE

#: The tag byte of each kind.
TAGS = {"String": 1, "Bytes": 2, "f64": 3, "i64": 4, "u64": 5, "bool": 6}


@F.arrow_udf(T.BinaryType())
def double_bytes(x: pa.Array) -> pa.Array:
    data = np.ascontiguousarray(x.to_numpy(zero_copy_only=False), "<f8")
    made = pa.Array.from_buffers(pa.binary(8), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())
    return pc.if_else(x.is_valid(), made, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.DoubleType())
def bytes_double(x: pa.Array) -> pa.Array:
    data = np.frombuffer(b"".join(pc.fill_null(x, bytes(8)).to_pylist()), "<f8")
    return pa.array(data, pa.float64(), mask=x.is_null().to_numpy(zero_copy_only=False), from_pandas=False)


def tagged(value: tuple) -> bytes:
    """The tagged bytes of one value row (kind, then a field a kind), in Python."""
    import struct

    kind, s, b, f, i, u, t = value
    body = {"String": lambda: s.encode(), "Bytes": lambda: bytes(b), "f64": lambda: struct.pack("<d", f), "i64": lambda: struct.pack("<q", i), "u64": lambda: struct.pack("<Q", int(u)), "bool": lambda: bytes([t])}
    return bytes([TAGS[kind]]) + body[kind]()


def is_empty(op: Column, data: Column) -> Column:
    """Whether an entry has nothing to show: a delete, or a put of no bytes."""
    return (op == "delete") | (F.octet_length(data) == 0)


def swapped(hexes: Column) -> Column:
    """16 hex digits in the opposite order of bytes."""
    return F.concat(*[F.substring(hexes, 2 * k - 1, 2) for k in range(8, 0, -1)])


def int_bytes(n: Column) -> Column:
    return F.unhex(swapped(F.lpad(F.hex(n), 16, "0")))


def unsigned_bytes(n: Column) -> Column:
    return F.unhex(swapped(F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0")))


def encode(value: Column) -> Column:
    """Tagged bytes of a value struct; null for a null value."""
    tag = lambda k: F.unhex(F.lit(f"{TAGS[k]:02X}"))
    kind = value["kind"]
    return (
        F.when(kind == "String", F.concat(tag("String"), F.encode(value["s"], "UTF-8")))
        .when(kind == "Bytes", F.concat(tag("Bytes"), value["b"]))
        .when(kind == "f64", F.concat(tag("f64"), double_bytes(value["f"])))
        .when(kind == "i64", F.concat(tag("i64"), int_bytes(value["i"])))
        .when(kind == "u64", F.concat(tag("u64"), unsigned_bytes(value["u"])))
        .when(kind == "bool", F.concat(tag("bool"), F.when(value["t"], F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))))
    )


def decode(data: Column) -> Column:
    """The value struct of tagged bytes. Null where the tag is unknown, the payload too short or a string not UTF-8."""
    rest = F.substring(data, 2, 2147483647)
    tag, size = F.hex(F.substring(data, 1, 1)), F.octet_length(data)
    eight = swapped(F.hex(F.substring(rest, 1, 8)))
    text = F.try_validate_utf8(rest.cast("string"))
    long = F.when(size >= 9, eight)
    unsigned = F.conv(long, 16, 10).cast("decimal(20,0)")
    signed = F.when(unsigned > F.lit(9223372036854775807), unsigned - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(unsigned).cast("bigint")
    parts = {
        "s": F.when(tag == "01", text),
        "b": F.when(tag == "02", rest),
        "f": bytes_double(F.when((tag == "03") & (size >= 9), F.substring(rest, 1, 8))),
        "i": F.when(tag == "04", signed),
        "u": F.when(tag == "05", unsigned),
        "t": F.when((tag == "06") & (size >= 2), F.hex(F.substring(rest, 1, 1)) != "00"),
    }
    kind = F.when((tag == "01") & text.isNotNull(), "String").when(tag == "02", "Bytes")
    for t, k in (("03", "f64"), ("04", "i64"), ("05", "u64")):
        kind = kind.when((tag == t) & (size >= 9), k)
    kind = kind.when((tag == "06") & (size >= 2), "bool")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), *[parts[f.name].cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]]))


def byte_size(value: Column) -> Column:
    """Bytes that a value takes when tagged, without encoding it."""
    kind = value["kind"]
    return F.when(kind == "String", 1 + F.octet_length(value["s"])).when(kind == "Bytes", 1 + F.octet_length(value["b"])).when(kind == "bool", F.lit(2)).when(kind.isNotNull(), F.lit(9)).otherwise(F.lit(0))
