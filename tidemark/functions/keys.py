"""Keys and schemas.

A changelog row is (key BINARY, seq BIGINT, op STRING 'put' | 'delete', value struct). `seq` is the recency that other
engines keep in the position of a run: greater is newer, and no two rows of a key share one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = "put", "delete"

#: A value is one of six kinds; only the kind's own field is set.
VALUE = (
    T.StructType()
    .add("kind", T.StringType())
    .add("s", T.StringType())
    .add("b", T.BinaryType())
    .add("f", T.DoubleType())
    .add("i", T.LongType())
    .add("u", T.DecimalType(20, 0))
    .add("t", T.BooleanType())
)
CHANGELOG = T.StructType().add("key", T.BinaryType()).add("seq", T.LongType()).add("op", T.StringType()).add("value", VALUE)
FIELD_OF = {"String": "s", "Bytes": "b", "f64": "f", "i64": "i", "u64": "u", "bool": "t"}


def int_key(n: Column) -> Column:
    """Eight bytes of a non-negative integer, in the integer's order."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def value_of(kind: str, field: Column) -> Column:
    """A value struct of one kind."""
    chosen = FIELD_OF[kind]
    parts = [F.lit(kind).alias("kind")] + [(field if f.name == chosen else F.lit(None)).cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]]
    return F.struct(*parts)


def run_file_name(number: Column) -> Column:
    """The name under which a run of this number is listed (a fixed format): five digits or more."""
    return F.format_string("sst-%05d.sst", number)
