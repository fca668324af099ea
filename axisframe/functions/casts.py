"""Element types and the conversions allowed between them.

Spark has no unsigned types: u8, u16 and u32 are held in the next wider signed type and u64 as a decimal, with the
declared type kept beside; casts check the declared range and fail on overflow instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Declared type -> the Spark type that holds it.
HELD_AS = {
    "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint",
    "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)",
    "f32": "float", "f64": "double", "bool": "boolean", "string": "string",
}
INTEGERS = ("i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64")
_BITS = {k: int(k[1:]) for k in INTEGERS}
LIMITS = {k: (-(1 << (b - 1)), (1 << (b - 1)) - 1) if k[0] == "i" else (0, (1 << b) - 1) for k, b in _BITS.items()}
FROM_SPARK = {"tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64", "float": "f32", "double": "f64", "boolean": "bool", "string": "string", "decimal(20,0)": "u64"}
#: Default for missing values of a type.
ZERO = {k: 0 for k in INTEGERS} | {"f32": 0.0, "f64": 0.0, "bool": False, "string": ""}

_SMALL = ("i8", "i16", "u8", "u16")
#: Dense conversions: target -> sources.  Floats are not narrowed to integers; single precision takes only what it holds
#: exactly, double precision what is at most 32 bits wide.
DENSE = (
    {k: (*INTEGERS, "bool") for k in INTEGERS}
    | {"f32": (*_SMALL, "bool", "f32"), "f64": (*_SMALL, "i32", "u32", "bool", "f32", "f64"), "bool": ("bool",), "string": (*INTEGERS, "f32", "f64", "bool", "string")}
)
#: Sparse conversions: u32 from integers and booleans, floats from every number.
SPARSE = {"u32": (*INTEGERS, "bool"), "f32": (*INTEGERS, "bool", "f32", "f64"), "f64": (*INTEGERS, "bool", "f32", "f64")}


class CastError(TypeError):
    """A conversion that is not allowed."""


def dtype_of(spark_type: str) -> str:
    if spark_type not in FROM_SPARK:
        raise CastError(f"no element type is held as {spark_type}")
    return FROM_SPARK[spark_type]


def convert(value: Column, source: str, target: str, rules: dict = DENSE) -> Column:
    """``value`` as the target type; an overflow fails the query, null stays null."""
    if source == target:
        return value
    if source not in rules.get(target, ()):
        raise CastError(f"cannot convert {source} to {target}")
    if target not in INTEGERS:
        return value.cast(HELD_AS[target])
    wide = value.cast("int").cast("decimal(20,0)") if source == "bool" else value.cast("decimal(20,0)")
    low, high = LIMITS[target]
    fits = wide.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)"))
    message = F.concat(F.lit(f"{target} cannot hold "), wide.cast("string"))
    return F.when(value.isNull() | fits, wide.cast(HELD_AS[target])).otherwise(F.raise_error(message).cast(HELD_AS[target]))
