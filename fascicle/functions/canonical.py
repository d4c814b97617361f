"""Canonical JSON of nested columns, byte for byte as a sorted dump without ASCII escapes writes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType

#: The escapes of a JSON string: these characters by name, other control characters as \\u00xx.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(value: Column) -> Column:
    """A JSON string; characters beyond ASCII stand as they are."""

    def escaped(v: Column) -> Column:
        for plain, other in ESCAPES.items():
            v = F.replace(v, F.lit(plain), F.lit(other))
        for code in [*range(8), 11, *range(14, 32)]:
            v = F.replace(v, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return v

    return F.concat(F.lit('"'), bound(value, lambda v: F.when(v.rlike(r'[\x00-\x1f"\\\\]'), escaped(v)).otherwise(v)), F.lit('"'))


def real(value: Column) -> Column:
    """A double as its shortest decimal that reads back: plain from 1e-4 below 1e16, else with an exponent of two digits or more."""

    def shortest(v: Column) -> Column:
        """d.ddde±n of the fewest digits that read back; the JVM's own text may have one too many."""
        tries = F.array(*[F.format_string(f"%.{k}e", v) for k in range(17)])
        return F.element_at(F.filter(tries, lambda t: t.cast("double") == v), 1)

    def parts(shown: Column) -> Column:
        mantissa, exponent = F.split_part(shown, F.lit("e"), F.lit(1)), F.split_part(shown, F.lit("e"), F.lit(2)).try_cast("int")
        whole = F.split_part(mantissa, F.lit("."), F.lit(1))
        return F.struct(F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"), (F.coalesce(exponent, F.lit(0)) + F.length(whole) - 1).alias("power"))

    def leading(p: Column) -> Column:  # power: of the first digit that isn't zero
        bare = F.regexp_replace(p["digits"], "^0+", "")
        return F.struct(F.regexp_replace(bare, "0+$", "").alias("digits"), (p["power"] - F.length(p["digits"]) + F.length(bare)).alias("power"))

    def shown(p: Column) -> Column:
        digits, power, n = p["digits"], p["power"], F.length(p["digits"])
        plain = (
            F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when(n <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
        )
        size = F.abs(power).cast("string")
        size = F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0"))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        far = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(power < 0, "-").otherwise("+"), size)
        return F.when(power.between(-4, 15), plain).otherwise(far)

    def told(v: Column) -> Column:
        sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
        number = bound(bound(bound(shortest(F.abs(v)), parts), leading), shown)
        return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(v == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, number))

    return bound(value, told)


def dumped(value: Column, kind: DataType) -> Column:
    """A column's JSON by its type: keys sorted at every depth, ``, `` and ``: `` between, null for null."""
    if isinstance(kind, StructType):
        names = sorted(kind.fieldNames(), key=lambda n: [ord(c) for c in n])
        parts = [F.concat(quoted(F.lit(n)), F.lit(": "), dumped(value.getField(n), kind[n].dataType)) for n in names]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: dumped(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        shown = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(quoted(k), F.lit(": "), dumped(F.element_at(value, k), kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, BooleanType):
        shown = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        shown = value.cast("string")
    elif isinstance(kind, (DoubleType, FloatType)):
        shown = real(value.cast("double"))
    elif isinstance(kind, StringType):
        shown = quoted(value)
    elif isinstance(kind, DecimalType):
        shown = quoted(value.cast("string"))
    else:  # dates, times and others as their text
        shown = quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(shown)


def canonical_json(value: Column, kind: DataType) -> Column:
    return dumped(value, kind)


def json_hash(value: Column, kind: DataType) -> Column:
    """The SHA-256 of canonical_json(): a record's identity whatever the order of its fields."""
    return F.sha2(canonical_json(value, kind), 256)
