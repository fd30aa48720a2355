"""The type contract: which Spark types are written, how Parquet holds them, and what is rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import UnsupportedTypeError

#: Field metadata that carry what a Spark type can't: the unit of a long or integer, that of a time of day, the width of a
#: binary, the size of a list, and that a column of integers stands for nulls alone.
UNIT, TIME_UNIT, WIDTH, SIZE, VARIANT, NULLS = "unit", "time_unit", "fixed_width", "fixed_size", "variant", "nulls"
MAX_DECIMAL = 38
MAP_KEYS = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def min_decimal_bytes(precision: int) -> int:
    """The fewest bytes of two's complement that hold every unscaled value of that many digits."""
    size = 1
    while 2 ** (8 * size - 1) < 10**precision:
        size += 1
    return size


def decimal_physical(precision: int, scale: int = 0) -> str:
    """INT32, INT64 or FIXED(n), by precision."""
    if not 1 <= precision <= MAX_DECIMAL or not 0 <= scale <= precision:
        raise UnsupportedTypeError(f"decimal({precision},{scale}) is outside the contract")
    if precision <= 9:
        return "INT32"
    return "INT64" if precision <= 18 else f"FIXED({min_decimal_bytes(precision)})"


#: Primitive Spark types with the physical type and annotation that stand for them in a file.
_PRIMITIVES: dict[type, tuple[str, str]] = {
    T.BooleanType: ("BOOLEAN", ""),
    T.ByteType: ("INT32", "INT(8,true)"),
    T.ShortType: ("INT32", "INT(16,true)"),
    T.IntegerType: ("INT32", ""),
    T.LongType: ("INT64", ""),
    T.FloatType: ("FLOAT", ""),
    T.DoubleType: ("DOUBLE", ""),
    T.StringType: ("BINARY", "STRING"),
    T.BinaryType: ("BINARY", ""),
    T.DateType: ("INT32", "DATE"),
    T.TimestampType: ("INT64", "TIMESTAMP(MICROS,true)"),
    T.TimestampNTZType: ("INT64", "TIMESTAMP(MICROS,false)"),
}


@dataclass(frozen=True)
class Stored:
    """How a leaf or container is stored: its dotted path, physical type (or GROUP), annotation, and whether null is allowed."""

    path: str
    physical: str
    annotation: str
    nullable: bool


def stored_columns(schema: T.StructType) -> list[Stored]:
    """Every column and nested field of the schema as it will be stored; UnsupportedTypeError for what can't be."""
    out: list[Stored] = []
    _fields(schema, "", out)
    return out


def _fields(schema: T.StructType, prefix: str, out: list[Stored]) -> None:
    if not schema.fields:
        raise UnsupportedTypeError(f"{prefix or 'schema'}: a struct needs at least one field")
    seen: set[str] = set()
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if field.name in seen:
            raise UnsupportedTypeError(f"{path}: duplicate field name cannot round-trip through Parquet")
        seen.add(field.name)
        _field(field.dataType, path, field.nullable, field.metadata or {}, out)


def _field(kind: T.DataType, path: str, nullable: bool, metadata: dict, out: list[Stored]) -> None:
    if isinstance(kind, T.StructType):
        if metadata.get(VARIANT):
            check_variant_storage(kind, path)
        out.append(Stored(path, "GROUP", "VARIANT(1)" if metadata.get(VARIANT) else "", nullable))
        _fields(kind, path, out)
    elif isinstance(kind, T.ArrayType):
        out.append(Stored(path, "GROUP", "LIST", nullable))
        _field(kind.elementType, f"{path}.list.element", kind.containsNull, {}, out)
    elif isinstance(kind, T.MapType):
        #: Keys of other types are rejected by value, so that an empty map of them passes.
        out.append(Stored(path, "GROUP", "MAP", nullable))
        _field(kind.keyType, f"{path}.key_value.key", False, {}, out)
        _field(kind.valueType, f"{path}.key_value.value", kind.valueContainsNull, {}, out)
    elif isinstance(kind, T.VariantType):
        out.append(Stored(path, "GROUP", "VARIANT(1)", nullable))
    elif isinstance(kind, T.DecimalType):
        out.append(Stored(path, decimal_physical(kind.precision, kind.scale), f"DECIMAL({kind.precision},{kind.scale})", nullable))
    elif isinstance(kind, T.NullType):
        if not nullable:
            raise UnsupportedTypeError(f"{path}: a column of nulls must be nullable")
        out.append(Stored(path, "BOOLEAN", "UNKNOWN", True))
    elif type(kind) in _PRIMITIVES:
        physical, annotation = _PRIMITIVES[type(kind)]
        out.append(Stored(path, physical, annotation, nullable))
    else:
        raise UnsupportedTypeError(f"{path}: {kind.simpleString()} is outside the contract")


def arrow_columns(schema) -> list[Stored]:
    """Every column and nested field of an Arrow schema as the contract stores it; UnsupportedTypeError for what it rejects."""
    out: list[Stored] = []
    _arrow_fields(list(schema), "", out)
    return out


def _arrow_fields(fields: list, prefix: str, out: list[Stored]) -> None:
    if not fields:
        raise UnsupportedTypeError(f"{prefix or 'schema'}: a struct needs at least one field")
    seen: set[str] = set()
    for f in fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if f.name in seen:
            raise UnsupportedTypeError(f"{path}: duplicate field name cannot round-trip through Parquet")
        seen.add(f.name)
        _arrow_field(f.type, path, f.nullable, out)


def _arrow_field(kind, path: str, nullable: bool, out: list[Stored]) -> None:
    import pyarrow as pa

    t = pa.types
    if t.is_dictionary(kind):
        _arrow_field(kind.value_type, path, nullable, out)
    elif t.is_struct(kind):
        out.append(Stored(path, "GROUP", "", nullable))
        _arrow_fields([kind.field(i) for i in range(kind.num_fields)], path, out)
    elif t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind):
        if t.is_fixed_size_list(kind) and kind.list_size <= 0:
            raise UnsupportedTypeError(f"{path}: {kind} is outside the contract")
        out.append(Stored(path, "GROUP", "LIST", nullable))
        _arrow_field(kind.value_type, f"{path}.list.element", kind.value_field.nullable, out)
    elif t.is_map(kind):
        out.append(Stored(path, "GROUP", "MAP", nullable))
        _arrow_field(kind.key_type, f"{path}.key_value.key", False, out)
        _arrow_field(kind.item_type, f"{path}.key_value.value", kind.item_field.nullable, out)
    else:
        physical, annotation = arrow_primitive(kind, path, nullable)
        out.append(Stored(path, physical, annotation, nullable))


def arrow_primitive(kind, path: str = "value", nullable: bool = True) -> tuple[str, str]:
    """The physical type and annotation of an Arrow type without children."""
    import pyarrow as pa

    t = pa.types
    name = str(kind)
    if t.is_null(kind):
        if not nullable:
            raise UnsupportedTypeError(f"{path}: a column of nulls must be nullable")
        return "INT32", "UNKNOWN"
    if t.is_boolean(kind):
        return "BOOLEAN", ""
    if t.is_integer(kind):
        return "INT64" if kind.bit_width == 64 else "INT32", f"INT({kind.bit_width},{str(t.is_signed_integer(kind)).lower()})"
    if t.is_float32(kind) or t.is_float64(kind):
        return "FLOAT" if t.is_float32(kind) else "DOUBLE", ""
    if name in ("string", "large_string", "string_view"):
        return "BINARY", "STRING"
    if name in ("binary", "large_binary", "binary_view"):
        return "BINARY", ""
    if t.is_fixed_size_binary(kind) and not t.is_decimal(kind) and kind.byte_width > 0:
        return f"FIXED({kind.byte_width})", ""
    if t.is_decimal128(kind) or t.is_decimal256(kind):
        if not 0 <= kind.scale <= kind.precision:
            raise UnsupportedTypeError(f"{path}: {kind} is outside the contract")
        return ("FIXED(32)" if t.is_decimal256(kind) else decimal_physical(kind.precision, kind.scale)), f"DECIMAL({kind.precision},{kind.scale})"
    if t.is_date(kind):
        return "INT32", "DATE"
    #: Seconds are stored as milliseconds.
    unit = {"s": "MILLIS", "ms": "MILLIS", "us": "MICROS", "ns": "NANOS"}.get(getattr(kind, "unit", ""), "")
    if t.is_time(kind):
        return "INT32" if kind.bit_width == 32 else "INT64", f"TIME({unit},true)"
    if t.is_timestamp(kind):
        if kind.tz == "":
            raise UnsupportedTypeError(f"{path}: a zone needs a name")
        return "INT64", f"TIMESTAMP({unit},{str(kind.tz is not None).lower()})"
    if t.is_duration(kind):
        return "INT64", ""
    raise UnsupportedTypeError(f"{path}: {kind} is outside the contract")


def check_variant_storage(kind: T.StructType, path: str) -> None:
    """A variant's storage: metadata and value as binary, or a typed value instead of or beside the value; nothing else."""
    names = {f.name: f.dataType for f in kind.fields}
    if not isinstance(names.pop("metadata", None), T.BinaryType):
        raise UnsupportedTypeError(f"{path}: a variant needs binary metadata")
    value, typed = names.pop("value", None), names.pop("typed_value", None)
    if value is None and typed is None or value is not None and not isinstance(value, T.BinaryType):
        raise UnsupportedTypeError(f"{path}: a variant needs a binary value or a typed value")
    if names:
        raise UnsupportedTypeError(f"{path}: {sorted(names)[0]} is no part of a variant")


def schema_differences(expected: T.StructType, actual: T.StructType, names_of_levels: bool = False, path: str = "") -> list[tuple[str, str]]:
    """(path, detail) of every difference in names, types and nesting; nullability does not count, as files read as nullable."""
    out = []
    for i in range(max(len(expected.fields), len(actual.fields))):
        e = expected.fields[i] if i < len(expected.fields) else None
        a = actual.fields[i] if i < len(actual.fields) else None
        at = f"{path}.{(e or a).name}" if path else (e or a).name
        if e is None or a is None:
            out.append((at, "missing" if a is None else "unexpected"))
        elif e.name != a.name:
            out.append((at, f"named {a.name}"))
        else:
            out += _type_differences(e.dataType, a.dataType, at)
    return out


def _type_differences(e: T.DataType, a: T.DataType, at: str) -> list[tuple[str, str]]:
    if isinstance(e, T.StructType) and isinstance(a, T.StructType):
        return schema_differences(e, a, path=at)
    if isinstance(e, T.ArrayType) and isinstance(a, T.ArrayType):
        return _type_differences(e.elementType, a.elementType, f"{at}.element")
    if isinstance(e, T.MapType) and isinstance(a, T.MapType):
        return _type_differences(e.keyType, a.keyType, f"{at}.key") + _type_differences(e.valueType, a.valueType, f"{at}.value")
    return [] if e == a else [(at, f"{e.simpleString()} became {a.simpleString()}")]
