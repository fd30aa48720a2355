"""The advisory Arrow schema in a file's footer, and what it may add to what the file says itself."""

from __future__ import annotations

import base64
import binascii

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MetadataLimitError
from .footer import part_files, read_footer

KEY = "ARROW:schema"
#: The most bytes of an encoded and of a decoded hint, the deepest nesting, and the most fields.
MAX_ENCODED, MAX_DECODED, MAX_DEPTH, MAX_FIELDS = 8 << 20, 6 << 20, 64, 10_000


def _measure(fields, depth: int) -> int:
    if depth > MAX_DEPTH:
        raise MetadataLimitError(f"a schema hint is nested deeper than {MAX_DEPTH}")
    n = 0
    for f in fields:
        kind = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
        n += 1 + _measure([kind.field(i) for i in range(kind.num_fields)], depth + 1)
        if n > MAX_FIELDS:
            raise MetadataLimitError(f"a schema hint has more than {MAX_FIELDS} fields")
    return n


def encode(schema: pa.Schema) -> str:
    """A schema as one IPC message in base64."""
    _measure(schema, 1)
    raw = schema.serialize().to_pybytes()
    if len(raw) > MAX_DECODED:
        raise MetadataLimitError(f"a schema hint of {len(raw)} bytes")
    return base64.b64encode(raw).decode()


def decode(text: str) -> pa.Schema:
    """The schema that a hint holds. MetadataLimitError beyond the limits; ValueError for what is no hint, or more than one message."""
    if len(text) > MAX_ENCODED:
        raise MetadataLimitError(f"a schema hint of {len(text)} characters")
    try:
        raw = base64.b64decode(text, validate=True)
    except binascii.Error as error:
        raise ValueError("a schema hint is not base64") from error
    if len(raw) > MAX_DECODED:
        raise MetadataLimitError(f"a schema hint of {len(raw)} bytes")
    try:
        source = pa.BufferReader(raw)
        schema = pa.ipc.read_schema(source)
        rest = raw[source.tell() :]
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError("a schema hint is no schema message") from error
    if rest.strip(b"\0") and rest != b"\xff\xff\xff\xff\0\0\0\0":
        raise ValueError("a schema hint has more than one message")
    _measure(schema, 1)
    return schema


def hint_of(spark: SparkSession, path: str) -> pa.Schema | None:
    """The hint in the footer of a table's first file, or None: a missing, malformed or oversize one is passed over, never an error."""
    files = part_files(spark, path)
    try:
        return decode(read_footer(spark, files[0]).keys[KEY]) if files else None
    except (KeyError, ValueError, MetadataLimitError):
        return None


def advice(schema: T.StructType, hint: pa.Schema) -> dict[str, dict]:
    """Metadata by column that a hint adds: for columns of the same name, number of children and place, if both have as many columns.

    A zone's name is taken where file and hint agree that the time is an instant; large strings and binaries are noted; other metadata
    of a field are taken as they are."""
    if len(schema.fields) != len(hint):
        return {}
    out = {}
    for field, own in zip(schema.fields, hint, strict=True):
        if field.name != own.name or not _same_shape(field.dataType, own.type):
            continue
        more = {k.decode(errors="replace"): v.decode(errors="replace") for k, v in (own.metadata or {}).items() if not k.startswith(b"PARQUET:")}
        if pa.types.is_timestamp(own.type) and isinstance(field.dataType, T.TimestampType) and own.type.tz:
            more["zone"] = own.type.tz
        if pa.types.is_large_string(own.type) or pa.types.is_large_binary(own.type):
            more["arrow"] = str(own.type)
        if more:
            out[field.name] = more
    return out


def _same_shape(kind: T.DataType, own: pa.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return pa.types.is_struct(own) and [f.name for f in kind.fields] == [own.field(i).name for i in range(own.num_fields)]
    if isinstance(kind, T.ArrayType):
        return pa.types.is_list(own) or pa.types.is_large_list(own) or pa.types.is_fixed_size_list(own)
    if isinstance(kind, T.MapType):
        return pa.types.is_map(own)
    return not own.num_fields


def refined(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """df, read from path, with what the file's hint adds to its columns' metadata. What the file says itself outweighs the hint."""
    hint = hint_of(spark, path)
    if hint is None:
        return df
    more = advice(df.schema, hint)
    return df.select(*[F.col("`" + f.name.replace("`", "``") + "`").alias(f.name, metadata={**more.get(f.name, {}), **(f.metadata or {})}) for f in df.schema.fields])
