"""Projection of top-level and nested columns, resolved case-sensitively before Spark plans the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFileError

Path = tuple[str, ...]


def field_path(*segments: str) -> Path:
    """A path of field names. Empty names are allowed, empty paths and missing names are not."""
    if not segments or any(s is None for s in segments):
        raise ValueError("a field path needs at least one name, and no name may be missing")
    return tuple(segments)


def project(df: DataFrame, paths: Iterable[Path | Sequence[str] | str] | None) -> DataFrame:
    """df with the selected columns and nested fields, in file order whatever the order asked for.

    A whole column outweighs paths below it. A path into a list or map selects all of it. An unknown top-level
    name, a path through a primitive, and a struct of which nothing is selected are InvalidFileErrors; an unknown
    nested name beside a known one is passed over. Nulls of a struct stay nulls. None selects everything."""
    if paths is None:
        return df
    wanted = [field_path(*([p] if isinstance(p, str) else p)) for p in paths]
    known = {f.name for f in df.schema.fields}
    for path in wanted:
        if path[0] not in known:
            raise InvalidFileError(f"no column named {path[0]!r}")
    columns = []
    for field in df.schema.fields:
        own = [p[1:] for p in wanted if p[0] == field.name]
        if own:
            quoted = F.col(f"`{field.name.replace('`', '``')}`")
            columns.append(_narrow(quoted, field.dataType, own, field.name).alias(field.name, metadata=field.metadata or {}))
    return df.select(*columns)


def _narrow(column: Column, kind: T.DataType, paths: list[Path], at: str) -> Column:
    if any(not p for p in paths) or isinstance(kind, T.ArrayType | T.MapType):
        return column
    if not isinstance(kind, T.StructType):
        raise InvalidFileError(f"{at} is no struct")
    children = []
    for field in kind.fields:
        own = [p[1:] for p in paths if p[0] == field.name]
        if own:
            children.append(_narrow(column.getField(field.name), field.dataType, own, f"{at}.{field.name}").alias(field.name))
    if not children:
        raise InvalidFileError(f"nothing is selected in {at}")
    return F.when(column.isNotNull(), F.struct(*children))
