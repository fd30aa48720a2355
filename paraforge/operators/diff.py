"""Comparison of two datasets in four dimensions: schema, values, shape of nesting, field metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conversions import same_float
from ..types import MAP_KEYS, schema_differences

DIMENSIONS = ("SCHEMA", "LOGICAL_VALUES", "NULL_EMPTY_NESTED_SHAPE", "FIELD_METADATA")


def _shape(c: Column, kind: T.DataType) -> Column:
    """A text that is equal for values of one shape: nulls, sizes of lists and maps, all the way down."""
    if isinstance(kind, T.StructType):
        inner = F.concat_ws(",", *[_shape(c.getField(f.name), f.dataType) for f in kind.fields])  # never null, so none is left out
        return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("("), inner, F.lit(")")))
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: _shape(x, kind.elementType)), ",")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    if isinstance(kind, T.MapType):
        inner = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.to_json(F.struct(e["key"])), F.lit(":"), _shape(e["value"], kind.valueType))), ",")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    return F.when(c.isNull(), "-").otherwise("+")


def _plain_keys(kind: T.DataType) -> bool:
    """Whether all keys of maps in a type are of types whose equal values have equal JSON."""
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, MAP_KEYS) and "collate" not in kind.keyType.simpleString() and _plain_keys(kind.valueType)
    if isinstance(kind, T.ArrayType):
        return _plain_keys(kind.elementType)
    return not isinstance(kind, T.StructType) or all(_plain_keys(f.dataType) for f in kind.fields)


def _elements(x: Column, y: Column, same: Callable[[Column, Column], Column]) -> Column:
    return F.forall(F.zip_with(x, y, same), lambda each: each)


def _both(x: Column, y: Column, same: Column) -> Column:
    return (x.isNull() & y.isNull()) | F.coalesce(same, F.lit(False))


def _same_shape(x: Column, y: Column, kind: T.DataType) -> Column:
    """Whether _shape() of two values of one type is equal, without making the texts. A key's JSON is only made where keys differ."""
    if isinstance(kind, T.StructType):
        out = x.isNotNull() & y.isNotNull()
        for f in kind.fields:
            out = out & _same_shape(x.getField(f.name), y.getField(f.name), f.dataType)
        return _both(x, y, out)
    if isinstance(kind, T.ArrayType):
        return _both(x, y, (F.size(x) == F.size(y)) & _elements(x, y, lambda a, b: _same_shape(a, b, kind.elementType)))
    if isinstance(kind, T.MapType):
        told = lambda a, b: a.eqNullSafe(b) | (F.to_json(F.struct(a.alias("key"))) == F.to_json(F.struct(b.alias("key"))))
        values = _elements(F.map_values(x), F.map_values(y), lambda a, b: _same_shape(a, b, kind.valueType))
        return _both(x, y, (F.size(x) == F.size(y)) & _elements(F.map_keys(x), F.map_keys(y), told) & values)
    return x.isNull() == y.isNull()


def _same(x: Column, y: Column, kind: T.DataType, alike: bool = True) -> Column:
    """Equality of two values, at any depth: floats by sign and with one NaN, maps entry by entry in order. Floats of types that are not alike differ by their text too."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return same_float(x, y) if alike else same_float(x, y) & x.cast("string").eqNullSafe(y.cast("string"))
    if isinstance(kind, T.StructType):
        out = x.isNotNull() & y.isNotNull()
        for f in kind.fields:
            out = out & _same(x.getField(f.name), y.getField(f.name), f.dataType, alike)
        return _both(x, y, out)
    if isinstance(kind, T.ArrayType):
        return _both(x, y, (F.size(x) == F.size(y)) & _elements(x, y, lambda a, b: _same(a, b, kind.elementType, alike)))
    if isinstance(kind, T.MapType):
        keys = _elements(F.map_keys(x), F.map_keys(y), lambda a, b: _same(a, b, kind.keyType, alike))
        values = _elements(F.map_values(x), F.map_values(y), lambda a, b: _same(a, b, kind.valueType, alike))
        return _both(x, y, (F.size(x) == F.size(y)) & keys & values)
    if isinstance(kind, T.VariantType):
        return F.to_json(x).eqNullSafe(F.to_json(y))
    return x.eqNullSafe(y)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compare_values(expected: DataFrame, actual: DataFrame, key: str | None = None) -> DataFrame:
    """(dimension, path, key) of every column of every row that differs, missing rows too.

    Rows are aligned by a unique key, or without one by their number (see numbered), which is then the column `row`; of a key that is
    repeated the occurrences are numbered by a hash of their values and aligned one by one, so that one that differs may tell of
    two. One full outer join on what rows are aligned by, which both sides
    share as their partitioning."""
    if key is None:
        key, expected, actual = "row", numbered(expected), numbered(actual)
    columns = [f for f in expected.schema.fields if f.name != key]
    repeated = any(df.groupBy(_column(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() for df in (expected, actual))

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(_column(key).alias("__key"), F.struct(*[_column(f.name).alias(f"c{i}") for i, f in enumerate(columns)]).alias(name))
        at = F.row_number().over(W.partitionBy("__key").orderBy(F.hash(F.to_json(name)), F.to_json(name))) if repeated else F.lit(1)
        return rows.withColumn("__at", at)

    both = _joined(side(expected, "__x"), side(actual, "__y"))
    found = [F.when(F.col("__x").isNull() | F.col("__y").isNull(), F.struct(F.lit(DIMENSIONS[1]).alias("dimension"), F.lit("").alias("path")))]
    present = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    for i, (f, other) in enumerate(zip(columns, [f.dataType for f in both.schema["__y"].dataType.fields], strict=True)):
        a, b = F.col(f"__x.c{i}"), F.col(f"__y.c{i}")
        alike = f.dataType.simpleString() == other.simpleString()
        same = _same(a, b, f.dataType, alike)
        if alike and _plain_keys(f.dataType):  # then values that are the same have one shape, which most rows never look at
            shapes = _same_shape(a, b, f.dataType)
        else:
            shapes = _shape(a, f.dataType) == _shape(b, f.dataType)
            same = shapes & same
        found.append(F.when(present & ~same, F.struct(F.when(shapes, DIMENSIONS[1]).otherwise(DIMENSIONS[2]).alias("dimension"), F.lit(f.name).alias("path"))))
    return both.select("__key", F.inline(F.array_compact(F.array(*found)))).select("dimension", "path", F.col("__key").alias(key))


def _joined(x: DataFrame, y: DataFrame) -> DataFrame:
    """Null keys are aligned with each other."""
    y = y.select(F.col("__key").alias("__other"), F.col("__at").alias("__other_at"), "__y")
    both = x.join(y, x["__key"].eqNullSafe(y["__other"]) & (x["__at"] == y["__other_at"]), "full_outer")
    return both.select(F.coalesce("__key", "__other").alias("__key"), "__x", "__y")


def numbered(df: DataFrame) -> DataFrame:
    """df with its rows' numbers from 0 over all partitions, as the column `row`, in the order in which a scan gives them.

    A row's number is its place in its partition after the rows of those before. What meets in one task and is sent to all is a row for
    each partition, never more than the scheduler itself holds for them."""
    marked = df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__part"), F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return marked.join(F.broadcast(before), "__part").withColumn("row", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def compare(expected: DataFrame, actual: DataFrame, key: str | None = None) -> list[tuple[str, str, str]]:
    """(dimension, path, detail) over all dimensions, values as counts of rows; a differing number of rows ends the comparison of values."""
    out = [(DIMENSIONS[0], path, what) for path, what in schema_differences(expected.schema, actual.schema)]
    ours, theirs = ({f.name: f.metadata or {} for f in df.schema.fields} for df in (expected, actual))
    out += [(DIMENSIONS[3], name, "metadata differ") for name in ours if name in theirs and ours[name] != theirs[name]]
    if any(d == DIMENSIONS[0] for d, _, _ in out):
        return out
    n, m = expected.count(), actual.count()
    if n != m:
        return [*out, (DIMENSIONS[1], "", f"{n} rows became {m}")]
    found = compare_values(expected, actual, key).groupBy("dimension", "path").count().orderBy("dimension", "path").collect()
    return out + [(r["dimension"], r["path"], f"{r['count']} rows") for r in found]
