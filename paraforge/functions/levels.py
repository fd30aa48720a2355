"""Repetition and definition levels of columns, from values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_levels(df: DataFrame, key: str, column: str) -> DataFrame:
    """The physical events of an optional list of optional elements: (key, row_boundary, rl, dl, present, value).

    A null list has one event at level 0, an empty one at 1, a null element is at 2 and a value at 3. The first event of
    a row repeats at level 0."""
    c = F.col(column)
    events = df.select(key, c.isNull().alias("__null"), (F.size(c) == 0).alias("__empty"), F.posexplode_outer(c).alias("__at", "value"))
    first = F.coalesce(F.col("__at"), F.lit(0)) == 0
    depth = F.when(F.col("__null"), 0).when(F.col("__empty"), 1).when(F.col("value").isNull(), 2).otherwise(3)
    return events.select(key, first.alias("row_boundary"), F.when(first, 0).otherwise(1).alias("rl"), depth.alias("dl"), (depth == 3).alias("present"), "value")


def flat_levels(df: DataFrame, key: str, column: str) -> DataFrame:
    """The events of an optional flat column."""
    c = F.col(column)
    return df.select(key, F.lit(True).alias("row_boundary"), F.lit(0).alias("rl"), c.isNotNull().cast("int").alias("dl"), c.isNotNull().alias("present"), c.alias("value"))


@dataclass(frozen=True)
class Leaf:
    """A leaf of a column: its path, greatest definition and repetition level, and its type."""

    path: str
    most_defined: int
    most_repeated: int
    kind: T.DataType


def leaves(field: T.StructField) -> list[Leaf]:
    """The leaves of an optional column of lists, maps and structs, all of whose parts but a map's keys are optional."""
    out: list[Leaf] = []

    def walk(kind: T.DataType, path: str, defined: int, repeated: int) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", defined + 1, repeated)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}.list.element", defined + 2, repeated + 1)
        elif isinstance(kind, T.MapType):
            out.append(Leaf(f"{path}.key_value.key", defined + 1, repeated + 1, kind.keyType))
            walk(kind.valueType, f"{path}.key_value.value", defined + 2, repeated + 1)
        else:
            out.append(Leaf(path, defined, repeated, kind))

    walk(field.dataType, field.name, 1, 0)
    return out


_EVENT = "struct<rl:int,dl:int,value:string>"


def _events(c: Column, kind: T.DataType, steps: list[str], defined: int, depth: int, required: bool = False) -> Column:
    """An array with the events of a value towards one leaf. The first has repetition level 0 here; the ones that a list or
    map at `depth` adds have its level."""
    event = lambda dl, value=None: F.array(F.struct(F.lit(0).alias("rl"), F.lit(dl).alias("dl"), (value.cast("string") if value is not None else F.lit(None).cast("string")).alias("value")))
    here = defined if required else defined + 1
    if isinstance(kind, T.StructType):
        inner = _events(c.getField(steps[0]), kind[steps[0]].dataType, steps[1:], here, depth)
        return F.when(c.isNull(), event(defined)).otherwise(inner)
    if isinstance(kind, T.ArrayType | T.MapType):
        level = depth + 1
        if isinstance(kind, T.ArrayType):
            items, each = c, lambda x: _events(x, kind.elementType, steps[2:], here + 1, level)
        elif steps[1] == "key":
            items, each = F.map_keys(c), lambda x: _events(x, kind.keyType, steps[2:], here + 1, level, required=True)
        else:
            items, each = F.map_values(c), lambda x: _events(x, kind.valueType, steps[2:], here + 1, level)

        def placed(x: Column, i: Column) -> Column:
            """The events of the i-th item: the first of all but the first item repeats at this level."""
            return F.transform(each(x), lambda e, j: F.struct(F.when((i > 0) & (j == 0), F.lit(level)).otherwise(e["rl"]).alias("rl"), e["dl"].alias("dl"), e["value"].alias("value")))

        return F.when(c.isNull(), event(defined)).when(F.size(c) == 0, event(here)).otherwise(F.flatten(F.transform(items, placed)))
    if required:
        return event(here, c)
    return F.when(c.isNull(), event(defined)).otherwise(event(here, c))


def nested_levels(df: DataFrame, key: str, column: str) -> DataFrame:
    """The physical events of every leaf of an optional column of any shape: (key, leaf, at, row_boundary, rl, dl, present, value).

    value is the leaf's text; at counts the events of a row's leaf from 0. Levels are worked out inside expressions, without a shuffle."""
    field = df.schema[column]
    c = F.col("`" + column.replace("`", "``") + "`")
    parts = []
    for leaf in leaves(field):
        steps = leaf.path[len(field.name) + 1 :].split(".") if "." in leaf.path else []
        events = _events(c, field.dataType, steps, 0, 0)
        parts.append(F.struct(F.lit(leaf.path).alias("leaf"), F.lit(leaf.most_defined).alias("most"), events.cast(f"array<{_EVENT}>").alias("events")))
    rows = df.select(key, F.inline(F.array(*parts))).select(key, "leaf", "most", F.posexplode("events").alias("at", "e"))
    return rows.select(key, "leaf", "at", (F.col("at") == 0).alias("row_boundary"), "e.rl", "e.dl", (F.col("e.dl") == F.col("most")).alias("present"), "e.value")


def is_fault(most: int | Column) -> Column:
    """True for an event that breaks the rules: a row begins exactly at repetition 0, and a value stands exactly at the greatest depth."""
    return (F.col("row_boundary") != (F.col("rl") == 0)) | (F.col("present") != (F.col("dl") == most))


def level_faults(events: DataFrame, most: int | Column) -> DataFrame:
    return events.where(is_fault(most))
