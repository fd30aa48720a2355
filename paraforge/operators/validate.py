"""Rules over columns, evaluated in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidValueError
from ..functions import conversions as C
from ..types import MAP_KEYS, SIZE, TIME_UNIT, WIDTH


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks. A rule is a column that is true where the row keeps it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, by one aggregation without a shuffle of rows."""
    sums = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
    return sums.select(F.inline(pairs))


def enforced(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df that fails its job on the first row that breaks a rule, before anything is committed.

    The rules are one column over the finished values: as plain filters the optimizer would put them below the projection that makes
    the values, and make each value again for each of its rules."""
    if not rules:
        return df
    kept = F.spark_partition_id() >= 0  # always true; not being deterministic, it holds the filter where it is
    for name, ok in rules.items():
        kept = kept & F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"rule {name} is broken")).cast("boolean"))
    mark = "__kept" + "_" * max((len(c) for c in df.columns), default=0)  # longer than any name of df
    return df.withColumn(mark, kept).where(mark).drop(mark)


def check(df: DataFrame, key: str, rules: dict[str, Column]) -> None:
    first = violations(df, key, rules).limit(1).collect()
    if first:
        raise InvalidValueError(f"row {first[0][0]}: {first[0]['rule']}")


Rule = Callable[[Column], Column]


def keys_ok(kind: T.DataType) -> Rule | None:
    """Whether the keys of all maps in a value are distinct, not null and of a type of the contract; None for a type without maps."""
    if isinstance(kind, T.MapType):
        inner = keys_ok(kind.valueType)
        typed = isinstance(kind.keyType, MAP_KEYS)

        def ok(c: Column) -> Column:
            own = C.map_ok(c) if typed else c.isNull() | (F.size(c) == 0)
            return own if inner is None else own & F.forall(F.map_values(c), lambda v: F.coalesce(inner(v), F.lit(True)))

        return ok
    if isinstance(kind, T.ArrayType):
        inner = keys_ok(kind.elementType)
        return None if inner is None else lambda c: F.forall(c, lambda x: F.coalesce(inner(x), F.lit(True)))
    if isinstance(kind, T.StructType):
        parts = [(f.name, rule) for f in kind.fields if (rule := keys_ok(f.dataType)) is not None]
        if not parts:
            return None

        def all_ok(c: Column) -> Column:
            out = F.lit(True)
            for name, rule in parts:
                out = out & F.coalesce(rule(c.getField(name)), F.lit(True))
            return out

        return all_ok
    return None


def contract_rules(schema: T.StructType) -> dict[str, Column]:
    """The rules of the contract for data of a schema, by path: strings are UTF-8; binaries, lists and times of day have the width, size and range
    that the field's metadata say; a required value is missing only where what holds it is; maps have distinct keys of a type of the contract."""
    out: dict[str, Column] = {}
    for f in schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        for path, rule in _value_rules(f.dataType, f.nullable, f.metadata or {}, f.name):
            out[path] = rule(c)
    return out


class _Utf8:
    """The rule that all strings in a value are UTF-8. They are judged once, joined, because each call inside of a lambda is slow: a comma
    neither ends nor begins a character of several bytes."""

    def __init__(self, joined: Rule = lambda c: c):
        self.joined = joined

    def __call__(self, c: Column) -> Column:
        return C.utf8_ok(self.joined(c))

    def of(self, part: Rule) -> _Utf8:
        return _Utf8(lambda c: self.joined(part(c)))

    def each(self, element: T.DataType) -> _Utf8:
        return _Utf8(lambda c: F.array_join(c if isinstance(element, T.StringType) else F.transform(c, self.joined), ","))


def _each(rule: Rule, element: T.DataType) -> Rule:
    """A rule of elements as one of their array."""
    return rule.each(element) if isinstance(rule, _Utf8) else lambda c: c.isNull() | F.forall(c, lambda x: F.coalesce(rule(x), F.lit(False)))


def _of(rule: Rule, part: Rule) -> Rule:
    """A rule of a part as one of the value that has it."""
    return rule.of(part) if isinstance(rule, _Utf8) else lambda c: c.isNull() | F.coalesce(rule(part(c)), F.lit(False))


def _value_rules(kind: T.DataType, nullable: bool, metadata: dict, path: str) -> list[tuple[str, Rule]]:
    out: list[tuple[str, Rule]] = []
    if not nullable:
        out.append((f"{path} is required", lambda c: c.isNotNull()))
    if isinstance(kind, T.StringType):
        out.append((f"{path} is UTF-8", _Utf8()))
    if isinstance(kind, T.BinaryType) and WIDTH in metadata:
        out.append((f"{path} has {metadata[WIDTH]} bytes", lambda c: C.fixed_binary_ok(c, metadata[WIDTH])))
    if isinstance(kind, T.IntegerType | T.LongType) and TIME_UNIT in metadata:
        out.append((f"{path} is a time of day in {metadata[TIME_UNIT]}", lambda c: C.time_ok(c, metadata[TIME_UNIT])))
    if isinstance(kind, T.NullType):
        out.append((f"{path} has no values", lambda c: c.isNull()))
    if isinstance(kind, T.ArrayType):
        if SIZE in metadata:
            out.append((f"{path} has {metadata[SIZE]} elements", lambda c: C.fixed_list_ok(c, metadata[SIZE])))
        for name, rule in _value_rules(kind.elementType, kind.containsNull, {}, f"{path}.element"):
            out.append((name, _each(rule, kind.elementType)))
    if isinstance(kind, T.MapType):
        typed = isinstance(kind.keyType, MAP_KEYS)
        out.append((f"{path} has distinct keys", (lambda c: C.map_ok(c)) if typed else (lambda c: c.isNull() | (F.size(c) == 0))))
        # null keys are told by the rule above
        for part, own, may in (("key", kind.keyType, True), ("value", kind.valueType, kind.valueContainsNull)):
            for name, rule in _value_rules(own, may, {}, f"{path}.{part}"):
                out.append((name, _of(_each(rule, own), F.map_keys if part == "key" else F.map_values)))
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            for name, rule in _value_rules(f.dataType, f.nullable, f.metadata or {}, f"{path}.{f.name}"):
                out.append((name, _of(rule, lambda c, field=f.name: c.getField(field))))
    return out
