"""Reading Parquet files under the contract."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_STORED_KEYS, OUTSIDE_ANNOTATION, ParquetContractError, ReadEngineUnavailableError, ReaderPoisonedError, translate
from ..functions.conversions import int_ok, time_ok
from ..operators.batches import payload_bytes
from ..operators.validate import keys_ok
from ..plans.projection import project
from .footer import part_files, preflight, read_footer, spark_schema

#: The engines that can be named; only the first is there.
ENGINES = ("PARQUET_JAVA", "HARDWOOD")


@dataclass(frozen=True)
class ReadOptions:
    batch_rows: int = 8192
    max_variable_bytes: int = 64 << 20
    verify_page_checksums: bool = True
    engine: str = "PARQUET_JAVA"

    def __post_init__(self):
        if self.batch_rows <= 0 or self.max_variable_bytes <= 0:
            raise ValueError("batch limits must be above zero")
        if self.engine not in ENGINES:
            raise ValueError(f"no engine named {self.engine}")


def read(spark: SparkSession, path: str, projection=None, options: ReadOptions = ReadOptions(), schema: T.StructType | None = None) -> DataFrame:
    """The table at a path: footers are checked first, page checksums while reading, and columns are pruned to the projection.

    Stored integers and times of day that their annotation can't hold, and stored maps with null, repeated or unsupported keys, fail the
    job that meets them; Spark would cut and carry them silently. Tables without such columns are scanned as they are. Times of day
    and nanoseconds, for which Spark infers no type, are integers with their unit as metadata. schema overrides what would be
    inferred; it is read as given, without these checks.
    Uncompressed version 2 pages with delta strings, which the vectorized reader misreads, are read by the row reader."""
    if options.engine != ENGINES[0]:
        raise ReadEngineUnavailableError(f"{options.engine} is not available")
    try:
        found = preflight(spark, path)
        load = _row_reader if found.delta_strings else _reader
        flag = {"parquet.page.verify-checksum.enabled": str(options.verify_page_checksums).lower()}
        told = spark_schema(read_footer(spark, part_files(spark, path)[0])) if found.told and schema is None else schema
        df = load(spark, path, flag, told)
        if schema is None:
            own = {p: how for p, how in found.checks.items() if p.split(".", 1)[0] in df.columns}
            if own:
                wide = T.StructType([T.StructField(f.name, widened(f.dataType, own, f.name), f.nullable, f.metadata) for f in df.schema.fields])
                df = narrowed(load(spark, path, flag, wide), df.schema, own)
        df = project(df, projection)
        return df if schema is not None else maps_checked(df)
    except Exception as error:
        raise translate(error) from error


def _reader(spark: SparkSession, path: str, flags: dict[str, str], schema: T.StructType | None) -> DataFrame:
    reader = spark.read.options(**flags)
    return (reader if schema is None else reader.schema(schema)).parquet(path)


def _row_reader(spark: SparkSession, path: str, flags: dict[str, str], schema: T.StructType | None) -> DataFrame:
    """The table as a relation of a copy of the session whose vectorized reader is off; the session itself stays as it is."""
    if spark.conf.get("spark.sql.parquet.enableVectorizedReader") != "true":
        return _reader(spark, path, flags, schema)
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    plan = _reader(copy, path, flags, schema)._jdf.queryExecution().analyzed()
    _activate(spark)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _activate(spark: SparkSession) -> None:
    SparkSession._instantiatedSession = spark
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)


def widened(kind: T.DataType, narrow: dict[str, tuple], path: str) -> T.DataType:
    """The type with every narrow integer as the stored one, in which nothing is cut."""
    if path in narrow:
        return kind if narrow[path][0] == "time" else T.IntegerType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, widened(f.dataType, narrow, f"{path}.{f.name}"), f.nullable, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(widened(kind.elementType, narrow, f"{path}.list.element"), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(widened(kind.keyType, narrow, f"{path}.key_value.key"), widened(kind.valueType, narrow, f"{path}.key_value.value"), kind.valueContainsNull)
    return kind


def narrowed(df: DataFrame, schema: T.StructType, narrow: dict[str, tuple]) -> DataFrame:
    """df, read with widened integers, with the schema's types; a value that its annotation can't hold fails the job."""
    out = []
    for f in schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        out.append(_narrow(c, f.dataType, narrow, f.name).alias(f.name, metadata=f.metadata or {}))
    return df.select(*out)


def _touches(narrow, path: str) -> bool:
    return any(p == path or p.startswith(f"{path}.") for p in narrow)


def _narrow(c: Column, kind: T.DataType, narrow: dict[str, tuple], path: str) -> Column:
    if not _touches(narrow, path):
        return c
    if path in narrow:
        first, second = narrow[path]
        bad = F.raise_error(F.concat(F.lit(f"{OUTSIDE_ANNOTATION} {path} has "), c.cast("string")))
        return F.when(time_ok(c, second) if first == "time" else int_ok(c, first, second), c).otherwise(bad).cast(kind)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_narrow(c.getField(f.name), f.dataType, narrow, f"{path}.{f.name}").alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _narrow(x, kind.elementType, narrow, f"{path}.list.element"))
    if isinstance(kind, T.MapType):
        at = f"{path}.key_value"
        entry = lambda e: F.struct(_narrow(e["key"], kind.keyType, narrow, f"{at}.key").alias("key"), _narrow(e["value"], kind.valueType, narrow, f"{at}.value").alias("value"))
        return F.when(c.isNotNull(), F.map_from_entries(F.transform(F.map_entries(c), entry)))
    return c


def maps_checked(df: DataFrame) -> DataFrame:
    """df whose maps, at any depth, fail the job if a stored one has null, repeated or unsupported keys. Other columns are untouched."""
    out, any_maps = [], False
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        ok = keys_ok(f.dataType)
        if ok is not None:
            any_maps = True
            c = F.when(F.coalesce(ok(c), F.lit(True)), c).otherwise(F.raise_error(F.lit(f"{BAD_STORED_KEYS} {f.name}")))
        out.append(c.alias(f.name, metadata=f.metadata or {}))
    return df.select(*out) if any_maps else df


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's requiredness and field metadata, which files do not keep; a null where none may be fails the job."""
    return df.to(schema)


def refine(df: DataFrame, hints: dict[str, dict]) -> DataFrame:
    """df with advisory metadata by column. Hints for unknown columns, and what the file says itself, outweigh nothing."""
    for field in df.schema.fields:
        if field.name in hints:
            df = df.withMetadata(field.name, {**hints[field.name], **(field.metadata or {})})
    return df


def observed(df: DataFrame, name: str = "read") -> tuple[DataFrame, Observation]:
    """df with a count of rows that is filled by whatever action runs over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class Reader:
    """Batches on the driver, one partition at a time. After a failure every use raises ReaderPoisonedError with the first one."""

    def __init__(self, df: DataFrame, options: ReadOptions = ReadOptions()):
        self.schema = df.schema
        self._rows = df
        self._options = options
        self._batches: Iterator[pa.RecordBatch] | None = None
        self._failure: BaseException | None = None
        self.batch: pa.RecordBatch | None = None
        self.rows = self.batches = 0

    def load_next(self) -> bool:
        """Moves to the next batch; False at the end, again and again. The batch before is given up."""
        if self._failure is not None:
            raise ReaderPoisonedError("the reader has failed before") from self._failure
        self.batch = None
        try:
            if self._batches is None:
                self._batches = self._iterate()
            self.batch = next(self._batches, None)
        except BaseException as error:
            self._failure = translate(error)
            if isinstance(self._failure, ParquetContractError):
                raise self._failure from error
            raise
        if self.batch is None:
            return False
        self.rows += self.batch.num_rows
        self.batches += 1
        return True

    def _iterate(self) -> Iterator[pa.RecordBatch]:
        """Batches that end after the row that reaches either limit, across partitions. Rows come as Arrow batches, one by one."""
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for packed in self._rows.mapInArrow(_serialized, "batch binary").toLocalIterator():
            with pa.ipc.open_stream(packed["batch"]) as stream:
                for batch in stream:
                    begin = 0
                    for i, n in enumerate(payload_bytes(batch).tolist()):
                        rows, size = rows + 1, size + n
                        if rows >= self._options.batch_rows or size >= self._options.max_variable_bytes:
                            yield _one([*held, batch.slice(begin, i + 1 - begin)])
                            held, begin, rows, size = [], i + 1, 0, 0
                    if begin < batch.num_rows:
                        held.append(batch.slice(begin))
        if held:
            yield _one(held)


def _serialized(batches):
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
