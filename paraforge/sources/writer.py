"""Writing Parquet files under the contract."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodecUnavailableError, InputSchemaMismatchError, InvalidValueError, PathExistsError, UnsupportedTypeError, WriterAbortedError, translate
from ..operators.validate import contract_rules, enforced
from ..types import SIZE, TIME_UNIT, UNIT, WIDTH, schema_differences, stored_columns
from .footer import FileFacts, file_facts

#: The codecs and page versions of the contract.
CODECS = ("UNCOMPRESSED", "ZSTD", "SNAPPY", "GZIP")
PAGE_VERSIONS = {"V1": "PARQUET_1_0", "V2": "PARQUET_2_0"}


@dataclass(frozen=True)
class WriteOptions:
    compression: str = "SNAPPY"
    page_version: str = "V1"
    dictionary: bool = True
    statistics: bool = True
    page_checksums: bool = True
    row_group_bytes: int = 128 << 20
    row_group_rows: int = 1 << 20
    page_bytes: int = 1 << 20
    page_rows: int = 20_000
    dictionary_page_bytes: int = 1 << 20
    without_statistics: tuple[str, ...] = ()
    strict_schema: bool = False

    def __post_init__(self):
        if self.compression not in CODECS:
            raise CodecUnavailableError(f"{self.compression} is not one of {', '.join(CODECS)}")
        if self.page_version not in PAGE_VERSIONS:
            raise ValueError(f"no page version {self.page_version}")
        if min(self.row_group_bytes, self.row_group_rows, self.page_bytes, self.page_rows, self.dictionary_page_bytes) <= 0:
            raise ValueError("sizes must be above zero")

    def spark(self, schema: T.StructType) -> dict[str, str]:
        """The options of Spark's Parquet writer."""
        flag = lambda x: str(x).lower()
        out = {
            "compression": self.compression.lower(),
            "parquet.writer.version": PAGE_VERSIONS[self.page_version],
            "parquet.enable.dictionary": flag(self.dictionary),
            "parquet.column.statistics.enabled": flag(self.statistics),
            "parquet.page.write-checksum.enabled": flag(self.page_checksums),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.block.row.count.limit": str(self.row_group_rows),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary_page_bytes),
        }
        return out | {f"parquet.column.statistics.enabled#{c}": "false" for c in self.without_statistics}


@contextmanager
def contract_settings(spark):
    """Session settings that the contract needs and no option covers, for the time of a write."""
    wanted = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.parquet.writeLegacyFormat": "false", "spark.sql.variant.writeShredding.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def check_input(df: DataFrame, schema: T.StructType, strict: bool) -> None:
    """The data must have the schema: names, types and nesting, and if strict nullability and metadata too."""
    differences = schema_differences(schema, df.schema)
    if differences:
        raise InputSchemaMismatchError("; ".join(f"{path}: {what}" for path, what in differences))
    if strict and (df.schema.jsonValue() != schema.jsonValue()):
        raise InputSchemaMismatchError("nullability or metadata differ")


def write(df: DataFrame | pa.Table | pa.RecordBatchReader, path: str, options: WriteOptions = WriteOptions(), schema: T.StructType | None = None, spark: SparkSession | None = None) -> None:
    """Writes a DataFrame, or Arrow's tables and readers of batches, to a new path.

    What is outside the contract is rejected before anything is written. Values are checked in the job that writes them: by the
    schema's types and metadata, and by the requiredness of `schema` where it is given (see contract_rules). A job that
    meets a value that breaks a rule fails with InvalidValueError and leaves no table."""
    df = as_frame(df, spark)
    stored_columns(df.schema)
    if schema is not None:
        check_input(df, schema, options.strict_schema)
        stored_columns(schema)
    try:
        with contract_settings(df.sparkSession):
            checked = enforced(df, contract_rules(schema if schema is not None else df.schema))
            checked.write.mode("errorifexists").options(**options.spark(df.schema)).parquet(path)
    except Exception as error:
        raise translate(error) from error


def as_frame(data, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame of what Arrow holds. Types that Spark doesn't take go through their contract's counterparts: unsigned integers
    to the next wider type, times of day to integers with their unit, second timestamps to microseconds. Dictionaries are decoded."""
    if isinstance(data, DataFrame):
        return data
    table = data.read_all() if isinstance(data, pa.RecordBatchReader) else pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
    session = spark or SparkSession.active()
    columns, fields = [], []
    for f, column in zip(table.schema, table.columns, strict=True):
        column, kind, metadata = _spark_column(f, column)
        metadata |= {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
        columns.append(column)
        fields.append(T.StructField(f.name, kind, True, metadata))
    if not fields:
        raise UnsupportedTypeError("a table needs at least one column")
    df = session.createDataFrame(pa.Table.from_arrays(columns, names=[f.name for f in fields]), T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))
    return df.select(*[F.col("`" + f.name.replace("`", "``") + "`").alias(f.name, metadata=f.metadata) for f in fields])


def _spark_column(f: pa.Field, column: pa.ChunkedArray) -> tuple[pa.ChunkedArray, T.DataType, dict]:
    from pyspark.sql.pandas.types import from_arrow_type

    kind, metadata = f.type, {}
    if _has_dictionary(kind):
        try:
            column.validate(full=True)
        except pa.ArrowInvalid as error:
            raise InvalidValueError(f"{f.name}: an index is outside its dictionary") from error
        column = pa.chunked_array([_decoded(c) for c in column.chunks], _without_dictionaries(kind))
        kind = column.type
    if pa.types.is_unsigned_integer(kind):
        wide = {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
        column = column.cast(wide)
    elif pa.types.is_time(kind):
        if kind.unit == "s":
            column, kind = column.cast(pa.time32("ms")), pa.time32("ms")
        metadata[TIME_UNIT] = kind.unit
        column = column.cast(pa.int32() if kind.bit_width == 32 else pa.int64())
    elif pa.types.is_timestamp(kind):
        if kind.unit == "ns":
            column, metadata[UNIT] = column.cast(pa.int64()), "ns"
        else:
            column = column.cast(pa.timestamp("us", kind.tz))
            if kind.tz:
                metadata["zone"] = kind.tz
    elif pa.types.is_duration(kind):
        column, metadata[UNIT] = column.cast(pa.int64()), kind.unit
    elif pa.types.is_fixed_size_binary(kind):
        metadata[WIDTH] = kind.byte_width
        column = column.cast(pa.binary())
    elif pa.types.is_fixed_size_list(kind):
        metadata[SIZE] = kind.list_size
        column = column.cast(pa.list_(kind.value_field))
    elif pa.types.is_date64(kind):
        column = column.cast(pa.date32())
    elif pa.types.is_large_string(kind) or str(kind) == "string_view":
        column = column.cast(pa.string())
    elif pa.types.is_large_binary(kind) or str(kind) == "binary_view":
        column = column.cast(pa.binary())
    elif pa.types.is_float16(kind) or pa.types.is_interval(kind) or pa.types.is_union(kind):
        raise UnsupportedTypeError(f"{f.name}: {kind} is outside the contract")
    try:
        return column, from_arrow_type(column.type, prefer_timestamp_ntz=True), metadata
    except Exception as error:
        raise UnsupportedTypeError(f"{f.name}: {kind} is outside the contract") from error


def _has_dictionary(kind: pa.DataType) -> bool:
    return pa.types.is_dictionary(kind) or any(_has_dictionary(kind.field(i).type) for i in range(kind.num_fields))


def _without_dictionaries(kind: pa.DataType) -> pa.DataType:
    t = pa.types
    if t.is_dictionary(kind):
        return _without_dictionaries(kind.value_type)
    if t.is_struct(kind):
        return pa.struct([kind.field(i).with_type(_without_dictionaries(kind.field(i).type)) for i in range(kind.num_fields)])
    if t.is_map(kind):
        return pa.map_(_without_dictionaries(kind.key_type), kind.item_field.with_type(_without_dictionaries(kind.item_type)))
    if t.is_list(kind) or t.is_large_list(kind):
        make = pa.list_ if t.is_list(kind) else pa.large_list
        return make(kind.value_field.with_type(_without_dictionaries(kind.value_type)))
    if t.is_fixed_size_list(kind):
        return pa.list_(kind.value_field.with_type(_without_dictionaries(kind.value_type)), kind.list_size)
    return kind


def _decoded(array: pa.Array) -> pa.Array:
    """An array without dictionaries, at any depth."""
    kind, t = array.type, pa.types
    if not _has_dictionary(kind):
        return array
    if array.offset:
        array = pa.concat_arrays([array])  # a copy that begins at its buffers' beginning
    if t.is_dictionary(kind):
        return _decoded(array.dictionary_decode())
    if t.is_struct(kind):
        parts = [_decoded(x) for x in array.flatten()]
        return pa.StructArray.from_arrays(parts, fields=list(_without_dictionaries(kind)), mask=array.is_null())
    nulls = array.is_null()
    if t.is_fixed_size_list(kind):
        return pa.FixedSizeListArray.from_arrays(_decoded(array.values.slice(array.offset * kind.list_size, len(array) * kind.list_size)), type=_without_dictionaries(kind), mask=nulls)
    if t.is_map(kind):
        made = pa.MapArray.from_arrays(array.offsets, _decoded(array.keys), _decoded(array.items), type=_without_dictionaries(kind))
        return pc.if_else(nulls, pa.scalar(None, made.type), made) if array.null_count else made
    make = pa.ListArray if t.is_list(kind) else pa.LargeListArray
    return make.from_arrays(array.offsets, _decoded(array.values), type=_without_dictionaries(kind), mask=nulls)


def decoded_table(table: pa.Table) -> pa.Table:
    """A table whose dictionaries, at any depth, have become their values."""
    columns = [pa.chunked_array([_decoded(c) for c in column.chunks], _without_dictionaries(column.type)) for column in table.columns]
    return pa.table(columns, names=table.column_names)


class Writer:
    """A table at a path, written batch by batch. Each flush_row_group() closes the row groups of what came before it.

    A batch that is rejected for its schema or type writes nothing and leaves the writer usable. A batch whose values break a rule, or any
    other failure while writing, aborts it: use after that raises WriterAbortedError with the first failure as its cause, and
    nothing is left at the path. finish() makes the table visible, once; it may be called again and tells the same. close() finishes a
    healthy writer and cleans up after a failed one."""

    def __init__(self, path: str, options: WriteOptions = WriteOptions(), schema: T.StructType | None = None, spark: SparkSession | None = None):
        self.path, self.options, self.schema = path, options, schema
        self.spark = spark
        self.batches = 0
        self._pending: list[DataFrame] = []
        self._parts = 0
        self._failure: BaseException | None = None
        self._facts: list[FileFacts] | None = None
        self._closed = False

    @property
    def _staging(self) -> str:
        head, _, name = self.path.rstrip("/").rpartition("/")
        return f"{head}/_{name}.staging" if head else f"_{name}.staging"

    def _usable(self) -> None:
        if self._failure is not None:
            raise WriterAbortedError("the writer has failed before") from self._failure
        if self._closed or self._facts is not None:
            raise OSError("the writer is closed")

    def write_batch(self, data) -> None:
        """Takes a DataFrame or Arrow data of the writer's schema, which is the first batch's unless it was given."""
        self._usable()
        df = as_frame(data, self.spark)
        self.spark = df.sparkSession
        stored_columns(df.schema)
        if self.schema is None:
            if _exists(self.spark, self.path):
                raise PathExistsError(f"{self.path} exists already")
            self.schema = df.schema
        check_input(df, self.schema, self.options.strict_schema)
        self._pending.append(df)
        self.batches += 1

    def flush_row_group(self) -> None:
        """Writes what is pending as row groups of their own; nothing if nothing is pending."""
        self._usable()
        if not self._pending:
            return
        try:
            df = self._pending[0]
            for more in self._pending[1:]:
                df = df.unionByName(more)
            write(df, f"{self._staging}/{self._parts:06d}", self.options, self.schema)
        except BaseException as error:
            self._failure = error
            self._clean()
            raise
        self._pending, self._parts = [], self._parts + 1

    def write_all(self, data) -> list[FileFacts]:
        """Writes DataFrames or Arrow data and finishes."""
        for batch in data if isinstance(data, list | tuple) else [data]:
            self.write_batch(batch)
        return self.finish()

    def finish(self) -> list[FileFacts]:
        """Makes the table visible and tells the facts of its files. Without a batch the schema must have been given."""
        if self._facts is not None:
            return self._facts
        self._usable()
        if not self._pending and not self._parts:
            if self.schema is None:
                raise OSError("nothing was written and no schema was given")
            self.spark = self.spark or SparkSession.active()
            self._pending.append(self.spark.createDataFrame([], self.schema))
        self.flush_row_group()
        try:
            self._publish()
            self._facts = file_facts(self.spark, self.path)
        except BaseException as error:
            self._failure = error
            self._clean()
            raise translate(error) from error
        return self._facts

    def close(self) -> None:
        """Finishes unless the writer has failed or nothing was asked of it; later calls do nothing."""
        if self._closed:
            return
        try:
            if self._failure is None and self._facts is None and (self._pending or self._parts or self.schema is not None):
                self.finish()
        finally:
            self._closed = True
            self._clean()

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is None:
            self.close()
            return
        self._failure = self._failure or error
        self._closed = True
        try:
            self._clean()
        except Exception as more:  # the first failure stays the one that is told
            error.add_note(f"cleaning up failed too: {more}")

    def _publish(self) -> None:
        """Renames the parts' files into the table's folder, in order; the folder appears last."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        target, staging = path(self.path), path(self._staging)
        fs = target.getFileSystem(conf)
        if fs.exists(target):
            raise PathExistsError(f"{self.path} exists already")
        whole = path(f"{self._staging}/whole")
        fs.mkdirs(whole)
        for part in range(self._parts):
            folder = path(f"{self._staging}/{part:06d}")
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if not name.startswith(("_", ".")):
                    fs.rename(status.getPath(), path(f"{self._staging}/whole/part-{part:06d}-{name.removeprefix('part-')}"))
        if not fs.rename(whole, target):
            raise OSError(f"{self.path} could not be made visible")
        fs.delete(staging, True)

    def _clean(self) -> None:
        self._pending = []
        if self.spark is not None:
            staging = self.spark._jvm.org.apache.hadoop.fs.Path(self._staging)
            staging.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(staging, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
