"""Footers: file facts and the checks that come before a scan."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..errors import InvalidFileError, ParquetContractError, UnsupportedNestedEncodingError, UnsupportedTypeError
from ..types import TIME_UNIT, UNIT, WIDTH, Stored, min_decimal_bytes
from .footerbytes import MAX_FOOTER, Footer, Node, footer_length, parse

__all__ = ["MAX_FOOTER", "FileFacts", "Preflight", "file_facts", "part_files", "preflight", "read_footer", "spark_schema", "stored_schema"]

#: Footers that the driver reads at a time, and the number of files from which on executors read them.
FOOTERS_AT_ONCE, FILES_FOR_A_JOB = 8, 64


@dataclass(frozen=True)
class FileFacts:
    path: str
    rows: int
    groups: tuple[int, ...]
    created_by: str
    codecs: tuple[str, ...]
    encodings: tuple[str, ...]
    bytes: int
    with_statistics: int
    columns: int


@dataclass(frozen=True)
class Preflight:
    """What the footers of a table ask of a scan: whether the vectorized reader misreads some pages, what is to be checked by value (the width
    and sign of narrow integers, the unit of times of day) by path, and whether Spark needs to be told the schema, as it infers none for some types."""

    delta_strings: bool
    checks: dict[str, tuple]
    told: bool = False


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path and in its folders, in order of their names. What begins with `_` or `.` is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        top = fs.getFileStatus(root)
        if top.isFile():
            return [top.getPath().toString()]
        base, found, listed = top.getPath().toString(), [], fs.listFiles(root, True)
        while listed.hasNext():
            found.append(listed.next().getPath().toString())
    except Py4JError as error:
        raise InvalidFileError(f"{path}: no such file") from error
    return sorted(f for f in found if not any(p.startswith(("_", ".")) for p in f[len(base) :].strip("/").split("/")))


def read_footer(spark: SparkSession, file: str) -> Footer:
    """By Spark's JVM, and so from any store that Spark reads."""
    jvm = spark._jvm
    try:
        path = jvm.org.apache.hadoop.fs.Path(file)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size = fs.getFileStatus(path).getLen()
        if size < 12:
            footer_length(b"", size, file)
        stream = fs.open(path)
        try:
            read = jvm.org.apache.commons.io.IOUtils.toByteArray
            stream.seek(size - 8)
            length = footer_length(bytes(read(stream, 8)), size, file)
            stream.seek(size - 8 - length)
            return parse(bytes(read(stream, length)), file)
        finally:
            stream.close()
    except Py4JError as error:
        raise InvalidFileError(f"{file}: the footer can't be read") from error


def file_facts(spark: SparkSession, path: str) -> list[FileFacts]:
    """What the footers say of each data file."""
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        return list(pool.map(lambda file: facts_of(file, read_footer(spark, file)), part_files(spark, path)))


def facts_of(file: str, footer: Footer) -> FileFacts:
    chunks = [c for _, own in footer.groups for c in own]
    return FileFacts(
        file, footer.rows, tuple(n for n, _ in footer.groups), footer.created_by, tuple(sorted({c.codec for c in chunks})), tuple(sorted({e for c in chunks for e in c.encodings})),
        sum(c.size for c in chunks), sum(c.statistics for c in chunks), footer.leaves(),
    )


def stored_schema(footer: Footer) -> list[Stored]:
    """Every field of a file as it is stored, by the names that the contract gives to the levels of lists and maps."""
    out: list[Stored] = []

    def add(node: Node, path: str) -> None:
        physical = node.physical or "GROUP"
        if physical == "FIXED_LEN_BYTE_ARRAY":
            physical = f"FIXED({node.length})"
        annotation = f"DECIMAL({node.precision},{node.scale})" if node.annotation == "DECIMAL" else {"MAP_KEY_VALUE": "MAP", "VARIANT": "VARIANT(1)"}.get(node.annotation, node.annotation)
        out.append(Stored(path, physical, annotation, node.repetition != "REQUIRED"))
        if node.annotation == "LIST":
            (middle,) = node.children
            level = not middle.physical and len(middle.children) == 1 and middle.name not in ("array", f"{node.name}_tuple")
            add(middle.children[0] if level else middle, f"{path}.list.element")
        elif node.annotation in ("MAP", "MAP_KEY_VALUE"):
            for side, child in zip(("key", "value"), node.children[0].children, strict=True):
                add(child, f"{path}.key_value.{side}")
        elif node.annotation != "VARIANT":
            for child in node.children:
                add(child, f"{path}.{child.name}")

    for child in footer.schema.children:
        add(child, child.name)
    return out


def preflight(spark: SparkSession, path: str) -> Preflight:
    """Rejects what the contract rejects and Spark would read, or fail on late. Every footer is read.

    A few files are read by the driver. Many are dealt to executors, which send back one verdict for all; those in stores that only
    the JVM can open come back to the driver."""
    files = part_files(spark, path)
    if not files:
        raise InvalidFileError(f"{path}: no data files")
    if len(files) < FILES_FOR_A_JOB:
        return _on_driver(spark, files)
    tasks = max(spark.sparkContext.defaultParallelism, len(files) // 500)
    rows = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks).mapInArrow(_verdicts, "file string, verdict string, kind string, message string")
    seen = rows.groupBy().agg(
        F.min(F.when(F.col("kind") != "", F.struct("file", "kind", "message"))).alias("bad"),
        F.collect_set(F.when(F.col("verdict").isNotNull(), F.col("verdict"))).alias("verdicts"),
        F.collect_list(F.when(F.col("kind").isNull(), F.col("file"))).alias("rest"),
    )
    seen = seen.first()
    if seen["bad"] is not None:
        raise getattr(errors, seen["bad"]["kind"])(seen["bad"]["message"])
    found = [_decoded(v) for v in seen["verdicts"]] + ([_on_driver(spark, seen["rest"])] if seen["rest"] else [])
    return _together(found)


def _on_driver(spark: SparkSession, files: list[str]) -> Preflight:
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        waiting = [pool.submit(lambda f: verdict(read_footer(spark, f)), file) for file in files]
        try:
            return _together([w.result() for w in waiting])
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def _verdicts(batches) -> Iterator:
    """In a worker: the verdict on each file, or the error it calls for, or neither if the file can't be opened here."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        out: list[list] = [[], [], []]
        for file in batch.column(0).to_pylist():
            said, kind, message = None, "", None
            try:
                store, name = fs.FileSystem.from_uri(file)
                size = store.get_file_info(name).size
                with store.open_input_file(name) as f:
                    tail = b"" if size < 12 else (f.seek(size - 8), f.read(8))[1]
                    length = footer_length(tail, size, file)
                    f.seek(size - 8 - length)
                    found = verdict(parse(f.read(length), file))
                said = json.dumps([found.delta_strings, sorted(found.checks.items()), found.told])
            except ParquetContractError as error:
                kind, message = type(error).__name__, str(error)
            except Exception:  # a store that only the JVM can open
                kind = None
            for column, x in zip(out, (said, kind, message), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in out]], ["file", "verdict", "kind", "message"])


def _decoded(text: str) -> Preflight:
    delta, checks, told = json.loads(text)
    return Preflight(delta, {path: tuple(how) for path, how in checks}, told)


def _together(found: list[Preflight]) -> Preflight:
    checks: dict[str, tuple] = {}
    for one in found:
        checks |= one.checks
    return Preflight(any(one.delta_strings for one in found), checks, any(one.told for one in found))


def verdict(footer: Footer) -> Preflight:
    checks: dict[str, tuple] = {}
    for node in footer.schema.children:
        _check(node, node.name, False, checks)
    delta = any(c.codec == "UNCOMPRESSED" and "DELTA_BYTE_ARRAY" in c.encodings for _, own in footer.groups for c in own)
    return Preflight(delta, checks, any(_is_told(node) for node in footer.schema.children))


def _is_told(node: Node) -> bool:
    return node.annotation.startswith(("TIME(", "TIMESTAMP(NANOS")) or any(map(_is_told, node.children))


#: How units are called in files and in metadata.
_UNITS = {"MILLIS": "ms", "MICROS": "us", "NANOS": "ns"}


def spark_schema(footer: Footer) -> T.StructType:
    """The Spark types for a file's schema, with metadata for what they don't tell: times of day and nanoseconds as integers with their unit, widths of binaries."""
    return T.StructType([_spark_field(node) for node in footer.schema.children])


def _spark_field(node: Node) -> T.StructField:
    kind, metadata = _spark_type(node)
    return T.StructField(node.name, kind, True, metadata)


def _spark_type(node: Node) -> tuple[T.DataType, dict]:
    if not node.physical:
        if node.annotation == "LIST":
            (middle,) = node.children
            level = not middle.physical and len(middle.children) == 1 and middle.name not in ("array", f"{node.name}_tuple")
            element = middle.children[0] if level else middle
            return T.ArrayType(_spark_type(element)[0], element.repetition == "OPTIONAL"), {}
        if node.annotation in ("MAP", "MAP_KEY_VALUE"):
            key, value = node.children[0].children
            return T.MapType(_spark_type(key)[0], _spark_type(value)[0], value.repetition == "OPTIONAL"), {}
        if node.annotation == "VARIANT":
            return T.VariantType(), {}
        return T.StructType([_spark_field(child) for child in node.children]), {}
    at = node.annotation
    if at == "DECIMAL":
        return T.DecimalType(node.precision, node.scale), {}
    if at.startswith("TIME("):
        return (T.IntegerType() if node.physical == "INT32" else T.LongType()), {TIME_UNIT: _UNITS[at[5:].split(",")[0]]}
    if at.startswith("TIMESTAMP(NANOS"):
        return T.LongType(), {UNIT: "ns"}
    if at.startswith("TIMESTAMP("):
        return (T.TimestampType() if at.endswith("true)") else T.TimestampNTZType()), {}
    if at == "UNKNOWN" and node.physical == "BOOLEAN":
        return T.NullType(), {}
    if node.physical == "FIXED_LEN_BYTE_ARRAY":
        return T.BinaryType(), {WIDTH: node.length}
    named = {"DATE": T.DateType, "STRING": T.StringType, "INT(8,true)": T.ByteType, "INT(16,true)": T.ShortType, "INT(8,false)": T.ShortType, "INT(16,false)": T.IntegerType, "INT(32,false)": T.LongType}
    plain = {"BOOLEAN": T.BooleanType, "INT32": T.IntegerType, "INT64": T.LongType, "FLOAT": T.FloatType, "DOUBLE": T.DoubleType, "BINARY": T.BinaryType}
    if at == "INT(64,false)":
        return T.DecimalType(20, 0), {}
    return named.get(at, plain[node.physical])(), {}


#: The physical types that an annotation may stand on.
_PAIRS = {
    "STRING": ("BINARY",), "DATE": ("INT32",), "INT(8": ("INT32",), "INT(16": ("INT32",), "INT(32": ("INT32",), "INT(64": ("INT64",), "TIME(MILLIS": ("INT32",), "TIME(MICROS": ("INT64",), "TIME(NANOS": ("INT64",),
    "TIMESTAMP": ("INT64",), "DECIMAL": ("INT32", "INT64", "FIXED_LEN_BYTE_ARRAY"), "UNKNOWN": ("INT32", "BOOLEAN"),
}


def check_pair(node: Node, path: str) -> None:
    """A primitive's physical type, annotation, width and precision must fit each other."""
    if node.physical == "INT96":
        raise UnsupportedTypeError(f"{path}: INT96 is outside the contract")
    if not node.annotation:
        return
    allowed = next((kinds for start, kinds in _PAIRS.items() if node.annotation.startswith(start)), None)
    if allowed is None:
        raise UnsupportedTypeError(f"{path}: {node.annotation} is outside the contract")
    if node.physical not in allowed:
        raise UnsupportedTypeError(f"{path}: {node.annotation} on {node.physical}")
    if node.annotation == "UNKNOWN" and node.repetition != "OPTIONAL":
        raise UnsupportedTypeError(f"{path}: a column of nulls must be optional")
    if node.annotation == "DECIMAL":
        most = {"INT32": 9, "INT64": 18}.get(node.physical)
        fits = node.precision <= most if most else 0 < node.precision and min_decimal_bytes(node.precision) <= node.length
        if not 0 < node.precision or not fits or not 0 <= node.scale <= node.precision:
            raise UnsupportedTypeError(f"{path}: DECIMAL({node.precision},{node.scale}) on {node.physical}({node.length})")


def _check(node: Node, path: str, inside: bool, narrow: dict[str, tuple], key: str = "") -> None:
    """path has the names in the file, key those that the contract gives to the levels of lists and maps."""
    key = key or path
    if node.repetition == "REPEATED" and not inside:
        raise UnsupportedNestedEncodingError(f"UNANNOTATED_REPEATED at {path}")
    if node.physical:
        check_pair(node, path)
        if node.annotation.startswith(("INT(8,", "INT(16,")):
            width, signed = node.annotation[4:-1].split(",")
            narrow[key] = (int(width), signed == "true")
        elif node.annotation.startswith("TIME("):
            narrow[key] = ("time", _UNITS[node.annotation[5:].split(",")[0]])
        return
    if not node.children:
        raise UnsupportedTypeError(f"{path}: a struct needs at least one field")
    if len({c.name for c in node.children}) < len(node.children):
        raise UnsupportedTypeError(f"{path}: two fields have one name")
    if node.annotation == "LIST":
        _check_list(node, path, narrow, key)
    elif node.annotation in ("MAP", "MAP_KEY_VALUE"):
        _check_map(node, path, narrow, key)
    elif node.annotation == "VARIANT":
        _check_variant(node, path)
    elif node.annotation:
        raise UnsupportedTypeError(f"{path}: {node.annotation} is outside the contract")
    else:
        for child in node.children:
            _check(child, f"{path}.{child.name}", False, narrow, f"{key}.{child.name}")


def _check_list(node: Node, path: str, narrow, key: str) -> None:
    if len(node.children) != 1 or node.children[0].repetition != "REPEATED":
        raise UnsupportedNestedEncodingError(f"LIST_SHAPE at {path}")
    middle = node.children[0]
    at, element = f"{path}.{middle.name}", f"{key}.list.element"
    if middle.physical or middle.annotation:
        _check(middle, at, True, narrow, element)
        return
    #: A repeated group of one field is a level of its own, unless its name says that it is the element.
    level = len(middle.children) == 1 and middle.name not in ("array", f"{node.name}_tuple")
    for child in middle.children:
        _check(child, f"{at}.{child.name}", False, narrow, element if level else f"{element}.{child.name}")


def _check_map(node: Node, path: str, narrow, key: str) -> None:
    if len(node.children) != 1 or node.children[0].physical or node.children[0].repetition != "REPEATED":
        raise UnsupportedNestedEncodingError(f"MAP_SHAPE at {path}")
    entry = node.children[0].children
    if len(entry) < 2:
        raise UnsupportedNestedEncodingError(f"KEY_ONLY at {path}")
    if len(entry) > 2:
        raise UnsupportedNestedEncodingError(f"EXTRA_ENTRY_FIELDS at {path}")
    if entry[0].repetition != "REQUIRED":
        raise UnsupportedNestedEncodingError(f"{entry[0].repetition}_KEY at {path}")
    for side, child in zip(("key", "value"), entry, strict=True):
        _check(child, f"{path}.{node.children[0].name}.{child.name}", False, narrow, f"{key}.key_value.{side}")


def _check_variant(node: Node, path: str) -> None:
    """Binary metadata, and a binary value or a typed value of any shape; nothing else."""
    own = {c.name: c for c in node.children}
    metadata, value, typed = own.pop("metadata", None), own.pop("value", None), own.pop("typed_value", None)
    if metadata is None or metadata.physical != "BINARY" or metadata.repetition == "REPEATED":
        raise UnsupportedTypeError(f"{path}: a variant needs binary metadata")
    if value is None and typed is None or value is not None and value.physical != "BINARY":
        raise UnsupportedTypeError(f"{path}: a variant needs a binary value or a typed value")
    if own:
        raise UnsupportedTypeError(f"{path}: {sorted(own)[0]} is no part of a variant")
