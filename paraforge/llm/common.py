"""What the operators of this subpackage share: text expressions, work tables, size-checked joins, bounded Bloom filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The separators of words: 0x20 and 0x09 to 0x0D, as a Java regular expression.
SEPARATORS = "[ \\t-\\r]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"

#: Most rows and bytes of a side that is broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: maximal runs without separators."""
    return F.filter(F.split(whole(text), SEPARATORS), lambda w: w != "")


def source_key(source: Column) -> Column:
    """A key for a source that keeps null apart from every string and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def free_names(taken: list[str], made: list[str]) -> dict[str, str]:
    """A name for each made column: its own, or one with `made_` in front where the rows have a column of that name already."""
    lower, out = {c.lower() for c in taken}, {}
    for name in made:
        out[name] = name
        while out[name].lower() in lower:
            out[name] = f"made_{out[name]}"
    return out


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only, the same in Spark and in DuckDB: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


class Workspace:
    """Work tables in the folder that the cluster names in spark.checkpoint.dir, which all executors share.

    Where that is unset, a local master, as in tests, gets a folder of this process; any other is refused, because its executors
    could not see such a folder. Writing a table cuts the lineage and survives a lost executor. What a query has not dropped
    itself goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = Path(tempfile.mkdtemp(prefix="paraforge-")).as_uri()
        self.root = f"{base.rstrip('/')}/paraforge-{name}-{uuid.uuid4().hex[:12]}"
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        fs.deleteOnExit(root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(table))
        return self.load(table, df.schema)

    def load(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: those of strings and binaries, of other nested values as JSON, and eight for any other."""
    total = F.lit(0)
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + F.lit(8)
    return total


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows may be broadcast. Counts no further than one row beyond the limit."""
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= max_rows and seen["bytes"] <= max_bytes


def sized_join(left: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is broadcast only if its rows and bytes are counted to be few; else both sides are shuffled.

    small must be cheap to count (a work table or a driver-built frame)."""
    return left.join(F.broadcast(small) if is_small(small, max_rows, max_bytes) else small, on, how)


# --- order within a key without one task for the key -------------------------------------------------------------


def accept_within(items: DataFrame, quotas: DataFrame, key: str, rank: str, tie: list[str], amount: str, quota: str, ws: Workspace, name: str, fit: float = 1.0) -> DataFrame:
    """items with a boolean `accepted`: in each key, in the order of (rank, tie), those of which the share `fit` ends
    within the quota.

    items must be a work table; rank is a number spread about evenly over (0, 1). Each key is dealt into about
    sqrt(its rows) slices of rank; prefix sums run over the slices, and only the one slice where the quota falls is
    ordered row by row. So no task holds more than about sqrt(n) rows of a key, however large the key is."""
    stats = ws.save(items.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(quotas.select(key, quota), key), f"{name}_stats")
    sliced = sized_join(items, stats, key).withColumn("__slice", F.floor(F.col(rank) * F.ceil(F.sqrt("__n"))).cast("long"))
    sums = sliced.groupBy(key, "__slice").agg(F.sum(amount).alias("__sum"), F.first(quota).alias("__quota"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = (
        sums.withColumn("__before", before)
        .where((F.col("__before") < F.col("__quota")) & (F.col("__before") + F.col("__sum") >= F.col("__quota")))
        .groupBy(key)
        .agg(F.min(F.struct("__slice", "__before")).alias("__edge"))
        .select(key, F.col("__edge.__slice").alias("__edge_slice"), F.col("__edge.__before").alias("__edge_before"))
    )
    marked = sized_join(sliced, ws.save(edges, f"{name}_edges"), key, "left")
    in_edge = F.coalesce(F.col("__slice") == F.col("__edge_slice"), F.lit(False))
    order = W.partitionBy(key, "__slice").orderBy(rank, *tie)
    start = F.col("__edge_before") + F.coalesce(F.sum(amount).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = marked.where(in_edge).withColumn("accepted", (start < F.col(quota)) & (start + F.col(amount) * F.lit(fit) <= F.col(quota)))
    #: Without an edge the quota lies beyond the key's sum, or is not above zero.
    whole_slices = F.when(F.col("__edge_slice").isNotNull(), F.col("__slice") < F.col("__edge_slice")).otherwise(F.col(quota) > 0)
    rest = marked.where(~in_edge).withColumn("accepted", whole_slices)
    return rest.unionByName(at).drop("__n", "__slice", "__edge_slice", "__edge_before", quota)


def cut_within(items: DataFrame, quotas: DataFrame, key: str, rank: str, tie: list[str], amount: str, quota: str, ws: Workspace, name: str) -> DataFrame:
    """(key, edge, start, m): for each key the place in the order of (rank, tie) where the sum of amounts reaches the quota.

    edge is a struct of rank and tie; the amounts before it sum up to start, and m equal items stand there. A key whose sum stays
    below its quota has no row. As in accept_within a key is dealt into about sqrt(its rows) slices of rank, of which
    one is ordered; equal items are counted before they get there, so a third of all rows may be one item."""
    stats = ws.save(items.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(quotas.select(key, quota), key), f"{name}_stats")
    sliced = sized_join(items, stats, key).withColumn("__slice", F.floor(F.col(rank) * F.ceil(F.sqrt("__n"))).cast("long"))
    sums = sliced.groupBy(key, "__slice").agg(F.sum(amount).alias("__sum"), F.first(quota).alias("__quota"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("__before", before).where((F.col("__before") < F.col("__quota")) & (F.col("__before") + F.col("__sum") >= F.col("__quota")))
    edges = ws.save(edges.groupBy(key).agg(F.min(F.struct("__slice", "__before")).alias("__edge")).select(key, "__edge.*"), f"{name}_edges")
    inside = sized_join(sliced, edges, [key, "__slice"]).groupBy(key, rank, *tie, amount, quota, "__before").agg(F.count(F.lit(1)).alias("m"))
    own = F.col(amount) * F.col("m")
    start = F.col("__before") + F.coalesce(F.sum(own).over(W.partitionBy(key).orderBy(rank, *tie).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = inside.withColumn("start", start).where(F.col("start") + own >= F.col(quota))
    return ws.save(reached.groupBy(key).agg(F.min(F.struct(F.struct(rank, *tie).alias("edge"), "start", "m")).alias("__cut")).select(key, "__cut.*"), f"{name}_cut")


def numbered(rows: DataFrame, key: str, rank: str, tie: list[str], number: str, ws: Workspace, name: str) -> DataFrame:
    """rows with a gapless number from 0 within each key, in the order of (rank, tie).

    rows must be a work table; rank is spread evenly over (0, 1). As in accept_within, a key is dealt into about
    sqrt(its rows) slices, counted, and ordered slice by slice."""
    sizes = ws.save(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), f"{name}_sizes")
    sliced = sized_join(rows, sizes, key).withColumn("__slice", F.floor(F.col(rank) * F.ceil(F.sqrt("__n"))).cast("long")).drop("__n")
    before = F.coalesce(F.sum("__c").over(W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ws.save(sliced.groupBy(key, "__slice").agg(F.count(F.lit(1)).alias("__c")).select(key, "__slice", before.alias("__start")), f"{name}_starts")
    inside = F.row_number().over(W.partitionBy(key, "__slice").orderBy(rank, *tie)) - 1
    return sized_join(sliced.withColumn("__inside", inside), starts, [key, "__slice"]).withColumn(number, F.col("__start") + F.col("__inside")).drop("__slice", "__inside", "__start")


# --- Bloom filters of a fixed size -------------------------------------------------------------------------------


#: Bits of a segment of a filter. A key's top bits name its segment, in which all its positions lie.
SEGMENT_BITS = 1 << 15


def bloom_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Three bit positions (3 x keys) for each 64-bit key, all in one segment; bits is a power of two."""
    inside = min(bits, SEGMENT_BITS)
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        segment = (x >> np.uint64(40)) & np.uint64(bits // inside - 1)
        y = (x ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xC2B2AE3D27D4EB4F)
        y ^= y >> np.uint64(29)
        return np.stack([segment * np.uint64(inside) + ((y >> np.uint64(16 * i)) & np.uint64(inside - 1)) for i in range(3)])


def bloom_build(keys: DataFrame, column: str, bits: int) -> bytes:
    """A Bloom filter of the column's 64-bit keys as bits / 8 bytes, whatever their number.

    It has no false negatives, so what it lets through is never too little; with more keys it only lets through more. Keys are
    dealt by their segment, a task fills the segments it gets one after the other, and each comes to the driver once. So what is
    sent is the keys once and the filter once, however many tasks there are."""
    inside = min(bits, SEGMENT_BITS)

    def dealt(batches):
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            at = bloom_positions(np.unique(found), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at[0] // np.uint64(inside)).astype(np.int32)), *[pa.array((x % np.uint64(inside)).astype(np.int32)) for x in at]], ["segment", "a", "b", "c"])

    def filled(batches):
        current, mask = None, None
        for batch in batches:
            segments = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(segments)) + 1, [len(segments)]])
            at = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if begin == end:
                    continue
                if segments[begin] != current:
                    if current is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([mask.tobytes()], pa.binary())], ["segment", "mask"])
                    current, mask = int(segments[begin]), np.zeros(inside // 8, dtype=np.uint8)
                own = at[:, begin:end].ravel()
                np.bitwise_or.at(mask, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([mask.tobytes()], pa.binary())], ["segment", "mask"])

    parts = keys.select(F.col(column).cast("long").alias("k")).where("k IS NOT NULL").mapInArrow(dealt, "segment int, a int, b int, c int")
    out = np.zeros(bits // 8, dtype=np.uint8).reshape(-1, inside // 8)
    for row in parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(filled, "segment int, mask binary").collect():
        out[row[0]] = np.frombuffer(row[1], dtype=np.uint8)
    return out.tobytes()


def bloom_test(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for each key that may be in the filter."""
    at = bloom_positions(keys, len(mask) * 8)
    got = (mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
    return got.all(axis=0)


# --- texts in Python workers -------------------------------------------------------------------------------------


def byte_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def byte_budget(batches: Iterator, column: int, most: int = 4 << 20) -> Iterator:
    """The record batches cut so that each holds about `most` bytes of a column, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)
