"""Bounded batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_batch_number(df: DataFrame, rows: int) -> DataFrame:
    """df of files with batch numbers of `rows` rows each, counted over row groups within a file."""
    return df.withColumn("batch", F.floor(F.col("_metadata.row_index") / rows).cast("long"))


def _payload(column: pa.Array) -> np.ndarray:
    """Bytes of strings and binaries in each row, nested ones included."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    if pa.types.is_struct(kind):
        total = np.zeros(len(column), np.int64)
        for part in column.flatten():
            total += _payload(part)
        return total
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        offsets = column.offsets.to_numpy()
        inner = [column.values] if pa.types.is_list(kind) else [column.keys, column.items]
        sums = np.zeros(offsets[-1] - offsets[0] + 1, np.int64)
        for part in inner:
            sums[1:] += np.cumsum(_payload(part.slice(offsets[0], offsets[-1] - offsets[0])))
        at = offsets - offsets[0]
        out = sums[at[1:]] - sums[at[:-1]]
        return np.where(np.asarray(column.is_null()), 0, out)
    return np.zeros(len(column), np.int64)


def payload_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of strings and binaries in each row of a batch."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        sizes += _payload(column)
    return sizes


def bounded_batches(df: DataFrame, rows: int, most_bytes: int, key: str, by: str | None = None) -> DataFrame:
    """(partition, batch, key, bytes): the batch of each row when a batch ends after the row that reaches either limit.

    A row larger than the byte limit is a batch of its own or ends one; it is never split. Limits hold in a partition, or with `by`,
    by which the partitions' rows must be sorted, in each run of its values, which then stand in the place of the partition. Arrow
    batches stream by and only counters are kept. The payload is counted, not buffers."""
    names = df.columns
    at, group = names.index(key), None if by is None else names.index(by)
    name = by or "partition"
    kind = "int" if by is None else df.schema[by].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, 0, 0
        last = None
        for batch in batches:
            sizes = payload_bytes(batch)
            own = [part] * batch.num_rows if group is None else batch.column(group).to_pylist()
            numbers = []
            for g, n in zip(own, sizes.tolist(), strict=True):
                if g != last:
                    last, number, held, size = g, 0, 0, 0
                numbers.append(number)
                held, size = held + 1, size + n
                if held >= rows or size >= most_bytes:
                    number, held, size = number + 1, 0, 0
            first = pa.array(own, pa.int32()) if group is None else batch.column(group)
            yield pa.RecordBatch.from_arrays([first, pa.array(numbers, pa.int64()), batch.column(at), pa.array(sizes)], [name, "batch", key, "bytes"])

    return df.mapInArrow(run, f"{name} {kind}, batch long, {key} {df.schema[key].dataType.simpleString()}, bytes long")
