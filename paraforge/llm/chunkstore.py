"""A content-addressed store of payloads: rolling-hash cuts, unique chunks stored once, ordered recipes, verified reading.

Used for media payloads (operator 2) and for token ids (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bloom_build, bloom_test

DIGEST = 16
#: Bits of the filter of repeated digests: 4 MB to every worker, whatever the corpus.
FILTER_BITS = 1 << 25


@dataclass(frozen=True)
class Cutting:
    """Units of a chunk: fewest, about the mean beyond the fewest (a power of two), most. width: bytes of a unit."""

    least: int
    mean: int
    most: int
    width: int


def gear(units: np.ndarray) -> np.ndarray:
    """The rolling gear hash at each unit: the sum of g(unit) << age over the last 32 units, modulo 2**32."""
    with np.errstate(over="ignore"):
        h = units.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        for age in (1, 2, 4, 8, 16):
            older = h[:-age] << np.uint32(age)
            h = h.copy()
            h[age:] += older
    return h


def cut(units: np.ndarray, ends: np.ndarray, how: Cutting) -> list[list[int]]:
    """The ends of the chunks of each payload, counted from the payload's start; units holds all payloads, ends their ends.

    A cut comes after a unit whose gear hash has its top bits zero, `least` units after the last cut at the earliest
    (so that no hash reaches over a payload's start) and `most` at the latest. It depends on the payload alone."""
    marks = np.flatnonzero(gear(units) < np.uint32((1 << 32) // how.mean)) + 1
    at = np.searchsorted(marks, ends)
    out, start, first = [], 0, 0
    marks = marks.tolist()
    for end, stop in zip(ends.tolist(), at.tolist(), strict=True):
        cuts, last = [], start
        for mark in marks[first:stop]:
            while mark - last > how.most:
                last += how.most
                cuts.append(last - start)
            if mark - last >= how.least:
                last = mark
                cuts.append(last - start)
        while end - last > how.most:
            last += how.most
            cuts.append(last - start)
        if end > last:
            cuts.append(end - start)
        out.append(cuts)
        start, first = end, stop
    return out


def chunked(payloads: list[bytes], how: Cutting) -> list[list[bytes]]:
    """The chunks of each payload."""
    kind = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}[how.width]
    units = np.frombuffer(b"".join(payloads), dtype=kind)
    ends = np.cumsum([len(p) // how.width for p in payloads])
    out = []
    for payload, cuts in zip(payloads, cut(units, ends, how), strict=True):
        out.append([payload[a * how.width : b * how.width] for a, b in zip([0, *cuts], cuts)])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree over the leaves; a lone node goes up as it is; no leaves have the digest of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleTree:
    """The root of merkle() for leaves that come one by one, from a node for each bit of their number."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size, node = 1, hashlib.sha256(b"\0" + leaf).digest()
        while self.nodes and self.nodes[-1][0] == size:
            node = hashlib.sha256(b"\1" + self.nodes.pop()[1] + node).digest()
            size *= 2
        self.nodes.append((size, node))

    def root(self) -> bytes:
        if not self.nodes:
            return merkle([])
        out = self.nodes[-1][1]
        for _, node in reversed(self.nodes[:-1]):
            out = hashlib.sha256(b"\1" + node + out).digest()
        return out


def repeated_filter(digests: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A filter of the chunks that occur more than once, from (d1, d2, n): the halves of a digest and a partial count."""
    repeated = digests.groupBy("d1", "d2").agg(F.sum("n").alias("n")).where("n > 1")
    return bloom_build(repeated, "d1", bits)


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


DIGESTS = "d1 long, d2 long, n long"


def count_names(recipes: list[bytes]) -> pa.RecordBatch:
    """Partial counts of the digests in a batch of recipes."""
    both = np.frombuffer(b"".join(recipes), dtype=np.dtype("V16"))
    names, n = np.unique(both.view(np.dtype([("d1", "<i8"), ("d2", "<i8")])), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names["d1"].copy()), pa.array(names["d2"].copy()), pa.array(n.astype(np.int64))], ["d1", "d2", "n"])


def count_digests(chunks: list[list[bytes]]) -> pa.RecordBatch:
    return count_names([digest(c) for own in chunks for c in own])


#: What a payload's row holds: digests of all chunks in order, their lengths, which of them are in the shared table
#: and under which halves of their digests, the others' bytes in order, and the Merkle root over the digests.
PACK = "recipe binary, lengths array<int>, shared array<int>, d1 array<long>, d2 array<long>, own binary, root binary"
PACK_KINDS = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
PACK_NAMES = ["recipe", "lengths", "shared", "d1", "d2", "own", "root"]


def pack_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), PACK_KINDS, strict=True)]


def recipe_of(chunks: list[bytes]) -> tuple[bytes, list[int]]:
    return b"".join(map(digest, chunks)), [len(c) for c in chunks]


def _flags(recipes: list[bytes], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The halves of all digests of a batch, whether they may be repeated, and the ends of the recipes."""
    d1, d2 = halves(recipes)
    return d1, d2, bloom_test(mask, d1), np.cumsum([len(r) // DIGEST for r in recipes])


def pack(payloads: list[bytes], recipes: list[bytes], lengths: list[list[int]], mask: np.ndarray) -> list[tuple]:
    d1, d2, flags, ends = _flags(recipes, mask)
    out, begin = [], 0
    for payload, recipe, own, end in zip(payloads, recipes, lengths, ends.tolist(), strict=True):
        shared = np.flatnonzero(flags[begin:end])
        parts, last = [payload], 0
        if len(shared):
            parts, at = [], [0, *accumulate(own)]
            for i in shared.tolist():
                parts.append(payload[last : at[i]])
                last = at[i + 1]
            parts.append(payload[last:])
        names = [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]
        out.append((recipe, own, shared.tolist(), d1[begin:end][shared].tolist(), d2[begin:end][shared].tolist(), b"".join(parts), merkle(names)))
        begin = end
    return out


SHARED = "d1 long, d2 long, chunk binary"


def shared_batch(payloads: list[bytes], recipes: list[bytes], lengths: list[list[int]], mask: np.ndarray) -> pa.RecordBatch:
    """The chunks of a batch that may be repeated, each once."""
    once: dict[bytes, bytes] = {}
    _, _, flags, ends = _flags(recipes, mask)
    begin = 0
    for payload, recipe, own, end in zip(payloads, recipes, lengths, ends.tolist(), strict=True):
        shared = np.flatnonzero(flags[begin:end]).tolist()
        if shared:
            at = [0, *accumulate(own)]
            for i in shared:
                once.setdefault(recipe[i * DIGEST : (i + 1) * DIGEST], payload[at[i] : at[i + 1]])
        begin = end
    d1, d2 = halves(list(once))
    return pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(list(once.values()), pa.binary())], ["d1", "d2", "chunk"])


def unique_chunks(shared: DataFrame) -> DataFrame:
    """Each shared chunk once."""
    return shared.groupBy("d1", "d2").agg(F.first("chunk").alias("chunk"))


def rebuild(row_recipe: bytes, lengths: list[int], shared: list[int], own: bytes, root: bytes, fetched: dict[int, bytes]) -> bytes:
    """The payload of a row. Every chunk's digest and the root are checked; ValueError if the store is damaged."""
    names = [row_recipe[i : i + DIGEST] for i in range(0, len(row_recipe), DIGEST)]
    if merkle(names) != root:
        raise ValueError("the recipe does not have the recorded Merkle root")
    apart, at, parts = set(shared), 0, []
    for i, (name, n) in enumerate(zip(names, lengths, strict=True)):
        if i in apart:
            chunk = fetched.get(i)
        else:
            chunk = own[at : at + n]
            at += n
        if chunk is None or len(chunk) != n or digest(chunk) != name:
            raise ValueError(f"chunk {i} is missing or damaged")
        parts.append(chunk)
    return b"".join(parts)


def with_fetched(packs: DataFrame, chunks: DataFrame, key: str = "key") -> DataFrame:
    """packs with a column `fetched`, array<struct<i int, chunk binary>>: the shared chunks of each row.

    Only rows that have shared chunks take part in the joins. The join by digest has one chunk on the one side, so a chunk in
    a third of all rows is split by Spark's skew handling; what is gathered for a row is as large as the row's payload."""
    apart = packs.where(F.size("shared") > 0)
    wanted = apart.select(key, F.explode(F.arrays_zip("shared", "d1", "d2")).alias("w")).select(key, F.col("w.shared").alias("i"), "w.d1", "w.d2").distinct()
    got = wanted.join(chunks, ["d1", "d2"]).groupBy(key).agg(F.collect_list(F.struct("i", "chunk")).alias("fetched"))
    alone = packs.where(F.size("shared") == 0).withColumn("fetched", F.lit(None).cast("array<struct<i:int,chunk:binary>>"))
    return apart.join(got, key, "left").select(*packs.columns, "fetched").unionByName(alone.select(*packs.columns, "fetched"))


#: Bytes of payloads, and payloads, that are rebuilt at a time; a longer payload is rebuilt alone.
READ_BYTES, READ_ROWS = 4 << 20, 500


def parts_of(lengths: pa.ListArray) -> list[tuple[int, int]]:
    """Where the parts of a batch begin and end, from the lengths of the chunks of its payloads."""
    ends = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(), dtype=np.int64)])
    sizes = np.diff(ends[np.concatenate([[0], np.cumsum(lengths.value_lengths().to_numpy())]).astype(np.int64)]).tolist()
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > READ_BYTES or i - begin == READ_ROWS):
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return [*out, (begin, len(sizes))] if sizes else out


def read_back(packs: DataFrame, chunks: DataFrame, use: Callable, schema, columns: list[str], key: str = "key") -> DataFrame:
    """Rebuilds every payload and maps batches of (columns..., payload) with `use(rows of a batch) -> Arrow arrays`.

    A batch has READ_BYTES of payloads at most, or one payload, however long the payloads are."""
    names = [*columns, "recipe", "lengths", "shared", "own", "root", "fetched"]
    rows = with_fetched(packs, chunks, key).select(*names)

    def run(batches):
        for batch in batches:
            for begin, end in parts_of(batch.column(names.index("lengths"))):
                part = batch.slice(begin, end - begin)
                stored = [part.column(names.index(c)).to_pylist() for c in names[len(columns) :]]
                payloads = []
                for recipe, lengths, shared, own, root, fetched in zip(*stored, strict=True):
                    payloads.append(rebuild(recipe, lengths, shared, own, root, {x["i"]: x["chunk"] for x in fetched or ()}))
                yield use([part.column(i) for i in range(len(columns))], payloads)

    return rows.mapInArrow(run, schema)


def save_store(ws: Workspace, packs: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ws.save(packs, "packs"), ws.save(unique_chunks(shared), "chunks")
