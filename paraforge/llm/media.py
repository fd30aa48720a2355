"""Media columns: payloads cut by content into chunks that are stored once, and read back verified (operator 2)."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkstore as store
from .common import Workspace, byte_budget, byte_texts, whole

PAD, FRAME, RATE = 32, 192, 8000
CUTTING = store.Cutting(least=256, mean=1024, most=8192, width=1)


def payload_of(text: bytes) -> bytes:
    """The text's bytes and as many spaces as make a positive multiple of 192."""
    size = max(FRAME, -(-len(text) // FRAME) * FRAME)
    return text.ljust(size, bytes([PAD]))


def to_wave(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples in a WAVE container."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono samples")
        return f.readframes(f.getnframes())


def features(payload: bytes) -> str:
    """Mean, root mean square, zero crossings a sample and an 8-bin histogram of the samples around 128."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(samples >> 5, minlength=8)
    total = int(samples.sum(dtype=np.int64))
    squares = int((samples.astype(np.int64) ** 2).sum()) - 256 * total + 16384 * len(samples)
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    n = len(samples)
    return f"mean={total / n - 128:.6f};rms={(squares / n) ** 0.5:.6f};zcr={crossings / n:.6f};hist=" + ",".join(map(str, bins.tolist()))


def write_media(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id", cutting: store.Cutting = CUTTING) -> tuple[DataFrame, DataFrame]:
    """Stores each row's text as media; gives the tables of packs (key, doc_id, n_bytes and the recipe) and of chunks.

    A chunk that occurs once stays in its row; one that may occur more often is written once to the table of chunks.
    Which may is decided by a filter of repeated digests of a fixed size, so payloads themselves are not shuffled,
    only the shared ones are. The texts are read three times instead of being staged on disk."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole(F.col(text)).alias("__text"))

    def media(batches):
        for batch in byte_budget(batches, 1):
            texts = byte_texts(batch.column(1))
            yield batch, texts, [to_wave(payload_of(t)) for t in texts]

    def digests(batches):
        for _, _, payloads in media(batches):
            yield store.count_digests(store.chunked(payloads, cutting))

    mask = ws.spark.sparkContext.broadcast(store.repeated_filter(rows.mapInArrow(digests, store.DIGESTS)))

    def packed(batches):
        bits = np.frombuffer(mask.value, dtype=np.uint8)
        for batch, texts, payloads in media(batches):
            recipes, lengths = zip(*map(store.recipe_of, store.chunked(payloads, cutting)), strict=True)
            found = store.pack(payloads, recipes, lengths, bits)
            keys = [hashlib.blake2b(repr(i).encode() + p, digest_size=16).digest() for i, p in zip(batch.column(0).to_pylist(), payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0), pa.array([len(t) for t in texts], pa.int64()), *store.pack_columns(found)], ["key", "doc_id", "n_bytes", *store.PACK_NAMES])

    def shared(batches):
        bits = np.frombuffer(mask.value, dtype=np.uint8)
        for _, _, payloads in media(batches):
            recipes, lengths = zip(*map(store.recipe_of, store.chunked(payloads, cutting)), strict=True)
            yield store.shared_batch(payloads, recipes, lengths, bits)

    return store.save_store(ws, rows.mapInArrow(packed, f"key binary, doc_id long, n_bytes long, {store.PACK}"), rows.mapInArrow(shared, store.SHARED))


def read_media(packs: DataFrame, chunks: DataFrame) -> DataFrame:
    """What the stored media hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Every chunk is checked against its digest and every recipe against its Merkle root."""

    def use(columns, payloads):
        rows = []
        for media in payloads:
            payload = from_wave(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.read_back(packs, chunks, use, schema, ["doc_id", "n_bytes"])


def media_round_trip(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes every text as media and reads all of them back (see write_media and read_media).

    A null text is stored as the empty one, which is 192 spaces. Equal texts have equal values and share all their chunks. Repeated rows
    each get a row; an empty table gives an empty one."""
    return read_media(*write_media(docs, ws, text, key))
