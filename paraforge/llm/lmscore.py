"""Scores of a language model whose counts are in a log-frequency Bloom filter (operator 8)."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_budget, byte_texts, whole

FOLDS, HELD_OUT = 7, 2
#: The end of a text, counted as a token; no word can have a separator in it.
END = b"\n"
#: Counts are held as levels: each count up to EXACT has its own, beyond it there are OCTAVE levels for each doubling. A word or
#: pair enters the filter once for each level up to its own.
EXACT, OCTAVE = 8, 4
#: The least count of each level, from level 0 (none) on.
LEAST = np.array([*range(EXACT + 1), *[math.ceil(EXACT * 2 ** (i / OCTAVE)) for i in range(1, 45 * OCTAVE)]], dtype=np.int64)
#: A segment of the filter has the keys of some values of their top bits: 4,096 segments, or more so that one has about so
#: many bytes of text at most. It is sized by the (key, level) entries it gets: with 16 bits and 4 hashes an entry, at most 22 %
#: of its bits are set, whatever the corpus, so a level that is missing is taken for there once in 400 probes.
SEGMENTS, SEGMENT_BYTES, BITS_PER_ENTRY, LEAST_BITS = 4096, 8 << 20, 16, 1024
#: Bytes of text whose keys are looked up together.
UNIT_BYTES = 8 << 20
HASHES = 4
#: Weight of the pair's share against the word's own probability.
LAMBDA = 0.6
#: Words whose exact counts are sent to every worker for the base score: at most this number, 48 MB.
HEAD_WORDS = 1 << 21


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def second_hash(words: list[bytes]) -> np.ndarray:
    """64 bits more of a word, for the exact counts."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second))


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right") - 1


def segments_for(size: int) -> int:
    """The number of segments, a power of two, for so many bytes of text."""
    return max(SEGMENTS, 1 << max(0, size // SEGMENT_BYTES).bit_length())


def positions(keys: np.ndarray, at_level: np.ndarray | int, bits: int) -> np.ndarray:
    """The bits (HASHES x keys) of a key at a level, in a segment of so many bits."""
    with np.errstate(over="ignore"):
        h = mix(keys ^ (np.asarray(at_level, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        step = mix(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return np.stack([((h + np.uint64(i) * step) >> np.uint64(20)) % np.uint64(bits) for i in range(HASHES)])


def segment_mask(keys: np.ndarray, counts: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The bytes of a segment that holds the keys with their counts, sized by its entries unless bits are given."""
    top = level(counts)
    bits = -(-(bits or max(LEAST_BITS, BITS_PER_ENTRY * int(top.sum()))) // 8) * 8
    mask = np.zeros(bits // 8, dtype=np.uint8)
    for at_level in range(1, int(top.max(initial=0)) + 1):
        at = positions(keys[top >= at_level], at_level, bits).ravel()
        np.bitwise_or.at(mask, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return mask


def probe(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key of a segment, 0 if it is not there: levels are probed upwards until one is missing."""
    out = np.zeros(len(keys), dtype=np.int64)
    live, at_level = np.arange(len(keys)), 1
    while len(live):
        at = positions(keys[live], at_level, len(mask) * 8)
        there = ((mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).all(axis=0)
        live = live[there]
        out[live] = at_level
        at_level += 1
        if at_level == len(LEAST):
            break
    return out


def log10_share(pair: np.ndarray, left: np.ndarray, right: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of p(w | h) = LAMBDA * c(h, w) / c(h) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1), from the levels of the pair, h and w.

    A pair and w have the least count of their level and h has the largest of its own, so that for each h the probabilities of all words,
    with one word for all that training has not, sum up to 1 at most, but for the filter's false levels. Where the filter has no h, the second part has all the weight."""
    own = np.minimum((LEAST[right] + 1) / (total + distinct + 1), 1.0)
    share = np.minimum(LEAST[pair] / np.maximum(LEAST[np.minimum(left + 1, len(LEAST) - 1)] - 1, 1), 1.0)
    return np.log10(np.where(left > 0, LAMBDA * share + (1 - LAMBDA) * own, own))


def is_held_out(doc_id) -> bool:
    """By the CRC-32 of the decimal doc_id; a null one is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Indices of all tokens of all texts, each text ended, the texts' ends, and the distinct tokens."""
    seen: dict[bytes, int] = {}
    flat: list[int] = []
    ends = []
    for raw in raws:
        words = raw.lower().split()
        words.append(END)
        for w in set(words).difference(seen):
            seen[w] = len(seen)
        flat += map(seen.__getitem__, words)
        ends.append(len(flat))
    return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64), list(seen)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over the training texts, with partial counts for each batch."""

    def run(batches):
        for batch in byte_budget(batches, 1, 16 << 20):
            raws = [t for i, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True) if not is_held_out(i)]
            flat, _, words = _tokens(raws)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(flat, minlength=len(words)).astype(np.int64))], ["word", "n"])

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Unit:
    """The tokens of some texts and their keys: those of the words and of the pairs, each text begun with an end token."""

    def __init__(self, raws: list[bytes]):
        self.flat, self.ends, words = _tokens(raws)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.words, self.second = word_hash(words), second_hash(words)
        self.hashes = self.words[self.flat]
        before = np.concatenate([self.hashes[-1:], self.hashes[:-1]])
        before[self.starts] = word_hash([END])[0]
        self.first = np.concatenate([self.flat[-1:], self.flat[:-1]])
        #: Every text ends with END, so END is among the words.
        self.first[self.starts] = words.index(END)
        self.pairs, self.pair_at = np.unique(pair_key(before, self.hashes), return_inverse=True)
        both = np.concatenate([mix(self.words), self.pairs])
        self.order = np.argsort(both, kind="stable")
        self.keys = both[self.order]

    def counts(self, training: np.ndarray) -> np.ndarray:
        """For each key its count in the texts that are in training."""
        weight = np.repeat(training, np.diff(self.ends, prepend=0)).astype(np.float64)
        words = np.bincount(self.flat, weight, len(self.words))
        return np.concatenate([words, np.bincount(self.pair_at, weight, len(self.pairs))]).astype(np.int64)[self.order]

    def levels(self, of_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The levels of the words and of the pairs, from those of the keys."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = of_keys
        return out[: len(self.words)], out[len(self.words) :]


#: Bytes of a key after the bits that name its segment, so 52 bits of it or more are told apart.
KEY_BYTES = 5
#: A count from this on stands in a list of its own.
LARGE = 255


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array with one element for the values (or rows of bytes) between each edge and the next."""
    size = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def pack_keys(units: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(unit, segment, keys, counts, large): the sorted keys of a unit that lie in a segment, KEY_BYTES each, with their training
    counts, a byte each, of which those from LARGE on follow in `large`."""
    top = segments.bit_length() - 1

    def run(key, table):
        unit = Unit(byte_texts(table.column("__text")))
        counts = unit.counts(np.array([not is_held_out(i) for i in table.column("doc_id").to_pylist()]))
        segment = (unit.keys >> np.uint64(64 - top)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        edges = np.append(starts, len(segment))
        short = ((unit.keys << np.uint64(top)) >> np.uint64(64 - 8 * KEY_BYTES)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        large = counts >= LARGE
        return pa.table(
            {
                "unit": pa.array(np.full(len(starts), key[0].as_py())), "segment": segment[starts], "keys": _packed(short, edges),
                "counts": _packed(np.minimum(counts, LARGE).astype(np.uint8), edges), "large": _packed(counts[large], np.concatenate([[0], np.cumsum(large)])[edges]),
            }
        )

    return units.groupBy("unit").applyInArrow(run, "unit long, segment int, keys binary, counts binary, large binary")


def look_up(packed: DataFrame, bits: int | None = None) -> DataFrame:
    """(unit, segment, levels): for each row of pack_keys() the levels of its keys, a byte each.

    A task holds one segment at a time: the keys of all units there are summed, entered and probed."""

    def found(segment, rows):
        short = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(-1, KEY_BYTES)
        keys = np.zeros((len(short), 8), np.uint8)
        keys[:, :KEY_BYTES] = short
        distinct, at = np.unique(keys.view(np.uint64)[:, 0], return_inverse=True)
        counts = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).astype(np.int64)
        counts[counts == LARGE] = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.int64)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, at, counts)
        own = sums > 0
        with np.errstate(over="ignore"):
            names = mix(distinct + np.uint64(segment) * np.uint64(0x9E3779B97F4A7C15))
        mask = segment_mask(names[own], sums[own], bits)
        levels = probe(mask, names).astype(np.uint8)[at]
        edges = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), segment, dtype=np.int32)), _packed(levels, edges)], ["unit", "segment", "levels"])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for unit, segment, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and segment != current:
                    yield found(current, held)
                    held = []
                current = segment
                held.append((unit, *rest))
        if held:
            yield found(current, held)

    return packed.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "unit long, segment int, levels binary")


def score(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id", bits: int | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows that are not held out. base_score is exact: the counts of the commonest words, at most
    head_words, go to every worker; the remaining words of each text are joined with the table of counts.
    Words stand under 128-bit hashes for that. score comes from the filter alone. It is in no place as a whole: texts are
    dealt into units by hash, the distinct keys of a unit go to the segments they lie in, and their levels come back to
    the unit. bits, if given, fixes the bits of the whole filter instead.

    A null or empty text is the end token alone. A null doc_id is in training. Without training rows all counts are 0.
    Repeated rows each get a row and each count; an empty table gives an empty one."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole(F.col(text)).alias("__text"))
    words = ws.save(count_words(rows), "words")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = facts["total"], facts["distinct"]
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    units = rows.withColumn("unit", F.pmod(F.xxhash64("doc_id", "__text"), F.lit(size // UNIT_BYTES + 1)))
    segments = segments_for(size)
    levels = look_up(pack_keys(units, segments), None if bits is None else bits // segments)
    #: How many words have at least 2**j occurrences decides from which count on words belong to the head.
    sizes = words.groupBy(F.floor(F.log2("n")).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("j")).collect()
    cut, held = 1 << 62, 0
    for row in sizes:
        held += row["m"]
        if held > head_words:
            break
        cut = 1 << row["j"]

    def hashed(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(word_hash(found).view(np.int64)), pa.array(second_hash(found).view(np.int64)), batch.column(1)], ["hash", "second", "n"])

    counts = words.mapInArrow(hashed, "hash long, second long, n long")
    head = counts.where(F.col("n") >= cut).toArrow()
    names = head.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(names)
    alone = len(np.unique(names)) == len(names)
    context = ws.spark.sparkContext
    shared = context.broadcast((names[order], head.column("second").to_numpy().view(np.uint64)[order], head.column("n").to_numpy()[order]))

    def scored(texts, found):
        names, seconds, numbers = shared.value
        unit = Unit(byte_texts(texts.column("__text")))
        found = found.sort_by("segment")
        of_keys = np.frombuffer(b"".join(found.column("levels").to_pylist()), dtype=np.uint8)
        if len(of_keys) != len(unit.keys):
            raise ValueError(f"{len(of_keys)} levels came back for {len(unit.keys)} keys")
        single, pair = unit.levels(of_keys)
        logs = log10_share(pair[unit.pair_at], single[unit.first], single[unit.flat], total, distinct)
        at = np.minimum(np.searchsorted(names, unit.words), max(len(names) - 1, 0))
        in_head = (names[at] == unit.words) & (seconds[at] == unit.second) if len(names) else np.zeros(len(unit.words), bool)
        known = np.where(in_head, numbers[at], 0) if len(names) else np.zeros(len(unit.words), np.int64)
        base = np.log10((known + 1) / (total + 1 * (distinct + 1)))
        inside = in_head[unit.flat]
        tails, sums, scores, seen = [], [], [], []
        for a, b in zip(unit.starts.tolist(), unit.ends.tolist(), strict=True):
            own = inside[a:b]
            sums.append(math.fsum(base[unit.flat[a:b]][own]))
            seen.append(int(own.sum()))
            scores.append(math.fsum(logs[a:b]))
            rest, n = np.unique(unit.flat[a:b][~own], return_counts=True)
            tails.append([{"hash": h, "second": i, "m": m} for h, i, m in zip(unit.words[rest].view(np.int64).tolist(), unit.second[rest].view(np.int64).tolist(), n.tolist())])
        ids = texts.column("doc_id")
        return pa.table(
            {
                "doc_id": ids, "held_out": pa.array([is_held_out(i) for i in ids.to_pylist()]), "n_tokens": pa.array(unit.ends - unit.starts), "seen": pa.array(seen, pa.int64()),
                "sum": pa.array(sums), "score": pa.array(scores), "tail": pa.array(tails, pa.list_(pa.struct([("hash", pa.int64()), ("second", pa.int64()), ("m", pa.int64())]))),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, seen long, sum double, score double, tail array<struct<hash:long,second:long,m:long>>"
    out = units.groupBy("unit").cogroup(levels.groupBy("unit")).applyInArrow(scored, schema)
    if cut <= 1 and alone:  # every word is in the head: what is left has a count of 0
        unseen = math.log10(1 / (total + distinct + 1))
        rest = F.col("n_tokens") - F.col("seen")
        return out.select("doc_id", "held_out", "n_tokens", F.col("seen").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sum") + rest * F.lit(unseen)).alias("base_score"), "score")
    out = ws.save(out.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = out.select("row", F.explode("tail").alias("t")).select("row", "t.hash", "t.second", "t.m")
    rare = tail.join(counts, ["hash", "second"], "left")
    term = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    added = rare.groupBy("row").agg(F.sum(F.col("m") * term).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(F.lit(0))).alias("more_seen"))
    done = out.join(added, "row", "left")
    return done.select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more_seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
