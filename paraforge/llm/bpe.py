"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 3)."""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_budget, byte_texts, column, whole

#: Pieces that a worker keeps with their ids; beyond it all go and are replayed when met again. It saves work, it decides nothing.
KEPT_PIECES = 700_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes many pieces of text at once by replaying the merges in rank order over all of them.

    Every piece becomes a chain of positions in one long list, one for each byte. An index holds, for each merge that
    some adjacent pair of tokens allows, the positions of those pairs. Merges are applied in rank order; each one
    touches the positions in its index entry only, and enters the new pairs with the two neighbours there."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.texts = [str(i) for i in range(size)]
        self.shift = size.bit_length()
        #: Every pair of tokens that makes a token, as left << shift | right, with that token's rank.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.bytes_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        for x in range(256):
            for y in range(256):
                self.byte_pairs[x, y] = ranks.get(bytes([x, y]), -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        ranks = self.ranks
        out: list[list[int]] = [[ranks[p]] if p in ranks else [] for p in pieces]
        #: Chains of the pieces that are not tokens themselves, with a stop (token -1) after each.
        chains = [n for n, p in enumerate(pieces) if p and not out[n]]
        if not chains:
            return out
        raw = np.frombuffer(b"\0".join([pieces[n] for n in chains]) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(pieces[n]) + 1 for n in chains])
        tokens = self.bytes_rank[raw]
        tokens[ends - 1] = -1
        first = self.byte_pairs[raw[:-1], raw[1:]]
        first[ends[:-1] - 1] = -1
        first[ends - 2] = -1
        places_of = np.flatnonzero(first >= 0)
        order = np.argsort(first[places_of], kind="stable")
        places_of, found = places_of[order], first[places_of[order]]
        cuts = np.flatnonzero(np.diff(found)) + 1
        index: dict[int, list[int]] = {}
        for start, group in zip(np.concatenate([[0], cuts]).tolist(), np.split(places_of, cuts), strict=True):
            if len(group):
                index[int(found[start])] = group.tolist()
        token: list[int] = tokens.tolist()
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        self._replay(index, token, after, before, ends)
        at = 0
        for n, end in zip(chains, ends.tolist(), strict=True):
            ids = out[n]
            while at < end - 1:
                ids.append(token[at])
                at = after[at]
            at = end
        return out

    def _replay(self, index: dict[int, list[int]], token: list[int], after: list[int], before: list[int], ends: np.ndarray) -> None:
        """Applies the merges to the chains. after and before are the neighbours' places; a merged-away place has token -2."""
        get, shift = self.pairs.get, self.shift
        queue = sorted(index)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            waiting = -1  # the stop of a piece in which an earlier merge has just become possible
            later: list[int] = []
            for at in places:
                left_token = token[at]
                if left_token < 0:
                    continue
                right = after[at]
                right_token = token[right]
                if right_token < 0 or get(left_token << shift | right_token) != rank:
                    continue  # a neighbour has changed since
                if at < waiting:
                    later.append(at)
                    continue
                token[at], token[right] = rank, -2
                far = after[right]
                after[at] = far
                before[far] = at
                far_token = token[far]
                if far_token >= 0:
                    new = get(rank << shift | far_token)
                    if new is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(queue, new)
                        if new < rank:
                            waiting = int(ends[np.searchsorted(ends, at, "right")])
                near = before[at]
                if near >= 0:
                    near_token = token[near]
                    if near_token >= 0:
                        new = get(near_token << shift | rank)
                        if new is not None:
                            if new in index:
                                index[new].append(near)
                            else:
                                index[new] = [near]
                                heappush(queue, new)
                            if new < rank:
                                waiting = int(ends[np.searchsorted(ends, at, "right")])
            if later:
                if rank in index:
                    index[rank] += later
                else:
                    index[rank] = later
                heappush(queue, rank)


class Coder:
    """Texts to ids and back. Pieces met before in this worker are looked up; new ones of a batch are replayed together."""

    _made: dict[str, Coder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.replay = MergeReplay(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str, name: str) -> Coder:
        """One coder for a worker process and vocabulary."""
        if name not in cls._made:
            cls._made.clear()
            cls._made[name] = cls(ranks, pattern)
        return cls._made[name]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        known = self.known
        out: list[list[bytes] | None] = []
        gaps: list[tuple[int, list[str]]] = []
        new: dict[str, None] = {}
        for n, text in enumerate(texts):
            pieces = self.split(text)
            found = list(map(known.get, pieces))
            if None in found:
                lost = [p for p, x in zip(pieces, found, strict=True) if x is None]
                new.update(dict.fromkeys(lost))
                gaps.append((n, lost))
            out.append(found)
        for piece, ids in zip(new, self.replay.encode([p.encode() for p in new]), strict=True):
            known[piece] = array("I", ids).tobytes()
        for n, lost in gaps:
            fill = iter(lost)
            out[n] = [known[next(fill)] if x is None else x for x in out[n]]
        return [np.frombuffer(b"".join(found), dtype="<u4") for found in out]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.replay.tokens
        return b"".join([tokens[i] for i in ids])


def _shared(spark, path: str | None, pattern: str | None):
    """The ranks, read on the driver and sent to the workers: their number is the vocabulary's, whatever the corpus."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(read_ranks(path)), pattern, f"{path}:{pattern}"


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with a column of token ids, array<int>. A null text is encoded as the empty one, which has no ids."""
    ranks, pattern, name = _shared(docs.sparkSession, path, pattern)
    names = docs.columns
    position = names.index(text)

    def run(batches):
        coder = Coder.of(ranks.value, pattern, name)
        for batch in byte_budget(batches, position):
            found = coder.encode([t.decode() for t in byte_texts(batch.column(position))])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found)], [*batch.schema.names, ids])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType())))


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the text that a column of token ids stands for, as binary (ids may cut a character). Null ids give null."""
    ranks, pattern, name = _shared(rows.sparkSession, path, None)
    position = rows.columns.index(ids)

    def run(batches):
        coder = Coder.of(ranks.value, pattern, name)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, text])

    from pyspark.sql.types import BinaryType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(text, BinaryType()))


#: Segments of the corpus's pieces: at least so many, or more so that one has about so many bytes of text.
SEGMENTS, SEGMENT_BYTES, MOST_SEGMENTS = 256, 8 << 20, 1 << 20
#: Ids that are handed on at a time, and go to Spark in a batch of their own, unless one text has more.
IDS = 1 << 18
#: Bytes of text that share a dictionary of pieces, and of those that are cut into pieces at a time.
BATCH, CHUNK = 12 << 20, 2 << 20


def segments_for(docs: DataFrame) -> int:
    """The number of segments, a power of two, from Spark's own estimate of the rows' bytes: no pass over the texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(SEGMENTS, min(MOST_SEGMENTS, 1 << (size // SEGMENT_BYTES).bit_length())) if size < 1 << 52 else SEGMENTS


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed with their bytes apart: the low ones of all first. Small ones have mostly zeros in the others."""
    import zstandard

    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = zstandard.decompress(data)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4")[:, 0] if planes else np.zeros(0, np.uint32)


#: What a batch of texts becomes. kind 0, a text: data (the codes of its pieces). kind 1, some of its dictionary: n (the
#: segment), data (the pieces joined), more (their lengths), codes (how much each one's code is above that of the one before).
_ROW = "batch long, kind int, n int, data binary, more binary, codes binary"


def replayed_ids(docs: DataFrame, text: str, key: str, path: str | None, pattern: str | None, use, schema) -> DataFrame:
    """use(keys, ids of each text as little-endian unsigned 32-bit integers) for batches of texts, whose results have the schema.

    Texts are cut into pieces once. Each batch's distinct pieces go to the segments that their hashes name; a segment's task has the
    pieces of the whole corpus there, replays the merges over all of them at once, so that each distinct piece of the corpus is
    replayed once, and sends their ids back to the batches, where the texts wait as codes. Batches and segments have bounded bytes,
    so neither a common piece nor a frequent text or source meets in one task. Nothing is written twice: both consumers read one shuffle."""
    ranks, pattern, name = _shared(docs.sparkSession, path, pattern)
    segments = segments_for(docs)
    rows = docs.select(column(key).alias("key"), whole(column(text)).alias("__text"))
    names = ["batch", "kind", "n", "data", "more", "codes", "key"]

    def cut(batches):
        import regex
        import xxhash
        import zstandard
        from pyspark import TaskContext

        split, at = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        for batch in byte_budget(batches, 1, BATCH):
            counts, parts = [], []
            for part in byte_budget([batch], 1, CHUNK):
                own = [split(t.decode()) for t in byte_texts(part.column(1))]
                counts.append(list(map(len, own)))
                parts.append(pa.array([p for x in own for p in x], pa.string()).dictionary_encode())
                del own
            coded = pa.chunked_array(parts).unify_dictionaries().chunks
            parts.clear()
            pieces = [p.encode() for p in coded[0].dictionary.to_pylist()]
            often = np.zeros(len(pieces), np.int64)
            for part in coded:
                often += np.bincount(part.indices.to_numpy(), minlength=len(pieces))
            rank = np.empty(len(pieces), np.int32)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(pieces), dtype=np.int32)
            texts: list[bytes] = []
            for part, own in zip(coded, counts, strict=True):
                codes, ends = rank[part.indices.to_numpy()], np.cumsum(own).tolist()
                texts += [packed(codes[a:b]) for a, b in zip([0, *ends], ends)]
            del coded
            n = len(texts)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(texts, pa.binary()), none, none, batch.column(0)], names)
            segment = (np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)) % np.uint64(segments)).astype(np.int64)
            order = np.lexsort((rank, segment))
            edges = np.flatnonzero(np.diff(segment[order], prepend=-1)).tolist()
            out: list[list] = [[], [], [], []]
            for a, b in zip(edges, [*edges[1:], len(order)]):
                these = order[a:b].tolist()
                own = [pieces[i] for i in these]
                for x, y in zip(out, (int(segment[these[0]]), zstandard.compress(b"".join(own), 3), packed(np.fromiter(map(len, own), np.int64, len(own))), packed(np.diff(rank[these], prepend=0))), strict=True):
                    x.append(y)
            n = len(edges)
            yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.array([1] * n, pa.int32()), pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]], pa.nulls(n, batch.schema.field(0).type)], names)
            at += 1

    def dictionaries(batches):
        for batch in batches:
            yield batch.filter(pc.equal(batch.column(1), 1)).select(["batch", "n", "data", "more"])

    def replay(batches):
        import zstandard

        engine = Coder.of(ranks.value, pattern, name).replay

        def done(segment, held):
            index: dict[bytes, int] = {}
            places = []
            for _, data, more in held:
                data, ends = zstandard.decompress(data), np.cumsum(unpacked(more)).tolist()
                places.append([index.setdefault(data[a:b], len(index)) for a, b in zip([0, *ends], ends)])
            found = engine.encode(list(index))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = [packed(np.fromiter((i for p in own for i in found[p]), np.int64)) for own in places]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([segment] * len(held), pa.int32()), pa.array(ids, pa.binary()), pa.array([packed(sizes[own]) for own in places], pa.binary())], ["batch", "n", "ids", "sizes"])

        current, held = None, []
        for batch in batches:
            for at, segment, data, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and segment != current:
                    yield done(current, held)
                    held = []
                current = segment
                held.append((at, data, more))
        if held:
            yield done(current, held)

    def assembled(rows, found):
        is_text = pc.equal(rows.column("kind"), 0)
        here, own = rows.filter(is_text), rows.filter(pc.invert(is_text)).sort_by("n")
        found = found.sort_by("n")
        if own.column("n").to_pylist() != found.column("n").to_pylist():
            raise ValueError("the ids of some pieces of a batch did not come back")
        joined = lambda table, name, each=lambda x: x: np.concatenate([np.zeros(0, np.int64), *[each(unpacked(x).astype(np.int64)) for x in table.column(name).to_pylist()]])
        codes, sizes = joined(own, "codes", np.cumsum), joined(found, "sizes")
        table = joined(found, "ids").astype("<u4")
        size_of, start_of = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        size_of[codes], start_of[codes] = sizes, np.cumsum(sizes) - sizes
        ids, made, total, begin = [], [], 0, 0
        for n, data in enumerate(here.column("data")):
            own_codes = unpacked(data.as_py())
            size = size_of[own_codes]
            ends = np.cumsum(size)
            if ids and total + int(size.sum()) > IDS:
                made.append(use(here.column("key").slice(begin, len(ids)), ids))
                ids, total, begin = [], 0, n
            ids.append(table[np.arange(int(size.sum())) + np.repeat(start_of[own_codes] - (ends - size), size)])
            total += len(ids[-1])
        return pa.concat_tables([*made, use(here.column("key").slice(begin), ids)])

    from pyspark.sql.types import StructType

    dealt = rows.mapInArrow(cut, StructType([*StructType.fromDDL(_ROW).fields, rows.schema["key"]])).repartition("batch")
    ids = dealt.mapInArrow(dictionaries, "batch long, n int, data binary, more binary").repartition("n").sortWithinPartitions("n").mapInArrow(replay, "batch long, n int, ids binary, sizes binary")
    return dealt.groupBy("batch").cogroup(ids.groupBy("batch")).applyInArrow(assembled, schema)


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_ids: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """For each row: key, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256, of the ids that the
    corpus-level replay gives the text and of what they decode to; with keep_ids also the ids, array<int>.

    A null or empty text has no tokens and the digests of the empty string; a null key stays null; repeated rows and ties each get a row; an
    empty table gives an empty one; other columns are not looked at."""
    ranks, pattern, name = _shared(docs.sparkSession, path, pattern)

    def use(keys, encoded):
        coder = Coder.of(ranks.value, pattern, name)
        digits = coder.replay.texts
        n, first, second = [], [], []
        for found in encoded:
            ids = found.tolist()
            n.append(len(ids))
            first.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
            second.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        columns = [keys, pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), *[_lists(encoded)] * keep_ids]
        return pa.table(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    schema = StructType([StructField(key, docs.schema[key].dataType)]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    if keep_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    return replayed_ids(docs, text, key, path, pattern, use, schema)
