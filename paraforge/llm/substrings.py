"""Removal of repeated byte strings across documents, found with suffix arrays (operator 7)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bloom_build, bloom_test, byte_budget, byte_texts, whole
from .suffixes import suffix_array

#: Length of the strings, of the anchors in them, and anchors in a string.
LENGTH, ANCHOR = 100, 24
SPREAD = LENGTH - ANCHOR + 1
#: Longest symbol but for those that have no boundary inside.
SYMBOL = 32
#: Bits of the filters of repeated anchors (16 MB), of very common anchors (1 MB) and of touched documents (8 MB).
ANCHOR_BITS, HOT_BITS, DOCUMENT_BITS = 1 << 27, 1 << 23, 1 << 26
#: Bytes of an anchor's right and left context; each string has one of the two in full. HALF: largest offset with the right one.
CONTEXT, HALF = 58, LENGTH - 58
#: Texts that are cut up at a time.
BATCH = 3 << 20
#: From this number of occurrences on, an anchor's strings are grouped by their bytes in Spark and not in one task.
HOT = 20_000
#: Bytes of pieces that are put into one suffix array.
BLOCK = 2 << 20
NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def window_hashes(data: np.ndarray, length: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of each window of `length` bytes, from hashes of windows of 1, 2, 4 ... bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        part = _mix(data.astype(np.uint64) + np.uint64(0x51ED27F1))
        power, size, total, done = np.uint64(factor), 1, None, 0
        while True:
            if length & size:
                piece = part[done : done + n]
                total = piece.copy() if total is None else total * power + piece
                done += size
            if size * 2 > length:
                return _mix(total)
            part = part[:-size] * power + part[size:]
            power, size = power * power, size * 2


def _pieces(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """For the texts joined: the bytes and their 24-byte windows' hashes, and for each anchor's run of strings: text, first string, number, anchor.

    A string's anchor is the least of its 24-byte windows by hash, the leftmost of equal ones; equal strings so have equal anchors at
    equal offsets, and strings with one anchor follow each other."""
    lengths = np.array([len(r) for r in raws], dtype=np.int64)
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    ends = np.cumsum(lengths)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none.astype(np.uint64), none, none, none, none
    hashes = window_hashes(data, ANCHOR)
    least = (_mix(hashes + np.uint64(0x632BE5AB)) & ~np.uint64((1 << 32) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= SPREAD:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    count = len(hashes) - SPREAD + 1
    least = np.minimum(least[:count], least[SPREAD - size : SPREAD - size + count])
    anchor = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(raws)), lengths)[:count]
    start = np.arange(count)
    valid = start + LENGTH <= ends[text]
    run = valid & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(run)
    last_valid = ends[text[first]] - LENGTH
    after = np.concatenate([first[1:], [count]])
    number = np.minimum(after, last_valid + 1) - first
    return data, hashes, text[first], first, number, anchor[first]


def context_keys(hashes: np.ndarray, first: np.ndarray, number: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run the hashes of its anchor's right and left context, and which of the two its strings have.

    A string that begins at most HALF bytes before its anchor has all of the CONTEXT bytes from the anchor on; one that begins
    earlier has the CONTEXT bytes from HALF before the anchor on. So equal strings share a context. A context's hash is made
    of the hashes of three anchor-long windows that cover it; `hashes` has those at every byte."""
    last = CONTEXT - ANCHOR

    def at(place: np.ndarray, salt: int) -> np.ndarray:
        if len(hashes) <= last:
            return np.zeros(len(place), np.uint64)
        place = np.clip(place, 0, len(hashes) - 1 - last)
        with np.errstate(over="ignore"):
            x = _mix(hashes[place] + np.uint64(salt))
            x = _mix(x * np.uint64(0xA0761D6478BD642F) + hashes[place + ANCHOR])
            return _mix(x * np.uint64(0xA0761D6478BD642F) + hashes[place + last])

    return at(anchor, 1), at(anchor - HALF, 2), anchor - (first + number - 1) <= HALF, anchor - first > HALF


def _boundaries(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural and all symbol boundaries of pieces that begin at `begin` in data.

    A natural boundary is a word's start of one kind of first two characters; where the last 31 bytes
    have none, every byte is a boundary. Both depend on a few bytes around, so equal strings have equal ones."""
    n = len(data)
    solid = data > 32
    natural = np.zeros(n, dtype=bool)
    natural[1 : n - 1] = solid[1 : n - 1] & ~solid[: n - 2] & (((data[1 : n - 1].astype(np.int64) * 31 + data[2:]) & 1) == 0)
    natural[begin] = False
    natural[begin[1:] - 1] = False
    natural[n - 1] = False
    seen = np.maximum.accumulate(np.where(natural, np.arange(n), -1))
    before = np.concatenate([[-1], seen[:-1]])
    piece = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [n]])))
    place = np.arange(n)
    forced = (before < place - (SYMBOL - 1)) & (place - begin[piece] >= SYMBOL)
    return natural, natural | forced


def _shared_bytes(codes: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from left[i] and from right[i] on are equal, counted up to `most`; codes are 0 at the pieces' ends."""
    out, live = np.full(len(left), most, np.int64), np.arange(len(left))
    for step in range(most):
        a = codes[left[live] + step]
        same = (a == codes[right[live] + step]) & (a > 0)
        out[live[~same]] = step
        live = live[same]
    return out


def repeated_strings(pieces: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, class) of all strings that occur in several places, and of some others; piece i holds the numbers[i] strings
    that begin at its first bytes. Equal strings have equal classes, others have others.

    The pieces are read as symbols, words or so, and the suffix array of the symbols is built. A symbol is ranked by its bytes and
    the two after it, on which its end depends, so that suffixes that begin at boundaries of one kind stand in the order of their
    bytes. A string belongs to the first boundary in it, and is the bytes before that and those from it on. Neighbours in the
    array that share as many bytes as the string has from there on are of one class; in the same way, neighbours among the symbols ordered
    from their ends tell which strings are equal before the boundary."""
    numbers = np.asarray(numbers, dtype=np.int64)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    joined = b"".join(pieces)
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    natural, boundary = _boundaries(data, begin)
    starts = np.flatnonzero(boundary)
    owner = np.searchsorted(begin, starts, "right") - 1
    piece_end = begin + lengths
    ends = np.minimum(np.append(starts[1:], n), piece_end[owner])
    names: dict[bytes, int] = {}
    raw = np.array([names.setdefault(joined[a:b], len(names)) for a, b in zip(starts.tolist(), np.minimum(ends + 2, piece_end[owner]).tolist(), strict=True)], dtype=np.int64)
    #: Ranks of the symbols from 1; 0 stands after each piece.
    rank = np.empty(len(names), np.int64)
    rank[[i for _, i in sorted(names.items())]] = np.arange(1, len(names) + 1)
    shift = np.arange(len(starts)) + owner
    string = np.zeros(len(starts) + len(pieces), np.int64)
    string[shift] = rank[raw] if len(raw) else 0
    at = np.full(len(string), -1, np.int64)
    at[shift] = starts
    array = at[suffix_array(string)]
    del rank, raw, string, shift, at, names
    codes = np.zeros(n + len(pieces) + LENGTH + 1, np.int16)
    moved = np.arange(n) + np.repeat(np.arange(len(pieces)), lengths)  # with a stop after each piece
    codes[moved] = data.astype(np.int16) + 1
    array = array[array >= 0]
    #: For each boundary its place among those of its kind in the array, and the most bytes that it shares with a neighbour there.
    orders = {}
    where, most = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int8)
    for kind in (True, False):
        inside = array[natural[array] == kind]
        shared = _shared_bytes(codes, moved[inside[:-1]], moved[inside[1:]], LENGTH).astype(np.int8)
        where[inside] = np.arange(len(inside))
        most[inside[:-1]] = shared
        most[inside[1:]] = np.maximum(most[inside[1:]], shared)
        orders[kind] = shared
    del codes, moved, array
    #: The boundary that each string belongs to: the first natural one in the 32 bytes after its first, else the byte after these.
    following = np.minimum.accumulate(np.where(natural, np.arange(n, dtype=np.int32), n + LENGTH)[::-1])[::-1]
    strings = np.zeros(n + 1, np.int8)
    strings[begin] += 1
    strings[begin + numbers] -= 1
    place = np.flatnonzero(np.cumsum(strings[:n], dtype=np.int8)).astype(np.int32)
    own = np.minimum(following[place + 1], place + (SYMBOL + 1))
    near = most[own] >= LENGTH - (own - place)  # the others share too little with any other suffix
    place, own = place[near], own[near]
    before = own - place
    right = np.zeros(len(place), np.int64)
    for kind, shared in orders.items():
        mine = natural[own] == kind
        for d in np.unique(before[mine]).tolist():
            these = np.flatnonzero(mine & (before == d))
            right[these] = np.concatenate([[0], np.cumsum(shared < LENGTH - d)])[where[own[these]]] * 2 + kind
    left = _left_classes(data, begin, place, own, before)
    _, classes = np.unique((before * (int(right.max(initial=0)) + 1) + right) * (int(left.max(initial=0)) + 1) + left, return_inverse=True)
    piece = np.searchsorted(begin, place, "right") - 1
    return piece, place - begin[piece], classes


def _left_classes(data: np.ndarray, begin: np.ndarray, place: np.ndarray, own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers that are equal for strings with equal bytes before their boundary, among strings with as many of them."""
    out = np.zeros(len(place), np.int64)
    short = np.flatnonzero(before <= SYMBOL)
    #: The bytes before each boundary, read backwards, in order; neighbours that share d bytes are equal to strings with d of them.
    places, back = np.unique(own[short], return_inverse=True)
    table = np.zeros((len(places), SYMBOL), np.uint8)
    first = begin[np.searchsorted(begin, places - 1, "right") - 1]
    for k in range(SYMBOL):
        there = places - 1 - k >= first
        table[there, k] = data[places[there] - 1 - k]
    order = np.lexsort(table.view(">u8").T[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    table = table[order]
    differs = table[1:] != table[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), SYMBOL)
    at = rank[back.ravel()]
    for d in np.unique(before[short]).tolist():
        these = before[short] == d
        out[short[these]] = np.concatenate([[0], np.cumsum(shared < d)])[at[these]]
    #: Without a natural boundary in reach the bytes themselves are the name.
    more: dict[bytes, int] = {}
    long = np.flatnonzero(before > SYMBOL)
    raw = data.tobytes() if len(long) else b""
    out[long] = [more.setdefault(raw[a:b], len(more)) for a, b in zip(place[long].tolist(), own[long].tolist(), strict=True)]
    return out


def joined_runs(ids: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of which one begins where the other ends as one run."""
    order = np.lexsort((places, ids))
    ids, places, numbers = ids[order], places[order], numbers[order]
    if not len(ids):
        return ids, places, numbers
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (places[1:] != places[:-1] + numbers[:-1])]))
    return ids[new], places[new], np.add.reduceat(numbers, new)


def _live(pieces: list[bytes], numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pieces have a context that another one has too; at: where a piece's anchor is."""
    begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]]).astype(np.int64)
    right, left, has_right, has_left = context_keys(window_hashes(np.frombuffer(b"".join(pieces), dtype=np.uint8), ANCHOR), begin, numbers, begin + at)
    out = np.zeros(len(pieces), bool)
    for keys, has in ((right, has_right), (left, has_left)):
        _, back, n = np.unique(keys[has], return_inverse=True, return_counts=True)
        out[np.flatnonzero(has)[n[back] > 1]] = True
    return out


def later_occurrences(pieces: list[bytes], ids: np.ndarray, places: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, place, number): runs of strings that also start earlier (at a smaller id, or a smaller place of the same)."""
    order = np.lexsort((places, ids))
    firsts: dict[bytes, int] = {}
    first_of = np.empty(len(pieces), np.int64)
    for i in order.tolist():
        first_of[i] = firsts.setdefault(pieces[i], i)
    copies = np.flatnonzero((first_of != np.arange(len(pieces))) & ((ids != ids[first_of]) | (places != places[first_of])))
    out = [(ids[copies], places[copies], numbers[copies])]
    distinct = np.array(sorted(firsts.values()), dtype=np.int64)
    distinct = distinct[_live([pieces[i] for i in distinct.tolist()], numbers[distinct], at[distinct])] if len(distinct) > 1 else distinct[:0]
    if len(distinct):
        piece, offset, classes = repeated_strings([pieces[i] for i in distinct.tolist()], numbers[distinct])
        own, spot = ids[distinct][piece], places[distinct][piece] + offset
        order = np.lexsort((spot, own, classes))
        own, spot, classes = own[order], spot[order], classes[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], classes[1:] != classes[:-1]]), np.arange(len(classes)), 0)) if len(classes) else classes
        later = (own != own[head]) | (spot != spot[head])
        out.append((own[later], spot[later], np.ones(int(later.sum()), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


RUNS = "id long, place int, number int"


def _runs(ids, places, numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places.astype(np.int32), pa.int32()), pa.array(numbers.astype(np.int32), pa.int32())], ["id", "place", "number"])


def repeated_runs(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(id, place, number) for rows (id, __text): runs of 100-byte strings of each document that also start earlier.

    Anchors are counted first; strings of anchors that occur once are not looked at again. The rest are sent to tasks by their anchor as short pieces of
    text, equal pieces of a batch once. A task builds the suffix array of its pieces block by block and reads the strings' classes from it. Strings of very
    common anchors are grouped by their bytes instead, in an aggregation and a join that Spark can split, and meet in no single task."""

    def anchors(batches):
        for batch in byte_budget(batches, 1, BATCH):
            _, hashes, _, first, number, anchor = _pieces(byte_texts(batch.column(1)))
            right, left, has_right, has_left = context_keys(hashes, first, number, anchor)
            keys, n = np.unique(np.concatenate([right[has_right], left[has_left]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    repeated = ws.save(rows.mapInArrow(anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    context = ws.spark.sparkContext
    mask = context.broadcast(bloom_build(repeated, "key", ANCHOR_BITS))
    hot = context.broadcast(bloom_build(repeated.where(F.col("n") >= HOT), "key", HOT_BITS))

    def cut(batches):
        bits, hot_bits = np.frombuffer(mask.value, dtype=np.uint8), np.frombuffer(hot.value, dtype=np.uint8)
        for batch in byte_budget(batches, 1, BATCH):
            data, hashes, text, first, number, anchor = _pieces(byte_texts(batch.column(1)))
            right, left, has_right, has_left = context_keys(hashes, first, number, anchor)
            keep = has_right & bloom_test(bits, right) | has_left & bloom_test(bits, left)
            hot_right, hot_left = ((has & bloom_test(hot_bits, x))[keep] for has, x in ((has_right, right), (has_left, left)))
            text, first, number, anchor = (x[keep] for x in (text, first, number, anchor))
            hashes = hashes[anchor]
            #: Strings before `middle` have the left context, the others the right one; hot ones leave the piece.
            middle = first + np.clip(anchor - HALF - first, 0, number)
            start, stop = np.where(hot_left, middle, first), np.where(hot_right, middle, first + number)
            parts = [(start, stop, stop > start, 0), (first, middle, hot_left & (middle > first), 1), (middle, first + number, hot_right & (first + number > middle), 1)]
            starts, stops, texts, keys, at, kinds = (np.concatenate(x) for x in zip(*[(a[m], b[m], text[m], hashes[m], (anchor - a)[m], np.full(int(m.sum()), k)) for a, b, m, k in parts], strict=True))
            ids = batch.column(0).to_numpy()[texts]
            lengths = np.array([len(t) for t in byte_texts(batch.column(1))], dtype=np.int64)
            places, counts = starts - (np.cumsum(lengths) - lengths)[texts], stops - starts
            raw = data.tobytes()
            pieces = [raw[x : y + LENGTH - 1] for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
            #: Of equal pieces of the batch the first stays; the others are known to be repeats.
            carrier: dict[bytes, int] = {}
            first_of = np.empty(len(pieces), np.int64)
            for i in np.lexsort((places, ids)).tolist():
                first_of[i] = carrier.setdefault(pieces[i], i)
            is_copy = first_of != np.arange(len(pieces))
            own = np.flatnonzero(~is_copy)
            none = pa.nulls(0, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds[own].astype(np.int32)), pa.array(keys.view(np.int64)[own]), pa.array(at[own].astype(np.int32)), pa.array(ids[own]),
                    pa.array(places[own].astype(np.int32)), pa.array(counts[own].astype(np.int32)), pa.array([pieces[i] for i in own.tolist()], pa.binary()),
                ],
                ["kind", "key", "at", "id", "place", "number", "piece"],
            )
            copies = np.flatnonzero(is_copy & ((ids != ids[first_of]) | (places != places[first_of])))
            ids, places, counts = joined_runs(ids[copies], places[copies], counts[copies])
            zero = pa.array(np.zeros(len(ids), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), 2, np.int32)), pa.array(np.zeros(len(ids), np.int64)), zero, pa.array(ids), pa.array(places.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.concat_arrays([none, pa.nulls(len(ids), pa.binary())])],
                ["kind", "key", "at", "id", "place", "number", "piece"],
            )

    pieces = ws.save(rows.mapInArrow(cut, f"kind int, key long, at int, {RUNS}, piece binary"), "pieces")
    ws.drop("anchors")

    def compared(batches):
        def done(held):
            if held:
                _, at, ids, places, numbers, texts = (np.concatenate(x) if i < 5 else [t for y in x for t in y] for i, x in enumerate(zip(*held, strict=True)))
                yield _runs(*joined_runs(*later_occurrences(texts, ids, *(x.astype(np.int64) for x in (places, numbers, at)))))

        held, size = [], 0
        for batch in batches:
            keys, at, ids, places, numbers = (batch.column(i).to_numpy() for i in range(5))
            texts = batch.column(5).to_pylist()
            begin = 0
            edges = np.concatenate([np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]).tolist()
            if held and len(keys) and held[-1][0][-1] != keys[0] and size >= BLOCK:
                yield from done(held)
                held, size = [], 0
            for edge in edges:
                size += sum(map(len, texts[begin:edge]))
                held.append((keys[begin:edge], at[begin:edge], ids[begin:edge], places[begin:edge], numbers[begin:edge], texts[begin:edge]))
                begin = edge
                if size >= BLOCK and edge < len(keys):
                    yield from done(held)
                    held, size = [], 0
        yield from done(held)

    cold = pieces.where("kind = 0").select("key", "at", "id", "place", "number", "piece")
    found = cold.repartition("key").sortWithinPartitions("key").mapInArrow(compared, RUNS)
    copies = pieces.where("kind = 2").select("id", "place", "number")
    return found.unionByName(copies).unionByName(_hot_runs(pieces.where("kind = 1")))


def _hot_runs(pieces: DataFrame) -> DataFrame:
    """Runs of the strings of very common anchors: each string, byte for byte, against its least occurrence."""

    def exploded(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts = part.column(3).to_pylist()
                numbers = part.column(2).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(texts)), numbers)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
                strings = [texts[i][k : k + LENGTH] for i, k in zip(row.tolist(), offset.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(part.column(0).to_numpy()[row]), pa.array((part.column(1).to_numpy()[row] + offset).astype(np.int32))], ["string", "id", "place"])

    strings = pieces.select("id", "place", "number", "piece").mapInArrow(exploded, "string binary, id long, place int")
    least = strings.groupBy("string").agg(F.min(F.struct("id", "place")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("string", "least")
    later = strings.join(least, "string").where(F.struct("id", "place") > F.col("least"))
    return later.select("id", "place", F.lit(1).cast("int").alias("number"))


def _without(raw: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and the rest."""
    change = np.zeros(len(raw) + 1, np.int32)
    for place, number in runs:
        change[place] += 1
        change[min(place + number + LENGTH - 1, len(raw))] -= 1
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
    return int(gone.sum()), spans, np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the bytes kept.

    A null or shorter text loses nothing. Rows of equal doc_id are one document at equal places, so a repeated row doesn't
    repeat itself; a null doc_id comes before all others. An empty table gives an empty one."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), whole(F.col(text)).alias("__text"))
    runs = ws.save(repeated_runs(rows, ws), "runs")
    ws.drop("pieces")
    touched = ws.spark.sparkContext.broadcast(bloom_build(runs.select("id").distinct(), "id", DOCUMENT_BITS))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def result(ids, raws, removed):
        ids = [None if i == NO_ID else i for i in ids]
        columns = [pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array([x[0] for x in removed], pa.int64()), pa.array([x[1] for x in removed], pa.int64())]
        columns.append(pa.array([hashlib.sha256(x[2]).hexdigest() for x in removed], pa.string()))
        return pa.RecordBatch.from_arrays(columns + [pa.array([x[2] for x in removed], pa.binary())] * keep_text, names)

    def split(want):
        def run(batches):
            bits = np.frombuffer(touched.value, dtype=np.uint8)
            for batch in byte_budget(batches, 1):
                part = batch.take(pa.array(np.flatnonzero(bloom_test(bits, batch.column(0).to_numpy()) == want)))
                if want:
                    yield part
                else:
                    raws = byte_texts(part.column(1))
                    yield result(part.column(0).to_pylist(), raws, [(0, 0, r) for r in raws])

        return run

    def removed(batches):
        for batch in byte_budget(batches, 1):
            raws = byte_texts(batch.column(1))
            spans = [[(x["place"], x["number"]) for x in own or ()] for own in batch.column(2).to_pylist()]
            yield result(batch.column(0).to_pylist(), raws, [_without(r, s) for r, s in zip(raws, spans, strict=True)])

    whole_rows = rows.mapInArrow(split(False), schema)
    by_document = runs.groupBy("id").agg(F.collect_list(F.struct("place", "number")).alias("runs"))
    cut_rows = rows.mapInArrow(split(True), rows.schema).join(by_document, "id", "left").select("id", "__text", "runs").mapInArrow(removed, schema)
    return whole_rows.unionByName(cut_rows)
