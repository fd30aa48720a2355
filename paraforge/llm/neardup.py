"""Near-duplicates by SetSketch registers, banding, joint likelihood and exact confirmation (operator 1)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bloom_build, bloom_test, byte_budget, byte_texts, sized_join, whole
from .graph import components

#: Registers and their parameters: base, rate and limit of the exponential scale.
BANDS, BAND_ROWS = 40, 5
REGISTERS = BANDS * BAND_ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: A pair whose likeliest similarity is below this is not confirmed: 6.3 standard deviations under 0.8, so that a pair at the
#: threshold is lost once in 10**10. near_duplicates(worth_confirming=0) confirms every pair that shares a bucket.
WORTH_CONFIRMING = 0.62
#: Bits of the filter of documents whose shingle sets are written (8 MB to every worker, whatever the corpus).
FILTER_BITS = 1 << 26
#: About how many pivots a group has in its first round, and about how many bytes of sketches and sets it has in all others.
FIRST_PIVOTS, PIVOT_BYTES = 16, 4 << 20
#: About how many bytes of sketches and sets of a group's members one task compares with the group's pivots.
BLOCK_BYTES = 256 << 10


def _constants() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240)
    return random.integers(0, 1 << 64, REGISTERS, dtype=np.uint64), random.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all beyond a number, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[bytes], size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of `size` words; with fewer words, of the whole sequence as one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            total = (total ^ h[i : len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return np.unique(total)


def registers(shingles: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The SetSketch of a set: per register the least of its elements' exponential values on a logarithmic scale,
    truncated to 0 .. LIMIT + 1. The sketch of a union is the larger of two sketches, register by register."""
    mix, factor = constants
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(shingles), 1024):
            part = shingles[begin : begin + 1024, None]
            np.minimum(least, ((part ^ mix) * factor).min(axis=0), out=least)
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 1) * 2.0**-64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(first, second)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair of sketches (rows of x and y), given the sizes of the sets."""
    up, down = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    equal = x.shape[1] - up - down
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - v * grid), p(v - u * grid)
    log = lambda z: np.log(np.maximum(z, 1e-12))
    likelihood = up * log(above) + down * log(below) + equal * log(1 - above - below)
    return np.take_along_axis(grid, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def reaches(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether the likeliest similarity of each pair of sketches is `least` or more.

    The likelihood of estimate() has one peak, so that is where it does not fall at `least`."""
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - up - down
    u, v = n / (n + m), m / (n + m)
    if least <= 0:
        return np.ones(len(u), bool)
    scale = (BASE - 1) / BASE
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * scale) / np.log(BASE)
    slope = lambda z: scale / (1 - np.clip(z, 0, 1) * scale) / np.log(BASE)
    above, below = p(u - v * least), p(v - u * least)
    rise, fall = -v * slope(u - v * least), -u * slope(v - u * least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = lambda k, d, q: np.where(k > 0, k * d / np.maximum(q, 1e-12), 0.0)
        climbs = gain(up, rise, above) + gain(down, fall, below) + gain(equal, -(rise + fall), 1 - above - below) >= 0
    return climbs & (least <= np.minimum(u / v, v / u))


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    rows = sketches.reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(BAND_ROWS):
            key = (key ^ rows[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def word_digest(words: list[bytes]) -> bytes | None:
    """What stands for a word sequence; none without words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def sketch(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, digest, sketch): digest stands for the word sequence; both are null without words."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole(F.col(text)).alias("__text"))

    def run(batches):
        hashes, constants = _WordHashes(), _constants()
        for batch in byte_budget(batches, 1):
            n, digests, sketches = [], [], []
            for raw in byte_texts(batch.column(1)):
                words = raw.lower().split()  # of bytes: lowers A-Z and splits at the ASCII separators only
                shingles = shingle_set(words, size, hashes)
                n.append(len(shingles))
                digests.append(word_digest(words))
                sketches.append(registers(shingles, constants).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                keys = band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["bucket", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "bucket long, node long")


def _likely(pairs: DataFrame, percent: int, least: float) -> DataFrame:
    """Of pairs with both sketches and sizes those whose sizes allow a link and whose likeliest similarity is `least` or more."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for c in ("xs", "ys"))
                n, m = (part.column(c).to_numpy().astype(np.float64) for c in ("xn", "yn"))
                keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & reaches(x, y, n, m, least)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "xs", "ys", "xn", "yn").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(node, digest, shingles): the sorted set of each node, and of a few other documents that the filter lets through."""
    mask = docs.sparkSession.sparkContext.broadcast(bloom_build(nodes, "node", FILTER_BITS))
    rows = docs.select(F.col(key).cast("long").alias("node"), whole(F.col(text)).alias("__text")).where("node IS NOT NULL")

    def run(batches):
        hashes, bits = _WordHashes(), np.frombuffer(mask.value, dtype=np.uint8)
        for batch in byte_budget(batches, 1):
            wanted = np.flatnonzero(bloom_test(bits, batch.column(0).to_numpy()))
            part = batch.take(pa.array(wanted))
            texts = [raw.lower().split() for raw in byte_texts(part.column(1))]
            digests = [word_digest(words) for words in texts]
            sets = [shingle_set(words, size, hashes).tobytes() for words in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["node", "digest", "shingles"])

    return rows.mapInArrow(run, "node long, digest binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _matcher(percent: int, least: float):
    """For a block of members and the pivots of its group: pairs of labels that a confirmed link joins, as a forest.

    Members that the block has joined to a pivot already are not compared with it."""

    def match(members, pivots):
        names = {x: i for i, x in enumerate(sorted({*members.column("label").to_pylist(), *pivots.column("label").to_pylist()}))}
        back = list(names)
        own, other = (np.array([names[x] for x in t.column("label").to_pylist()], dtype=np.int64) for t in (members, pivots))
        sizes = [t.column("n").to_numpy().astype(np.float64) for t in (members, pivots)]
        sketches = [np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for t in (members, pivots)]
        sets = [[np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()] for t in (members, pivots)]
        a, b = [], []
        for i in range(len(other)):
            n = sizes[1][i]
            at = np.flatnonzero((own != other[i]) & (100 * np.minimum(sizes[0], n) >= percent * np.maximum(sizes[0], n)))
            if len(at):
                at = at[reaches(sketches[0][at], sketches[1][i], sizes[0][at], np.full(len(at), n), least)]
            if not len(at):
                continue
            met = [sets[0][j] for j in at.tolist()]
            starts = np.cumsum([0, *map(len, met[:-1])])
            both = np.add.reduceat(np.isin(np.concatenate(met), sets[1][i], kind="sort"), starts, dtype=np.int64)
            for label in np.unique(own[at[100 * both >= percent * (sizes[0][at] + n - both)]]).tolist():
                mine = int(other[i])
                a.append(back[label])
                b.append(back[mine])
                own[own == label] = mine
                other[other == label] = mine
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return match


def near_duplicates(docs: DataFrame, ws: Workspace, size: int = 2, percent: int = 80, text: str = "text", key: str = "doc_id", worth_confirming: float = WORTH_CONFIRMING) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Word sequences are first made unique. Each bucket of a band has a most central document, and all documents whose buckets have
    the same one are a group. Each document is tested against the one most central document of its groups first, by estimate and
    then on full sets, which is one pair a document at most. Then pivots from outside a group's largest component are tested
    against the members of other components, in blocks of members of bounded bytes, and leave the group; a block gives back
    which components have met, as a forest. It ends when no group has members in two components, so all pairs that share a bucket
    are tested or already connected, and a large group of copies costs about its size. A group whose members share buckets without being
    near-duplicates costs a comparison of sketches for each pair, dealt over its blocks. Two documents at the threshold share no bucket
    with a probability of (1 - 0.8**5)**40, about 1e-7, and are below worth_confirming with one of about 1e-10.

    A null or empty text, or one without words, has n_shingles 0 and is a component of its own. Repeated rows each get a row;
    rows of one doc_id with different words are compared by their words. A null doc_id is linked with nothing, its component_id is null and it is kept. An empty table gives an empty one."""
    least = worth_confirming * percent / 80
    sketches = ws.save(sketch(docs, size, text, key), "sketches")
    some = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = ws.save(some.groupBy("digest").agg(F.min("doc_id").alias("node")), "first")
    nodes = some.join(first, "digest").where("doc_id = node").select("node", "digest", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["digest"])
    nodes = ws.save(nodes, "nodes")
    bands = ws.save(_bands(nodes).distinct(), "bands")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = ws.save(bands.join(shared, "bucket"), "sized")
    ws.drop("bands")
    active = ws.save(sized.select("node").distinct(), "active")
    sketched = ws.save(nodes.join(active, "node"), "sketched")
    sets = _sets(docs, active, size, text, key).dropDuplicates(["node", "digest"])
    profiles = ws.save(sketched.join(sets, ["node", "digest"]).select("node", "n", "sketch", "shingles"), "profiles", codec="uncompressed")
    ws.drop("nodes", "sketched")
    #: The central document is in the largest buckets: in a group of copies it is the text that they were made from, or close to it.
    central = sized.groupBy("node").agg(F.sum("n").alias("score"))
    middle = sized.join(central, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("m"))
    groups = sized.select("bucket", "node").join(middle, "bucket").select(F.col("m.node").alias("group"), "node", F.col("m.score").alias("score")).distinct()
    groups = ws.save(groups, "groups_0")
    ws.drop("sized")
    x = profiles.select(F.col("node").alias("a"), F.col("sketch").alias("xs"), F.col("n").alias("xn"))
    y = profiles.select(F.col("node").alias("b"), F.col("sketch").alias("ys"), F.col("n").alias("yn"))
    asked = groups.where("node <> group").groupBy("node").agg(F.max(F.struct("score", "group")).alias("best")).select(F.col("node").alias("a"), F.col("best.group").alias("b"))
    likely = ws.save(_likely(asked.join(x, "a").join(y, "b"), percent, least), "likely")
    met = ws.save(_confirmed(likely, profiles, percent), "met_0")
    labels = ws.save(_joined(active.select("node", F.col("node").alias("label")), met, ws, "components_0"), "labels_0")
    i = 0
    while True:
        i += 1
        members = ws.save(groups.join(labels, "node").select("group", "node", "label"), f"members_{i}")
        weighed = members.join(profiles.select("node", (8 * F.col("n") + 2 * REGISTERS).alias("bytes")), "node")
        sizes = weighed.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        parts = sizes.groupBy("group").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        #: Pivots come from outside a group's largest component: all of them, or about as many of them, by a hash, as the bounds say.
        outside, apart = F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")
        most = F.lit(FIRST_PIVOTS) if i == 1 else F.greatest(F.lit(1.0), outside * F.lit(float(PIVOT_BYTES)) / apart)
        parts = parts.select("group", F.col("main.label").alias("main"), F.least(F.lit(1.0), most / outside).alias("share"), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
        members = ws.save(sized_join(members, ws.save(parts, f"parts_{i}"), "group"), f"open_{i}")
        if not members.limit(1).count():
            break
        lot = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        pivots = ws.save(members.where((F.col("label") != F.col("main")) & (lot < F.col("share"))), f"pivots_{i}")
        own = ws.load(f"open_{i}", members.schema).join(profiles, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        against = pivots.join(ws.load("profiles", profiles.schema), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = ["group", "block", "label", "n", "sketch", "shingles"]
        compared = own.select(*columns).groupBy("group", "block").cogroup(against.select(*columns).groupBy("group", "block"))
        met = ws.save(compared.applyInArrow(_matcher(percent, least), "a long, b long").distinct(), f"met_{i}")
        labels = ws.save(_joined(labels, met, ws, f"components_{i}"), f"labels_{i}")
        groups = ws.save(members.select("group", "node").join(pivots.select("group", "node"), ["group", "node"], "left_anti"), f"groups_{i}")
        ws.drop(f"groups_{i - 1}", f"labels_{i - 1}", f"members_{i}", f"open_{i}", f"parts_{i}", f"pivots_{i}")
    known = sketches.select("doc_id", "n_shingles", "digest").join(first, "digest", "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id"))
    return known.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(labels: DataFrame, met: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """labels (node, label) after the labels of each pair (a, b) in `met` have become one, the smallest."""
    if not met.limit(1).count():
        return labels
    renamed = components(met, ws, name).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(renamed, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
