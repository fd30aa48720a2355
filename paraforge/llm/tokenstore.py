"""Token ids in a content-addressed binary store with recipes and Merkle manifests (operator 10)."""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunkstore as store
from .common import Workspace, byte_budget, byte_texts, sized_join, whole

END = 1
#: Words that a worker keeps with their ids; beyond it all go. It saves work, it decides nothing.
KEPT_WORDS = 800_000
#: ASCII symbols but the apostrophe, which may begin a piece with the letters after it.
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: About how many bytes of text are encoded at a time.
BATCH = 12 << 20
#: The steps of the tokenizer whose words can be encoded one by one. Any other tokenizer gets whole texts.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}


class WordTokenizer:
    """Encodes texts with a tokenizer. One whose steps are WORDWISE never joins tokens over white space: it encodes word by word,
    each new word once. Any other encodes whole texts.

    A text that has a character that begins the string of an added token is encoded as a whole. Other texts are put
    in lower case (A-Z) first, as the tokenizer does. Symbols at the end of a word, after a letter or number below U+0250, are a
    piece of their own for the tokenizer, so they are split off; not after U+0130 or higher letters, which may end in a mark when
    normalised, and a mark joins the symbols. Letters below U+0250 go to the tokenizer's model directly, in lower case,
    because normalising and splitting do no more to them."""

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2") if self.width == 2 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        steps = json.loads(definition)
        self.plain = all(steps.get(k) == v for k, v in WORDWISE.items()) and steps["model"].get("type") == "BPE" and not steps["model"].get("dropout")
        #: What an added token begins with; a text that has one is not cut into words.
        self.openings = tuple({x["content"][:2] for x in steps.get("added_tokens") or ()})
        #: The characters that stand for bytes in a byte-level model: printable ones for themselves, the others in order from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}

    @classmethod
    def of(cls, definition: str, name: str) -> WordTokenizer:
        """One tokenizer for a worker process and definition."""
        if name not in cls._made:
            cls._made.clear()
            cls._made[name] = cls(definition)
        return cls._made[name]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of words in lower case (A-Z). Each distinct part, a word without its symbols at the end or those symbols, is encoded once."""
        known = self.known
        cut: list[tuple[str, str]] = []
        made: dict[str, bytes | None] = {}
        for word in words:
            core, tail = word.rstrip(SYMBOLS), ""
            last = core[-1:]
            if last.isalnum() and last < "\u0250" and last != "\u0130":
                tail = word[len(core) :]
            else:
                core = word
            cut.append((core, tail))
            for part in (core, tail):
                if part not in made:
                    made[part] = known.get(part)
        tokenize, code = self.tokenizer.model.tokenize, "H" if self.width == 2 else "I"
        rest = []
        for part, ids in made.items():
            if ids is not None:
                continue
            if part.isalpha():
                if part.isascii():
                    made[part] = array(code, [x.id for x in tokenize(part)]).tobytes()
                    continue
                if max(part) < "\u0250":
                    lower = part.lower()
                    if max(lower) < "\u0250" and lower.isalpha():
                        made[part] = array(code, [x.id for x in tokenize(lower.encode().decode("latin-1").translate(self.byte_chars))]).tobytes()
                        continue
            rest.append(part)
        made.update(zip(rest, self._ids(rest), strict=True))
        return [made[core] + made[tail] if tail else made[core] for core, tail in cut]

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian integers of `width` bytes, with the end id after them.

        All words of the texts are put into a dictionary first, so that a word is looked up once for many places."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, end = self.known, np.array([END], dtype=self.kind).tobytes()
        #: A slice is copied first: Arrow's casts to larger offsets misread slices.
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string()) if isinstance(texts, list) else pa.concat_arrays([texts]).cast(pa.large_string())
        column = column.fill_null("")
        if not self.plain:
            return [x + end for x in self._ids(column.to_pylist())]
        apart = np.zeros(len(column), bool)
        for x in self.openings:
            apart |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        whole_texts = dict(zip(np.flatnonzero(apart).tolist(), [x + end for x in self._ids(column.filter(pa.array(apart)).to_pylist())], strict=True)) if apart.any() else {}
        if whole_texts:
            column = pc.if_else(pa.array(apart), "", column)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column))  # exactly the ASCII separators and A-Z
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy()
        words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each word first
        known[""] = b""
        ids = list(map(known.get, words))
        if None in ids:
            at = [i for i, x in enumerate(ids) if x is None]
            new = [words[i] for i in at]
            found = self._new(new)
            known.update(zip(new, found, strict=True))
            for i, x in zip(at, found, strict=True):
                ids[i] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        starts = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(ids), dtype=self.kind)
        size = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if max(len(table), ends[-1]) < 1 << 31 else np.int64
        flat = table[np.arange(ends[-1], dtype=kind) + np.repeat((starts[codes] - ends[:-1]).astype(kind), size)].tobytes()
        stops = (ends[lists.offsets.to_numpy()] * self.width).tolist()
        return [whole_texts.get(i) or flat[x:y] + end for i, (x, y) in enumerate(zip(stops, stops[1:]))]


def cutting(width: int) -> store.Cutting:
    return store.Cutting(least=64, mean=256, most=2048, width=width)


def write_tokens(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id", path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encodes every text once and writes its ids to a store in ascending order of the key.

    Gives three tables: packs (a row for each document, with its place in its part), chunks, and the manifest (a row for each
    part: its documents, its ids and those before, the bytes of an id, and the Merkle root over its documents, each with its key, its number of
    ids and the root of its recipe). Texts are encoded once, into a staging table that is dropped at the end; ids, not texts,
    are dealt into ranges of the key, of a hash of the ids and of a row number, so that neither null nor repeated keys meet in one task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    shared_definition = ws.spark.sparkContext.broadcast(definition)  # as large as the vocabulary, whatever the corpus
    name = hashlib.sha256(definition.encode()).hexdigest()
    how = cutting(WordTokenizer.of(definition, name).width)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole(F.col(text)).alias("__text"))

    def encoded(batches):
        coder = WordTokenizer.of(shared_definition.value, name)
        for batch in byte_budget(batches, 1, BATCH):
            ids = coder.encode(batch.column(1))
            chunks = store.chunked(ids, how)
            recipes = [b"".join(map(store.digest, own)) for own in chunks]
            lengths = pa.array([[len(c) for c in own] for own in chunks], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(recipes, pa.binary()), lengths], ["doc_id", "ids", "recipe", "lengths"])

    staged = ws.save(rows.mapInArrow(encoded, "doc_id long, ids binary, recipe binary, lengths array<int>").withColumn("row", F.monotonically_increasing_id()), "staged")

    def digests(batches):
        for batch in batches:
            yield store.count_names(byte_texts(batch.column(0)))

    mask = ws.spark.sparkContext.broadcast(store.repeated_filter(staged.select("recipe").mapInArrow(digests, store.DIGESTS)))

    def packed(batches):
        bits = np.frombuffer(mask.value, dtype=np.uint8)
        start, place, part, tree = 0, 0, None, store.MerkleTree()
        names = ["key", "doc_id", "part", "place", "local_start", "n_tokens", "tree", *store.PACK_NAMES, "s1", "s2", "chunk"]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *store.PACK_KINDS, pa.int64(), pa.int64(), pa.binary()]

        def rows(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, kind) for x, kind in zip(names, kinds, strict=True)], names)

        for batch in byte_budget(batches, 1):
            ids, recipes, lengths = byte_texts(batch.column(1)), byte_texts(batch.column(3)), batch.column(4).to_pylist()
            found = store.pack(ids, recipes, lengths, bits)
            d1, d2, chunk = store.shared_batch(ids, recipes, lengths, bits).columns
            if len(chunk):
                yield rows(s1=d1, s2=d2, chunk=chunk)
            n = np.array([len(x) // how.width for x in ids], dtype=np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            part = batch.column(2)[0].as_py()
            docs = batch.column(0).to_pylist()
            for i, m, row in zip(docs, n.tolist(), found, strict=True):
                tree.add(leaf(i, m, row[-1]))
            keys = [hashlib.blake2b(repr(i).encode() + x, digest_size=16).digest() for i, x in zip(docs, ids, strict=True)]
            own = {"key": pa.array(keys, pa.binary()), "doc_id": batch.column(0), "part": batch.column(2), "place": pa.array(np.arange(place, place + len(ids))), "local_start": pa.array(starts), "n_tokens": pa.array(n)}
            place += len(ids)
            yield rows(**own, **dict(zip(store.PACK_NAMES, store.pack_columns(found), strict=True)))
        if place:  # the part's row of the manifest: the number of its documents and ids, and its root
            yield rows(part=pa.array([part], pa.int32()), place=pa.array([place]), local_start=pa.array([start]), tree=pa.array([tree.root()], pa.binary()))

    rank = ["doc_id", F.xxhash64("ids"), "row"]
    ordered = staged.repartitionByRange(*rank).sortWithinPartitions(*rank).select("doc_id", "ids", F.spark_partition_id().alias("part"), "recipe", "lengths")
    #: Rows of three kinds: a document, a chunk that may be shared, and a part's facts.
    schema = f"key binary, doc_id long, part int, place long, local_start long, n_tokens long, tree binary, {store.PACK}, s1 long, s2 long, chunk binary"
    written = ws.save(ordered.mapInArrow(packed, schema), "packs")
    ws.drop("staged")
    chunks = ws.save(store.unique_chunks(written.where("chunk IS NOT NULL").select(F.col("s1").alias("d1"), F.col("s2").alias("d2"), "chunk")), "chunks")
    #: A row for each part that was written; the window runs over these.
    parts = written.where("tree IS NOT NULL").select("part", F.col("place").alias("docs"), F.col("local_start").alias("n"), F.col("tree").alias("root"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = ws.save(parts.select("part", before.alias("before"), "docs", "n", "root", F.lit(how.width).alias("width")), "manifest")
    return written.where("root IS NOT NULL").drop("tree", "s1", "s2", "chunk"), chunks, manifest


def leaf(key: int | None, n: int, root: bytes) -> bytes:
    """What a part's tree has of a document."""
    return f"{key}:{n}:".encode() + root


def check_parts(packs: DataFrame, manifest: DataFrame) -> None:
    """Recomputes the Merkle root of every part from its documents in order; ValueError names a part that isn't as the manifest says.

    Only keys, counts and roots are moved; a part's rows stream through one task, which holds a few nodes of the tree."""

    def roots(batches):
        part, docs, n, tree = None, 0, 0, store.MerkleTree()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([n], pa.int64()), pa.array([tree.root()], pa.binary())], ["part", "docs", "n", "root"])
        for batch in batches:
            for at, key, tokens, root in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if at != part and part is not None:
                    yield row()
                    docs, n, tree = 0, 0, store.MerkleTree()
                part, docs, n = at, docs + 1, n + tokens
                tree.add(leaf(key, tokens, root))
        if part is not None:
            yield row()

    own = packs.select("part", "place", "doc_id", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "place").mapInArrow(roots, "part int, docs long, n long, root binary")
    both = manifest.select("part", F.struct("docs", "n", "root").alias("x")).join(own.select("part", F.struct("docs", "n", "root").alias("y")), "part", "full_outer")
    bad = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("part").limit(1).collect()
    if bad:
        raise ValueError(f"part {bad[0][0]} is not what the manifest says")


def read_tokens(packs: DataFrame, chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """What the store holds: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    Every part is checked against its Merkle root before anything is read, every recipe against the root in it, and every chunk
    against its digest. The bytes of an id are those that the manifest says."""
    check_parts(packs, manifest)
    first = manifest.select("width").first()
    kind = np.dtype("<u2") if first is None or first["width"] == 2 else np.dtype("<u4")
    placed = sized_join(packs, manifest.select("part", "before"), "part").withColumn("start", F.col("before") + F.col("local_start"))

    def use(columns, payloads):
        ids = [np.frombuffer(p, dtype=kind) for p in payloads]
        if columns[2].to_pylist() != [len(x) for x in ids]:
            raise ValueError("a document has another number of ids than its row says")
        sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.read_back(placed, chunks, use, "doc_id long, start long, n_tokens long, ids_crc32 long", ["doc_id", "start", "n_tokens"])


def manifest_root(manifest: DataFrame) -> str:
    """The Merkle root over all parts, from the manifest's few rows."""
    return store.merkle([r["root"] for r in manifest.orderBy("part").select("root").collect()]).hex()


def token_round_trip(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Writes the ids of every text and reads them back (see write_tokens and read_tokens).

    A null or empty text has the end id alone. Rows of equal key are ordered by a hash of their ids, a null key comes first;
    repeated rows each get a row and a place; an empty table gives an empty one."""
    packs, chunks, manifest = write_tokens(docs, ws, text, key, path)
    return read_tokens(packs, chunks, manifest)
