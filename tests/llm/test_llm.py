"""Each operator against a brute-force version, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraforge.llm import bpe, chunkstore, common, lmscore, media, mixing, neardup, pii, quality, queries, sharding, substrings, tokenstore
from paraforge.llm.common import accept_within, bloom_build, bloom_test, documents
from paraforge.llm.graph import components
from paraforge.llm.suffixes import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def table(df):
    return [r.asDict() for r in df.collect()]


# --- near-duplicates ---------------------------------------------------------------------------------------------


def exact_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        k = min(size, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return sets, {i: root(i) for i in ids}


def varied(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 80))] for _ in range(25)]
    out = {}
    for i in range(n):
        text = list(r.choice(base))
        for _ in range(r.randint(0, 1 + len(text) // 12)):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        out[i] = " ".join(text)
    return out


@pytest.mark.parametrize(("size", "seed"), [(2, 1), (5, 2)])
def test_near_duplicates_match_brute_force(spark, ws, size, seed):
    texts = varied(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, ws, size=size).collect()}
    sets, label = exact_components(texts, size, 80)
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_awkward_rows(docs, nothing, ws):
    rows = table(neardup.near_duplicates(docs, ws))
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 0
    assert [by_id[i]["component_id"] for i in (3, 4, 5)] == [3, 4, 5] and by_id[3]["n_shingles"] == 0
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert neardup.near_duplicates(nothing, ws).count() == 0


def test_one_hot_group(spark, ws, monkeypatch):
    """Near copies of one text, of which many are too far from each other, template pages that share buckets but never link, and rows of one doc_id with different words: nothing is lost, however small blocks and pivots are."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(neardup, "PIVOT_BYTES", 30_000)
    r = random.Random(21)
    base, page = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(260):
        words_of = list(base)
        for _ in range(r.randint(0, 6)):
            words_of[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(words_of)
    for i in range(260, 360):
        words_of = list(page)
        for j in range(4):
            words_of[5 + 13 * j] = f"y{r.randrange(10**6)}"
        texts[i] = " ".join(words_of)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, ws).collect()}
    assert got == exact_components(texts, 2, 80)[1]
    twice = spark.createDataFrame([(5, "a b c d e f g h i j k l"), (5, "m n o p q r s t u v w x"), (9, "m n o p q r s t u v w x y"), (3, "a b c d e f g h i j k l z")], "doc_id long, text string")
    assert {(x["doc_id"], x["component_id"]) for x in neardup.near_duplicates(twice, ws).collect()} == {(3, 3), (5, 3), (9, 3)}


def test_estimates_reach_a_similarity():
    r = np.random.default_rng(5)
    x = r.integers(0, 40, (300, neardup.REGISTERS)).astype("<u2")
    y = np.where(r.random(x.shape) < r.random((300, 1)), x, r.integers(0, 40, x.shape)).astype("<u2")
    n, m = r.integers(50, 100, 300).astype(float), r.integers(50, 100, 300).astype(float)
    got = neardup.reaches(x, y, n, m, 0.62)
    likeliest = neardup.estimate(x, y, n, m)
    assert (got == (likeliest >= 0.62))[abs(likeliest - 0.62) > 0.006].all() and 20 < got.sum() < 280
    assert neardup.reaches(x, y, n, m, 0.0).all()


def test_sketches_estimate_and_merge():
    random_sets = np.random.default_rng(3)
    constants = neardup._constants()
    both = random_sets.integers(0, 1 << 63, 900).astype(np.uint64)
    x, y = np.unique(np.concatenate([both[:800], both[800:850]])), np.unique(np.concatenate([both[:800], both[850:]]))
    a, b = neardup.registers(x, constants), neardup.registers(y, constants)
    got = neardup.estimate(a[None], b[None], np.array([float(len(x))]), np.array([float(len(y))]))[0]
    assert abs(got - 800 / 900) < 0.08
    assert (neardup.merged(a, b) == neardup.registers(np.union1d(x, y), constants)).all()


def test_components(spark, ws):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), ws, "c").collect()}
    assert got == {k: v for k, v in label.items() if k in got} and len(set(label) - set(got)) == sum(1 for k in label if all(a == b for a, b in edges if k in (a, b)))


# --- media and token store ---------------------------------------------------------------------------------------


def test_media_round_trip(docs, nothing, ws):
    rows = collections.Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        rows[r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), 44 + len(payload)] += 1
    got = table(media.media_round_trip(docs, ws))
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes")) for r in got) == rows
    same = {(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}
    assert len(same) == len({x[0] for x in same})
    assert media.media_round_trip(nothing, ws).count() == 0


def test_chunks():
    r = random.Random(5)
    a = bytes(r.randrange(256) for _ in range(50_000))
    b = b"x" * 777 + a
    how = media.CUTTING
    first, second = chunkstore.chunked([a, b], how)
    assert b"".join(first) == a and b"".join(second) == b
    assert all(how.least <= len(c) <= how.most for c in first[:-1])
    assert len(set(first) & set(second)) > 0.8 * len(first)
    assert chunkstore.chunked([b"", b"z"], how) == [[], [b"z"]]
    names = [chunkstore.digest(c) for c in first]
    assert chunkstore.merkle(names) != chunkstore.merkle(names[::-1])
    with pytest.raises(ValueError, match="Merkle"):
        chunkstore.rebuild(b"".join(names), [len(c) for c in first], [], a, b"", {})
    with pytest.raises(ValueError, match="damaged"):
        chunkstore.rebuild(b"".join(names), [len(c) for c in first], [], b"!" + a[1:], chunkstore.merkle(names), {})


def test_payloads_are_rebuilt_in_bounded_parts(spark, ws):
    """Long payloads, alike ones among them, are not held 500 at a time; short ones still share a part; none is lost."""
    import pyarrow as pa

    r = random.Random(9)
    texts = [r.randbytes(n // 2).hex() for n in [10, 300_000, 0, 90_000] * 20] + ["same " * 20_000] * 20 + [r.randbytes(3 << 20).hex()] + ["x"] * 1200
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)

    def use(columns, payloads):
        n = len(payloads)
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(p) for p in payloads], pa.int64()), pa.array([n] * n, pa.int64()), pa.array([sum(map(len, payloads))] * n, pa.int64())], ["doc_id", "own", "rows", "bytes"])

    got = chunkstore.read_back(*media.write_media(df, ws), use, "doc_id long, own long, rows long, bytes long", ["doc_id"]).collect()
    assert {x["doc_id"]: x["own"] for x in got} == {i: 44 + max(192, -(-len(t) // 192) * 192) for i, t in enumerate(texts)} and len(got) == len(texts)
    assert all(x["bytes"] <= chunkstore.READ_BYTES or x["rows"] == 1 for x in got) and max(x["rows"] for x in got) > 100


def test_token_store(docs, nothing, ws):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit("A<|endoftext|>b don't, 'S x.., café. 12,5 İ é,")))
    expected = collections.Counter()
    start = 0
    for r in sorted(special.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected[r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    got = table(tokenstore.token_round_trip(special, ws))
    assert collections.Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert tokenstore.token_round_trip(nothing, ws).count() == 0


def test_token_store_manifest(docs, ws):
    packs, chunks, manifest = tokenstore.write_tokens(docs, ws)
    assert len(tokenstore.manifest_root(manifest)) == 64
    assert sum(r["n"] for r in manifest.collect()) == packs.agg(F.sum("n_tokens")).first()[0]
    assert chunks.count() == chunks.select("d1", "d2").distinct().count()
    tokenstore.check_parts(packs, manifest)
    swapped = F.when(F.col("doc_id") == 0, F.lit(8)).when(F.col("doc_id") == 8, F.lit(0)).otherwise(F.col("doc_id")).cast("long")
    more = packs.where("doc_id = 6").withColumn("place", F.lit(10**6).cast("long"))
    for damaged in (packs.where("NOT (doc_id <=> 8)"), packs.withColumn("doc_id", swapped), packs.withColumn("n_tokens", F.col("n_tokens") + 1), packs.limit(0), packs.unionByName(more)):
        with pytest.raises(ValueError, match="manifest"):
            tokenstore.read_tokens(damaged, chunks, manifest)
    with pytest.raises(ValueError, match="manifest"):
        tokenstore.read_tokens(packs, chunks, manifest.withColumn("root", F.unhex(F.lit("00"))))
    if chunks.count():
        with pytest.raises(Exception, match="missing or damaged"):
            tokenstore.read_tokens(packs, chunks.limit(0), manifest).collect()


def test_slices_of_batches_are_encoded(spark, ws, monkeypatch):
    """Texts of several batches, with characters of many bytes, are what the library gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenstore, "BATCH", 300)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: ("é☃ abc, 日本 語 Ü." * (i % 9) + f" word{i}" if i % 7 else None) for i in range(120)}
    got = tokenstore.token_round_trip(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), ws).collect()
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_parts_of_words():
    """Words of any letters and symbols are what the library gives, and letters with symbols after them do not need its steps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    tokenizer, coder = Tokenizer.from_str(definition), tokenstore.WordTokenizer(definition)
    r = random.Random(12)
    odd = [*map(chr, range(33, 0x250)), *"²①一☃\u0301\u0338\u00a0ẞ\u212a\u017f\u037eⱥ٢½", "'s", "don't", "...", "$$$"]
    coder.encode(["\u0130 \u0958 é".encode()])  # known from now on, but no part of the words with a comma
    texts = ["\u0130, \u0958, é,", *(x + y for x in odd for y in ("", "$$$", "a.", "'s,")), *(" ".join("".join(r.choices([*odd, *"aeinst", *".,#"], k=r.randint(1, 7))) for _ in range(40)) for _ in range(300))]
    for text, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, coder.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text
    sent, steps = [], coder._ids
    coder._ids = lambda parts: sent.extend(parts) or steps(parts)
    words = ["snowmen$$$", "snowmen###,", "Straßen.!", "Éoliennes&&&", "éoliennes.", "éoliennes"]
    [ids] = coder.encode([" ".join(words).encode()])
    assert np.frombuffer(ids, coder.kind).tolist() == [*tokenizer.encode(" ".join(words), add_special_tokens=False).ids, 1]
    assert not any(c.isalpha() for part in sent for c in part), sent


def test_merkle_tree():
    for n in range(40):
        leaves, tree = [bytes([i]) for i in range(n)], chunkstore.MerkleTree()
        for x in leaves:
            tree.add(x)
        assert tree.root() == chunkstore.merkle(leaves)


def test_other_tokenizers_get_whole_texts(spark, docs, ws, tmp_path):
    """One with more than 65,536 ids, which are stored 4 bytes wide, and whose tokens join over spaces."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocabulary = {chr(c): i for i, c in enumerate(range(32, 127))} | {"e ": 70_000, "s ": 70_001} | {f"#{i}#": 200 + i for i in range(69_000)}
    tokenizer = Tokenizer(models.BPE(vocabulary, [("e", " "), ("s", " ")], unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("\\n"), "isolated")
    path = str(tmp_path / "joining.json")
    tokenizer.save(path)
    some = docs.where("length(text) < 1000 AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    start, expected = 0, []
    for r in some.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenstore.token_round_trip(some, ws, path=path).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected and any(len(x) > 1 for x in got)


# --- BPE ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay(encoding):
    ranks, pattern, reference = encoding
    r = random.Random(6)
    letters = [*"aab bcé世🙂' \t\n1٢_-xyz", "the", "ing", " "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, " " * 300 + "!" * 999, "x\x1cy\x85z　q"]
    coder = bpe.Coder(ranks, pattern)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()


def test_bpe_query(docs, nothing, encoding):
    *_, reference = encoding
    expected = collections.Counter()
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        expected[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    got = table(bpe.round_trip(docs))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == expected
    assert bpe.round_trip(nothing).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"))).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)


def test_ids_are_handed_on_in_bounded_parts(spark):
    """However many texts share a batch, a call gets and a batch for Spark has at most IDS ids, or one text."""
    import pyarrow as pa

    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 9, 40_000]))) for _ in range(60)] + ["x y " * bpe.IDS]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)

    def use(keys, ids):
        n = len(ids)
        return pa.table([keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([n] * n, pa.int64()), pa.array([sum(map(len, ids))] * n, pa.int64())], ["doc_id", "own", "texts", "ids"])

    got = {x["doc_id"]: x for x in bpe.replayed_ids(df, "text", "doc_id", None, None, use, "doc_id long, own long, texts long, ids long").collect()}
    whole = {x["doc_id"]: x["n_tokens"] for x in bpe.round_trip(df).collect()}
    assert {i: x["own"] for i, x in got.items()} == whole and len(got) == len(texts) and sum(whole.values()) > 3 * bpe.IDS
    assert all(x["ids"] <= bpe.IDS or x["texts"] == 1 for x in got.values()) and max(x["texts"] for x in got.values()) > 1


# --- mixing ------------------------------------------------------------------------------------------------------


def targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    live = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out = 1.5 * sum(sizes.values()), {}
    while live:
        rest, weight = total - sum(out.values()), sum(live.values())
        hit = [s for s in live if live[s] * rest / weight > 2 * sizes[s]]
        if not hit:
            return out | {s: w * rest / weight for s, w in live.items()}
        for s in hit:
            out[s] = 2 * sizes[s]
            del live[s]
    return out


def test_mixing(spark, ws):
    r = random.Random(7)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = table(mixing.mix(df, ws).withColumn("taken", F.col("copies") * F.col("size")))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    expected = targets(sizes)
    taken = collections.Counter()
    for x in got:
        assert x["size"] == len(words(x["text"])) and x["source_size"] == sizes[x["source"]] and 0 <= x["copies"] <= 2
        assert math.isclose(x["target"], expected[x["source"]])
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - expected[s]) <= 60 for s in sizes)
    again = {x["doc_id"]: x["copies"] for x in table(mixing.mix(df.repartition(7), ws))}
    assert again == {x["doc_id"]: x["copies"] for x in got}


def test_longer_documents_are_likelier(spark, ws):
    """Inclusion probabilities differ within a source as the method says: shares of short and long documents are near rest * w / sum(w * size)."""
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 70)), "a" if i < 4000 else "b") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = table(mixing.mix(df, ws).where("source = 'b'").groupBy("size").agg(F.avg("copies").alias("share"), F.max("target").alias("target"), F.max("source_size").alias("all"), F.count(F.lit(1)).alias("n")))
    rest = got[0]["target"] - got[0]["target"] // got[0]["all"] * got[0]["all"]
    weight = {10: 125, 70: 275}
    total = sum(x["n"] * x["size"] * weight[x["size"]] for x in got)
    for x in got:
        assert abs(x["share"] - x["target"] // x["all"] - rest * weight[x["size"]] / total) < 0.05
    given = mixing.mix(df, ws, weight=F.when(F.col("doc_id") % 4 < 2, F.lit(1)).otherwise(F.lit(5)))
    shares = {x["k"]: x["share"] for x in table(given.where("source = 'b'").groupBy((F.col("doc_id") % 4 < 2).alias("k")).agg(F.avg("copies").alias("share")))}
    assert shares[False] > shares[True] + 0.1


def test_repeated_rows_and_null_ids_meet_the_target(spark, ws):
    """A source that is one row a thousand times, one whose rows have no ids, and one of ties: each comes within a document of its target."""
    rows = [(7, "one two three", "a")] * 1000 + [(None, f"w{i % 300} x y z", "b") for i in range(900)] + [(i, "a b", "c") for i in range(800)]
    got = table(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), ws))
    assert len(got) == len(rows)
    for s in "abc":
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) <= 4
        assert {x["copies"] for x in own} <= {0, 1, 2}


def test_mixing_of_awkward_rows(docs, nothing, ws):
    got = mixing.mix(docs, ws)
    assert got.count() == docs.count() and got.columns[: len(docs.columns)] == docs.columns
    assert mixing.mix(nothing, ws).count() == 0


def test_accept_within(spark, ws):
    items = ws.save(spark.range(500).select((F.col("id") % 2).alias("k"), ((F.col("id") + 0.5) / 500).alias("rank"), F.lit(3).alias("m"), "id"), "items")
    got = accept_within(items, spark.createDataFrame([(0, 100.0), (1, 10_000.0)], "k long, q double"), "k", "rank", ["id"], "m", "q", ws, "t")
    sums = {r["k"]: r["s"] for r in got.where("accepted").groupBy("k").agg(F.sum("m").alias("s")).collect()}
    assert sums == {0: 99, 1: 750}


# --- sharding ----------------------------------------------------------------------------------------------------


def test_sharding(spark, ws):
    r = random.Random(8)
    rows = [(i, f"copy {r.randrange(30)}" if i % 3 == 0 else "the same" if i % 6 == 1 else f"single {i}") for i in range(900)]
    got = table(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), ws, shards=12))
    counts = collections.Counter(x["shard"] for x in got)
    assert set(counts) == set(range(12)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(counts[s]))
    text = dict(rows)
    groups = collections.defaultdict(set)
    for x in got:
        assert x["size"] == len(text[x["doc_id"]].encode()) + 16 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode())
        groups[text[x["doc_id"]]].add(x["shard"])
    assert sum(len(groups[f"copy {j}"]) == 1 for j in range(30)) >= 24
    assert len(groups["the same"]) < 12  # 150 rows over shards of 75


def test_cut_edges(spark, ws):
    """Counted pair by pair: with free places less than half of what a hash cuts beyond what sizes force, with ties and repeated rows; with no place free still less."""
    r = random.Random(17)
    linked = [(i, f"group {r.randrange(60)}") for i in range(700)] + [(1000 + i, "large") for i in range(300)] + [(5, "tie"), (5, "tie"), (5, "tie"), (None, "tie")]
    for rows, most in ((linked + [(5000 + i, f"single {i}") for i in range(1000)], 0.5), (linked, 0.85)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sharding.shard(df, ws, shards=10)
        plain = [(x["text_crc32"], x["shard"]) for x in got.collect()]
        cut = sum(a[0] == b[0] and a[1] != b[1] for i, a in enumerate(plain) for b in plain[:i])
        edges = sum(a[0] == b[0] for i, a in enumerate(plain) for b in plain[:i])
        counted = sharding.cut_edges(got, "text_crc32").first()
        assert (counted["edges"], counted["cut"]) == (edges, cut)
        by_hash = sharding.cut_edges(df.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(10))), "text").first()["cut"]
        place = len(rows) // 10 + 1
        forced = sum(k * (300 - k) for k in [place] * (300 // place) + [300 % place]) // 2
        assert cut - forced < most * (by_hash - forced), (cut, forced, by_hash)
        sizes = collections.Counter(s for _, s in plain)
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_sharding_of_awkward_rows(docs, nothing, ws):
    got = table(sharding.shard(docs, ws, shards=5))
    assert len(got) == docs.count() and {x["law"] for x in got} == {"rows"}
    assert sharding.shard(nothing, ws).count() == 0


# --- personal data -----------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            checksum = sum(d if i % 2 == 0 else (2 * d) % 10 + (2 * d) // 10 for i, d in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and checksum % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans():
    r = random.Random(9)
    parts = [*"@@..-+ ()0123456789ab%", "4111111111111111", "+1 (415) 555-2671", "1.2.3.4", "a@b.co"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_contexts_discover_identifiers(spark, ws):
    rows = [(i, f"Some words first. Please dial hotline +1 (415) 555-{1000 + i} for help number {i}.") for i in range(30)]
    rows += [(100, "Please dial hotline 555 0199 for help."), (101, "It cost 555 0199 in all, and 12 05 2024 was the day.")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ws).collect()}
    assert got[100]["spans"] == "phone:20:28" and got[100]["n_phone"] == 0
    assert got[5]["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(rows[5][1]))
    masked = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), ws).collect()}
    assert masked[100] == "Please dial hotline [PHONE] for help." and "[PHONE]" in masked[3]


def brute_bootstrap(rows):
    """The discovered (kind, instance), by the rule, over dictionaries."""
    edges, totals = collections.Counter(), collections.Counter()
    for _, text in rows:
        base = pii.base_spans(text)
        for seed, spans in ((True, base), (False, pii.candidates(text, base))):
            for start, end, kind in spans:
                left = re.findall(r"\w+", text[:start].lower())
                name = re.sub(r"[\W_]+", "", text[start:end].lower())
                for pattern in ([f"1 {left[-1]}"] if left else []) + ([f"2 {left[-2]} {left[-1]}"] if len(left) > 1 else []):
                    edges[kind, pattern, name, seed] += 1
        w = re.findall(r"\w+", text.lower())
        totals.update(f"1 {x}" for x in w)
        totals.update(f"2 {x} {y}" for x, y in zip(w, w[1:]))
    score = {(k, i): 1.0 for k, _, i, seed in edges if seed}
    while True:
        held, sure = collections.Counter(), collections.defaultdict(set)
        for (k, p, i, _), n in edges.items():
            held[k, p] += n * score.get((k, i), 0.0)
            if score.get((k, i), 0.0) >= 0.8:
                sure[k, p].add(i)
        confidence = {x: min(held[x] / max(totals[x[1]], held[x]), 0.999999) for x in sure if len(sure[x]) >= 3}
        doubt = collections.defaultdict(lambda: 1.0)
        for k, p, i, seed in edges:
            if not seed and (k, p) in confidence:
                doubt[k, i] *= 1 - confidence[k, p]
        new = {(k, i): 1.0 for k, _, i, seed in edges if seed}
        for x, d in doubt.items():
            new[x] = max(new.get(x, 0.0), 1 - d)
        if {x for x in new if new[x] >= 0.8} == {x for x in score if score[x] >= 0.8}:
            return {(k, i) for k, _, i, seed in edges if not seed and new.get((k, i), 0) >= 0.8}
        score = new


def test_discovered_identifiers_lead_to_others(spark, ws):
    """Two hops: seeds admit 'hotline', its other numbers admit 'switchboard', whose other numbers admit 'reception', which no seed ever follows."""
    rows = [(i, f"Please dial hotline +1 (415) 555-{1000 + i} now, number {i}.") for i in range(12)]
    rows += [(100 + i, f"Please dial hotline 555 {1000 + i} for help {i}.") for i in range(4)]
    rows += [(200 + i, f"Ask the switchboard 555 {1000 + i} at night {i}.") for i in range(4)]
    rows += [(300 + i, f"Ask the switchboard 555 {2000 + i} at night {i}.") for i in range(1)]
    rows += [(400 + i, f"Or try reception 555 {2000 + i} by day {i}, or try reception 555 {1000 + i}.") for i in range(4)]
    rows += [(500, "A batch of 12 05 2024 and of 555 7777 was made."), (501, "x" * 300 + " 555 1234567, ---- " + "-" * 90 + "555 9999")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ws.save(pii.scan(df, "text", []), "scanned")
    got = {(r["kind"], r["instance"]) for r in pii.bootstrap(df, found, "text", ws).collect()}
    assert got == brute_bootstrap(rows)
    assert {("phone", f"555{1000 + i}") for i in range(4)} | {("phone", f"555{2000 + i}") for i in range(4)} <= got and ("phone", "5557777") not in got


def test_contexts_are_whole_words():
    long = "supercalifragilistic" * 4
    assert pii.contexts(f"one {long} two: 555", len(f"one {long} two: ")) == ["1 two"]
    assert pii.contexts("x" * 500 + " call (555", 507) == ["1 call"]
    assert pii.contexts(f"{long} 555", len(long) + 1) == [] and pii.contexts("a5", 1) == [] and pii.contexts("555", 0) == []
    assert pii.contexts("call Us at: 555", 12) == ["1 at", "2 us at"] and pii.contexts("mid-word tel:555", 13) == ["1 tel", "2 word tel"]


def test_clean_numbers_stay(spark, ws):
    rows = [(i, f"the {i % 7} of +1 (415) 555-{1000 + i} and the rest of the words of the text") for i in range(30)] + [(99, "the day of 12 05 2024 and of 555 0199")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ws).collect()}
    assert got[99] == ""


def test_pii_of_awkward_rows(docs, nothing, ws):
    got = table(pii.find(docs, ws))
    assert len(got) == docs.count()
    nine = next(r for r in got if r["doc_id"] == 9)
    assert (nine["n_email"], nine["n_ip"], nine["n_card"], nine["n_phone"]) == (1, 1, 1, 1)
    assert nine["base_sha256"] == hashlib.sha256(nine["spans"].encode()).hexdigest()
    assert pii.find(nothing, ws).count() == 0 and pii.redact(nothing, ws).count() == 0
    back = pii.redact(docs, ws)
    assert back.columns == docs.columns and back.where("text is null").count() == 1


# --- repeated strings --------------------------------------------------------------------------------------------


def test_suffix_array():
    r = random.Random(10)
    for _ in range(1500):
        k = r.choice([1, 2, 3, 10])
        s = [r.randint(0, k) for _ in range(r.randint(0, 30))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_classes_come_from_the_array(monkeypatch):
    """Equal strings, and only they, are of one class, for every kind of text; without the order of the array they are not."""
    wrong = 0
    for seed in range(150):
        r = random.Random(seed)
        letters = r.choice(["ab ", "abcdefgh  .", "x", "xy", "ab\x00 ", "世界 ab", "世界人口"])
        base = ["".join(r.choice(letters) for _ in range(r.randint(60, 300))) for _ in range(5)]
        raws = [(r.choice(base)[: r.randint(0, 150)] + r.choice(base)[r.randint(0, 20) :]).encode() for _ in range(r.randint(1, 30))]
        raws = [x for x in raws if len(x) >= 100]
        if not raws:
            continue
        numbers = [r.randint(1, len(x) - 99) for x in raws]
        cut = [x[: k + 99] for x, k in zip(raws, numbers)]
        with monkeypatch.context() as m:
            for broken in (False, True):
                if broken:
                    m.setattr(substrings, "suffix_array", lambda s: np.random.default_rng(1).permutation(len(s)))
                piece, offset, classes = (x.tolist() for x in substrings.repeated_strings(cut, np.array(numbers)))
                pairs = {(cut[a][b : b + 100], c) for a, b, c in zip(piece, offset, classes)}
                often = collections.Counter(x[i : i + 100] for x, k in zip(cut, numbers) for i in range(k))
                found = {(a, b) for a, b in zip(piece, offset)}
                whole = all((a, i) in found for a, k in enumerate(numbers) for i in range(k) if often[cut[a][i : i + 100]] > 1)
                right = whole and len({x for x, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
                assert right or broken
                wrong += not right
    assert wrong > 20


def exact_removal(rows):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 99):
            piece = raw[s : s + 100]
            if piece in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(piece)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 4])
@pytest.mark.parametrize("seed", [11, 12])
def test_repeats_match_brute_force(spark, ws, seed, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(seed)
    shared = ["".join(r.choice("ab \n") if seed == 11 else r.choice("abcdefgh éü .") for _ in range(r.choice([99, 100, 101, 130, 260, 700]))) for _ in range(12)]
    rows = {}
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.5 else "".join(r.choice("abcdefghijklmnop  ") for _ in range(r.randint(0, 300))) for _ in range(r.randint(0, 5))]
        rows[i] = "".join(parts)
    rows[60] = rows[59]
    rows[61] = "x" * 450
    rows[62] = "xy" * 300
    rows[63] = " " * 250
    rows[64] = None
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.remove_repeats(df, ws).collect()}
    assert got == exact_removal(rows)


def test_repeats_of_awkward_rows(docs, nothing, ws):
    got = table(substrings.remove_repeats(docs, ws))
    assert len(got) == docs.count()
    by_id = {x["doc_id"]: x for x in got}
    assert by_id[1]["n_removed"] == by_id[1]["n_bytes"] > 0 and by_id[0]["n_removed"] == 0 and by_id[3]["n_bytes"] == 0
    assert substrings.remove_repeats(nothing, ws).count() == 0


# --- language model ----------------------------------------------------------------------------------------------


def held_range(n):
    """The least and the largest count that the model takes for n: itself up to 8, else its quarter of an octave."""
    if n <= 8:
        return n, n
    steps = [math.ceil(8 * 2 ** (i / 4)) for i in range(120)]
    return max(x for x in steps if x <= n), min(x for x in steps if x > n) - 1


@pytest.mark.parametrize("head", [1 << 21, 8])
def test_scores(spark, ws, head):
    r = random.Random(13)
    texts = {i: " ".join(r.choice(["The", "cat", "sat", "on", "a", "mat", f"w{r.randint(0, 300)}"]) for _ in range(r.randint(0, 40))) for i in range(150)}
    texts[150] = None
    got = {x["doc_id"]: x for x in lmscore.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ws, bits=1 << 24, head_words=head).collect()}
    tokens = {i: [w.lower() for w in words(t)] + ["\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one, two = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            one.update(t)
            two.update(zip(["\n", *t], t))
    total, distinct = sum(one.values()), len(one)

    for i, t in tokens.items():
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(t), sum(one[w] > 0 for w in t), total)
        assert math.isclose(x["base_score"], sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in t), rel_tol=1e-9)
        score = 0.0
        for h, w in zip(["\n", *t], t):
            own = (held_range(one[w])[0] + 1) / (total + distinct + 1)
            score += math.log10(0.6 * held_range(two[h, w])[0] / held_range(one[h])[1] + 0.4 * own if one[h] else own)
        assert math.isclose(x["score"], score, rel_tol=1e-6)


def test_scores_of_awkward_rows(docs, nothing, ws):
    assert lmscore.score(docs, ws, bits=1 << 24).count() == docs.count()
    assert lmscore.score(nothing, ws, bits=1 << 24).count() == 0


def test_query_enters_pairs_seen_once(spark, tmp_path):
    texts = {i: f"left{i} right{i}" for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.QUERIES["op8_lm_score"](spark, str(tmp_path)).collect()}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    total, distinct, ends = 3 * len(learned), 2 * len(learned) + 1, held_range(len(learned))
    own = 2 / (total + distinct + 1)
    expected = math.log10(0.6 / ends[1] + 0.4 * own) + math.log10(0.6 + 0.4 * own) + math.log10(0.6 + 0.4 * (ends[0] + 1) / (total + distinct + 1))
    assert all(math.isclose(got[i]["score"], expected, rel_tol=1e-6) for i in learned)


def test_filter_follows_its_entries():
    for n in (10, 1000, 300_000):
        keys = lmscore.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
        counts = np.arange(n) % 5 + 1
        mask = lmscore.segment_mask(keys[:n], counts)
        assert np.unpackbits(mask).mean() < 0.25
        got = lmscore.probe(mask, keys)
        assert (got[:n] == lmscore.level(counts)).mean() > 0.98 and (got[n:] == 0).mean() > 0.98


def test_probabilities_sum_to_at_most_one():
    """For every history, with one word for all that training has not; and to nearly one, so that little is given away."""
    r = np.random.default_rng(3)
    counts = (r.zipf(1.4, (60, 60)) - 1).astype(np.int64)
    counts[counts > 10**6] = 10**6
    one = counts.sum(axis=0)
    total, distinct = int(one.sum()), int((one > 0).sum())
    left = counts.sum(axis=1)
    for h in range(60):
        words_of = np.append(one[one > 0], 0)
        pair = np.append(counts[h][one > 0], 0)
        p = 10 ** lmscore.log10_share(lmscore.level(pair), np.full(len(pair), lmscore.level(left[h : h + 1])[0]), lmscore.level(words_of), total, distinct)
        assert 0.6 < p.sum() <= 1 + 1e-12
    edge = np.array([0, 1, 8, 9, 10, 11, 12, 1 << 40, 1 << 47])
    levels = lmscore.level(edge)
    assert (lmscore.LEAST[levels] <= edge).all() and (edge < lmscore.LEAST[levels + 1]).all() and (np.diff(lmscore.LEAST) > 0).all()


# --- quality -----------------------------------------------------------------------------------------------------


def exact_quality(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, nothing, ws):
    r = random.Random(14)
    rows = [(i, "\n".join(" ".join(r.choice(["a", "b", "c#", "d*", "é"]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 12))), "s", 0, 0) for i in range(200)]
    df = docs.where("doc_id is not null").unionByName(spark.createDataFrame(rows, docs.schema).withColumn("doc_id", F.col("doc_id") + 100))
    text = {x["doc_id"]: x["text"] for x in df.collect()}
    for x in quality.quality_rules(df, ws).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == exact_quality(text[x["doc_id"]])
    assert quality.quality_rules(nothing, ws).count() == 0


def test_frequent_lines(spark, ws):
    r = random.Random(15)
    own = lambda: " ".join(f"u{r.randint(0, 10**9)}" for _ in range(30))
    boiler = "Read our terms and our cookie notice before you go on with this page of ours, and click here to agree"
    footer = "All rights are reserved by the owners of this site who wrote every page that you may see on it today or later"
    rows = [(i, f"{own()}\n{boiler}\n{own()}\n{footer}", "h") for i in range(40)]
    rows += [(50, f"{boiler}\n  ALL rights  are reserved by the owners of this site who wrote every page that you may see on it today or later", "h")]
    rows += [(60 + i, "one text with its own line, copied many times over, as whole documents often are, so no line of it is common here", "h") for i in range(30)]
    rows += [(99, f"{boiler} at another host, where no other document has such a line at all, so it must stay as it is", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in quality.quality_rules(df, ws, with_text=True).collect()}
    assert not got[50]["kept"] and not got[50]["base_failed"]
    assert got[0]["kept"] and boiler not in got[0]["kept_text"] and got[0]["lost_words"] == len(words(boiler)) + len(words(footer))
    assert not any(got[60 + i]["kept"] for i in range(30)) and got[99]["kept"]
    texts = {x["doc_id"]: x for x in quality.quality_rules(df, ws, distinct_texts=True).collect()}
    assert all(texts[60 + i]["kept"] for i in range(30)) and texts[0]["lost_words"] == got[0]["lost_words"]


@pytest.mark.parametrize("rows_at_once", [100_000, 0])
def test_line_limits_match_brute_force(spark, ws, rows_at_once, monkeypatch):
    """Documents, not rows or texts, are counted; a repeated row is one document; both ways of joining agree."""
    monkeypatch.setattr(quality, "sized_join", lambda a, b, on, how="inner": common.sized_join(a, b, on, how, rows_at_once))
    r = random.Random(16)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 6))) for _ in range(25)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own {i} {j}" for j in range(r.randint(0, 8))), r.choice(["p", "q", None])) for i in range(120)]
    rows += [rows[3]] * 30 + [(None, "null ids are told apart\nby text", "p")] * 12
    have = collections.defaultdict(set)
    line = lambda x: " ".join(words(x)).lower()
    for i, t, s in rows:
        for x in t.split("\n"):
            if words(x):
                have[s, line(x)].add(i if i is not None else t)
    expected = collections.Counter((i, s, sum(len(words(x)) for x in t.split("\n") if words(x) and len(have[s, line(x)]) > quality.MAX_DOCS)) for i, t, s in rows)
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), ws, keep=["doc_id", "source"]).collect()
    assert collections.Counter((x["doc_id"], x["source"], x["lost_words"]) for x in got) == expected


# --- shared parts, queries, pipeline -----------------------------------------------------------------------------


def test_bloom(spark):
    mask = np.frombuffer(bloom_build(spark.range(0, 3000, 3).withColumn("id", F.xxhash64("id")), "id", 1 << 16), dtype=np.uint8)
    keys = np.array([r[0] for r in spark.range(3000).select(F.xxhash64("id")).collect()], dtype=np.int64)
    got = bloom_test(mask, keys)
    assert got[::3].all() and got.mean() < 0.4


def test_every_query_covers_its_table(spark, sf):
    n = documents(spark, sf).count()
    for name in ("op1_near_duplicates", "op4_mixing", "op5_sharding", "op6_pii", "op8_lm_score", "op9_quality"):
        assert queries.QUERIES[name](spark, sf).count() == n, name


def test_pipeline(spark, docs, nothing, sf):
    import corpus_pipeline as pipeline

    for rows in (docs, nothing):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns, name
            out.count()
    kept = pipeline.quality_stage(spark, docs, sf)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if r["text"] and not exact_quality(r["text"])[-1]}
    alone = pipeline.near_dedup_stage(spark, docs, sf)
    assert sorted((r["doc_id"] for r in alone.collect()), key=lambda i: (i is None, i)) == [0, 3, 4, 5, 6, 7, 8, 9, None]
    assert "bob@example.com" not in " ".join(r["text"] or "" for r in pipeline.pii_stage(spark, docs, sf).collect())
    last = pipeline.run(spark, sf)
    assert last.count() > 0 and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}


def test_clashing_names(spark, docs, ws):
    """Columns that are called as what the operators make, or as they call things inside, keep their values in every stage and operator."""
    import corpus_pipeline as pipeline

    made = {*mixing.MADE, *quality.MADE, *pii.MADE, "ids", "component_id", "n_shingles", "lines", "rows", "n", "m", "edge", "start", "node", "group", "label", "digest", "key", "batch", "kind", "data", "more", "id", "__k0", "__k1", "__t", "__text", "__source", "__host", "__d1", "__copies", "__copy", "__weight", "a.b", "tick`s"}
    plain = docs.drop("n").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    many = plain.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in sorted(made)])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, many, "")
        assert out.columns == many.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c} {r['doc_id']}" for c in made), name
    assert pipeline.bpe_stage(spark, many, "").count() == many.count()
    mixed = mixing.mix(many, ws)
    assert mixed.columns[: len(many.columns)] == many.columns and mixed.columns[len(many.columns) :] == [f"made_{c}" for c in mixing.MADE]
    judged = quality.quality_rules(many, ws, keep=["doc_id", "kept", "n_words"])
    assert {"kept", "made_kept", "n_words", "made_n_words", "lost_words"} <= set(judged.columns) and {r["kept"] for r in judged.collect()} == {f"kept {r['doc_id']}" for r in judged.collect()}
    found = pii.find(many, ws, keep=["doc_id", "spans"])
    assert {"spans", "made_spans", "n_email"} <= set(found.columns) and found.where("spans <> concat('spans ', doc_id)").count() == 0
    for f in (neardup.near_duplicates, media.media_round_trip, substrings.remove_repeats, lmscore.score, tokenstore.token_round_trip, sharding.shard):
        assert f(many, ws).count() == many.count(), f


def test_texts_longer_than_a_batch(spark, ws):
    """One text of 5 MB beside short ones, and twice: each operator gives whole results."""
    import public_tokenizers
    import tiktoken

    r = random.Random(31)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(680_000))
    assert len(long) > 5 << 20 > 4 << 20
    texts = {0: "short text of a few words", 1: long, 2: long + " end", 3: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    raw = {i: (t or "").encode() for i, t in texts.items()}
    near = {x["doc_id"]: x for x in neardup.near_duplicates(df, ws).collect()}
    assert near[2]["component_id"] == 1 and near[1]["n_shingles"] == len({tuple(p) for p in zip(words(long), words(long)[1:])})
    assert {x["doc_id"]: x["n_bytes"] for x in media.media_round_trip(df, ws).collect()} == {i: len(x) for i, x in raw.items()}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = {x["doc_id"]: x for x in bpe.round_trip(df).collect()}
    assert coded[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, reference.encode_ordinary(long))).encode()).hexdigest() and coded[2]["decoded_sha256"] == hashlib.sha256(raw[2]).hexdigest()
    gone = {x["doc_id"]: x for x in substrings.remove_repeats(df, ws).collect()}
    assert (gone[1]["n_removed"], gone[2]["n_removed"], gone[2]["n_spans"]) == (0, len(raw[1]), 1)
    scored = {x["doc_id"]: x for x in lmscore.score(df, ws).collect()}
    assert scored[1]["n_tokens"] == len(words(long)) + 1 and scored[3]["n_tokens"] == 1
    assert {x["doc_id"]: x["n_words"] for x in quality.quality_rules(df.withColumn("source", F.lit("s")), ws).collect()} == {i: len(words(t)) for i, t in texts.items()}
    stored = {x["doc_id"]: x["n_tokens"] for x in tokenstore.token_round_trip(df, ws).collect()}
    assert stored[3] == 1 and stored[2] > stored[1] > 600_000
    assert {x["doc_id"]: x["spans"] for x in pii.find(df, ws).collect()} == dict.fromkeys(texts, "")
