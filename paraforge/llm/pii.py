"""Personal data: base patterns, and contextual extraction bootstrapped from what they find (operator 6)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Workspace, bloom_build, bloom_test, byte_budget, byte_texts, column, free_names, sized_join, whole

#: The kinds in order, and what stands for each in a redacted text.
KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Each search begins at a run's first digit, and no run is tried twice, so that long runs cost their length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each base match, by start, then kind in the order of KINDS."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


#: The columns that find() adds.
MADE = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "text_key", "discovered"]

#: What may be an identifier that no base pattern takes, by kind. Only contexts decide whether it is one.
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{2,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])[0-9]{4}(?:[ -]?[0-9]{2,6}){2,4}(?![0-9A-Za-z-])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])"),
}
#: A context's words are runs of word characters, at most so long, and so many other characters stand between them and the span at most.
LONGEST = 64
_LEFT = re.compile(rf"(?<!\w)(?:(\w{{1,{LONGEST}}})\W{{1,{LONGEST}}})?(?<!\w)(\w{{1,{LONGEST}}})\W{{0,{LONGEST}}}\Z")
_WORDS = re.compile(r"\w+").findall


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what has an identifier's shape outside the base spans, without overlaps within a kind."""
    out = []
    for kind, shape in _SHAPES.items():
        if kind == "email" and not ("at)" in text or "at]" in text or "at}" in text):
            continue
        for m in shape.finditer(text):
            digits = len(_NOT_DIGIT.sub("", m[0]))
            if kind == "card" and not 12 <= digits <= 19 or kind == "phone" and not 7 <= digits <= 11:
                continue
            if all(m.end() <= a or m.start() >= b for a, b, _ in base):
                out.append((m.start(), m.end(), kind))
    return out


def contexts(text: str, start: int) -> list[str]:
    """The lexical patterns that a span's left side makes: the word before it, and the two words before it. All are whole words."""
    window = text[max(0, start - 4 * LONGEST - 1) : start]
    if window[-1:].isalnum() or window[-1:] == "_":
        return []  # the span begins inside a word
    m = _LEFT.search(window)
    if m is None:
        return []
    one, two = m[2].lower(), m[1]
    return [f"1 {one}"] + ([f"2 {two.lower()} {one}"] if two else [])


def hashed(pattern: str) -> int:
    return int.from_bytes(hashlib.blake2b(pattern.encode(), digest_size=8).digest(), "little", signed=True)


def with_hashes(patterns: DataFrame) -> DataFrame:
    """(pattern, pattern_hash): one call for each pattern of the graph, not for each row of the corpus."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(p) for p in batch.column(0).to_pylist()], pa.int64())], ["pattern", "pattern_hash"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, pattern_hash long")


def instance(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


OCCURRENCE = "array<struct<start:int,end:int,kind:string,instance:string,patterns:array<string>>>"


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """For each row: keep, as __k0, __k1 ..., the text's key, the base spans, the counts, and base and candidate occurrences with contexts."""
    rows = docs.select(*[column(c).alias(f"__k{i}") for i, c in enumerate(keep)], whole(column(text)).alias("__text"))
    n = len(keep)
    names = [f"__k{i}" for i in range(n)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for batch in byte_budget(batches, n):
            digests, spans, seeds, maybe = [], [], [], []
            counts: list[list[int]] = [[] for _ in KINDS]
            for raw in byte_texts(batch.column(n)):
                t = raw.decode()
                base = base_spans(t)
                describe = lambda found, t=t: [{"start": a, "end": b, "kind": k, "instance": instance(t[a:b]), "patterns": contexts(t, a)} for a, b, k in found]
                digests.append(hashlib.sha256(raw).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in base))
                seeds.append(describe(base))
                maybe.append(describe(candidates(t, base)))
                for own, k in zip(counts, KINDS, strict=True):
                    own.append(sum(x[2] == k for x in base))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(digests, pa.string()), pa.array(spans, pa.string()), *[pa.array(c, pa.int64()) for c in counts], pa.array(seeds, kind), pa.array(maybe, kind)],
                [*names, "text_key", "base", *[f"n_{k}" for k in KINDS], "seeds", "maybe"],
            )

    schema = StructType([rows.schema[c] for c in names])
    for name in ("text_key string", "base string", *[f"n_{k} long" for k in KINDS], f"seeds {OCCURRENCE}", f"maybe {OCCURRENCE}"):
        schema = StructType([*schema.fields, *StructType.fromDDL(name).fields])
    return rows.mapInArrow(run, schema)


#: Bits of the filter of seeded patterns (2 MB to every worker, whatever the corpus).
FILTER_BITS = 1 << 24
#: Different confident instances that a pattern needs, and the confidence from which an instance is one.
MIN_SEEDS, CONFIDENT = 3, 0.8


def pattern_totals(docs: DataFrame, text: str, seeded: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern's words stand in the corpus, before anything at all.

    Words are matched to a filter of the seeded patterns first, counted for each batch, and joined exactly at the end."""
    hashes = seeded.select("pattern", F.col("pattern_hash"))
    mask = docs.sparkSession.sparkContext.broadcast(bloom_build(hashes, "pattern_hash", FILTER_BITS))
    rows = docs.select(whole(F.col(text)).alias("__text"))

    def run(batches):
        from collections import Counter

        bits = np.frombuffer(mask.value, dtype=np.uint8)
        for batch in byte_budget(batches, 0):
            one: Counter = Counter()
            two: Counter = Counter()
            for raw in byte_texts(batch.column(0)):
                words = _WORDS(raw.decode().lower())
                one.update(words)
                two.update(zip(words, words[1:]))
            singles = [(f"1 {w}", n) for w, n in one.items()]
            known = np.array([hashed(p) for p, _ in singles], dtype=np.int64)
            kept = [singles[i] for i in np.flatnonzero(bloom_test(bits, known))] if len(known) else []
            #: A pattern of two words is there only with that of its last word.
            last = {p[2:] for p, _ in kept}
            pairs = [(f"2 {a} {b}", n) for (a, b), n in two.items() if b in last]
            known = np.array([hashed(p) for p, _ in pairs], dtype=np.int64)
            kept += [pairs[i] for i in np.flatnonzero(bloom_test(bits, known))] if len(known) else []
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["pattern", "n"])

    counts = rows.mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counts.join(hashes.select("pattern"), "pattern")


def bootstrap(docs: DataFrame, found: DataFrame, text: str, ws: Workspace, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """(kind, instance): identifiers that no base pattern takes and that confident contexts single out.

    Edges link patterns (a kind and its left words) to instances, with counts. A seed's confidence is 1. In each round a
    pattern's confidence is the confidence-weighted share of its occurrences in the whole corpus that hold an instance of
    its kind; it needs min_seeds different instances of confidence, be they seeds or discovered ones. An instance's confidence
    is 1 minus the product of its patterns' doubts. Discovered instances so admit new patterns, whose instances
    admit others, until a round changes neither the patterns nor the instances of confidence. Both only ever grow.
    Patterns that common words make have low shares and find nothing."""
    occurrence = lambda column, seed: found.select(F.explode(column).alias("o")).select("o.kind", "o.instance", F.explode("o.patterns").alias("pattern"), F.lit(seed).alias("seed"))
    edges = occurrence("seeds", True).unionByName(occurrence("maybe", False)).groupBy("kind", "pattern", "instance", "seed").agg(F.count(F.lit(1)).alias("n"))
    edges = ws.save(edges, "edges")
    #: What no round can admit goes: patterns with too few instances of any confidence, and those that precede no candidate and so lead nowhere.
    able = edges.groupBy("kind", "pattern").agg(F.countDistinct("instance").alias("m"), F.min("seed").alias("seeds_only")).where((F.col("m") >= min_seeds) & ~F.col("seeds_only"))
    able = ws.save(able.select("kind", "pattern"), "able")
    edges = ws.save(edges.join(able, ["kind", "pattern"], "left_semi"), "live_edges")
    totals = ws.save(pattern_totals(docs, text, with_hashes(able.select("pattern").distinct())), "totals")
    known = edges.where("seed").select("kind", "instance", F.lit(1.0).alias("score")).distinct()
    scores, before, i = known, None, 0
    while True:
        weighed = edges.join(scores, ["kind", "instance"])
        patterns = weighed.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("score")).alias("held"), F.countDistinct(F.when(F.col("score") >= confident, F.col("instance"))).alias("m"))
        patterns = patterns.where(F.col("m") >= min_seeds).join(totals, "pattern").withColumn("confidence", F.least(F.col("held") / F.greatest(F.col("total"), F.col("held")), F.lit(0.999999)))
        patterns = ws.save(patterns, f"patterns_{i}")
        doubt = edges.where("NOT seed").join(patterns.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        scores = ws.save(known.unionByName(doubt).groupBy("kind", "instance").agg(F.max("score").alias("score")), f"scores_{i}")
        after = (patterns.count(), scores.where(F.col("score") >= confident).count())
        ws.drop(f"patterns_{i}", f"scores_{i - 1}")
        if after == before:
            break
        before, i = after, i + 1
    unseen = edges.where("NOT seed").select("kind", "instance").distinct()
    return ws.save(scores.where(F.col("score") >= confident).select("kind", "instance").join(unseen, ["kind", "instance"], "left_semi"), "discovered")


def discovered(docs: DataFrame, found: DataFrame, text: str, ws: Workspace, **settings) -> DataFrame:
    """(text_key, discovered): the spans of discovered identifiers, for the texts that have some."""
    chosen = bootstrap(docs, found.select("seeds", "maybe"), text, ws, **settings)
    texts = found.where(F.size("maybe") > 0).select("text_key", "maybe").dropDuplicates(["text_key"])
    extra = texts.select("text_key", F.explode("maybe").alias("o")).select("text_key", "o.*").join(chosen, ["kind", "instance"])
    return ws.save(extra.groupBy("text_key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("discovered")), "extra")


def find(docs: DataFrame, ws: Workspace, text: str = "text", keep: list[str] | None = None, **settings) -> DataFrame:
    """For each row: keep, n_email, n_ip, n_card, n_phone, base_sha256, spans, text_key, discovered; where keep has a column of such a
    name, the made one is called made_<name>.

    spans holds the base spans and the discovered ones as kind:start:end by start, then kind, then end; discovered ones
    never overlap base ones. A null or empty text has none. Repeated rows each get a row; an empty table gives an empty
    one. Spans are found in the row; only occurrences of identifiers are ever shuffled."""
    keep = keep if keep is not None else ["doc_id"]
    made = free_names(keep, MADE)
    found = ws.save(scan(docs, text, keep), "found")
    extra = discovered(docs, found, text, ws, **settings)
    rows = sized_join(found, extra, "text_key", "left")
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    line = lambda o: F.struct(o["start"].alias("start"), rank(o["kind"]).alias("rank"), o["end"].alias("end"), o["kind"].alias("kind"))
    everything = F.sort_array(F.concat(F.transform("seeds", line), F.transform("discovered", line)))
    written = F.array_join(F.transform(everything, lambda o: F.concat_ws(":", o["kind"], o["start"].cast("string"), o["end"].cast("string"))), ",")
    own = {"base_sha256": F.sha2("base", 256), "spans": F.when(F.col("discovered").isNull(), F.col("base")).otherwise(written)}
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *[own.get(c, F.col(c)).alias(made[c]) for c in MADE])


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind's mask; of overlapping spans the first, then the longest, names the mask."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], MASKS[kind]]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, ws: Workspace, text: str = "text", **settings) -> DataFrame:
    """docs with every base and discovered span of the text masked; a null text stays null and an empty one empty; equal texts are
    masked alike, so repeated rows and ties stay what they are; an empty table gives an empty one; other columns keep their values.

    Base spans are found again in the row; only texts with discovered spans are looked up, by the digest of the text."""
    names = docs.columns
    found = ws.save(scan(docs, text, []).where("size(seeds) > 0 OR size(maybe) > 0").select("text_key", "seeds", "maybe"), "found")
    extra = discovered(docs, found, text, ws, **settings)
    inner = docs.select(*[column(c).alias(f"__k{i}") for i, c in enumerate(names)])
    at = names.index(text)
    keyed = inner.withColumn("text_key", F.sha2(whole(F.col(f"__k{at}")), 256))
    keyed = sized_join(keyed, extra.withColumnRenamed("discovered", "__discovered"), "text_key", "left").select(*inner.columns, "__discovered")

    def run(batches):
        for batch in byte_budget(batches, at):
            texts = []
            for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                texts.append(t if t is None else masked(t, base_spans(t) + [(x["start"], x["end"], x["kind"]) for x in more or ()]))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, [f"__k{i}" for i in range(len(names))])

    out = keyed.mapInArrow(run, StructType([keyed.schema[f"__k{i}"] for i in range(len(names))]))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)])

