"""Sharding by balanced label propagation over linked documents (operator 5, native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, accept_within, hash_unit, numbered, whole

SHARDS, ROUNDS = 40, 8


def _by_shard(spark: SparkSession, values: list[int], shard: str, name: str) -> DataFrame:
    """A row for each shard with its value; made by the JVM, so without Python workers."""
    return spark.range(len(values)).select(F.col("id").cast("int").alias(shard), F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("id").cast("int")).alias(name))


def propagate(pieces: DataFrame, quota: list[int], ws: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """pieces (link, home, n) with a column shard: where each piece ends.

    A piece is what one group of linked documents has in one home shard, so a group has as many pieces as there are
    shards at most, and its moves cost by pieces, not by documents or pairs. In each round every piece asks to move
    to the shard with most of its group among those with room; requests are granted in random order while they
    fit the room that the shard has left. It ends when no request is granted. A piece moves as a whole: where all rows are
    linked and no shard has room for it, it stays where it is."""
    n_shards = len(quota)
    pieces = ws.save(pieces.withColumn("shard", F.col("home")), "pieces_0")
    for i in range(rounds):
        load = {r["shard"]: r["n"] for r in pieces.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        rooms = _by_shard(ws.spark, [quota[s] - load.get(s, 0) for s in range(n_shards)], "shard", "room")
        here = pieces.groupBy("link", "shard").agg(F.sum("n").alias("here"))
        preference = F.struct("here", F.xxhash64("link", "shard").alias("tie"), "shard")
        scored = ws.save(here.withColumn("score", preference), f"scored_{i}")
        best = scored.join(F.broadcast(rooms.where("room > 0")), "shard").groupBy("link").agg(F.max("score").alias("best"))
        asked = pieces.join(scored.select("link", "shard", "score"), ["link", "shard"]).join(best, "link", "left")
        wants = F.coalesce(F.col("best") > F.col("score"), F.lit(False)) & F.col("best").isNotNull()
        asked = ws.save(asked.select("link", "home", "n", "shard", F.when(wants, F.col("best.shard")).alias("target"), hash_unit(F.col("link"), F.col("home"), F.lit(i)).alias("rank")), f"asked_{i}")
        moving = asked.where("target IS NOT NULL")
        #: Half of what asks to leave a shard counts as room there too; what turns out too much is dealt out again at the end.
        leaving = {r["shard"]: r["n"] for r in moving.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        rooms = _by_shard(ws.spark, [max(0, quota[s] - load.get(s, 0) + leaving.get(s, 0) // 2) for s in range(n_shards)], "target", "room")
        granted = accept_within(moving, rooms, "target", "rank", ["link", "home"], "n", "room", ws, f"grant_{i}")
        moved = granted.select("link", "home", "n", F.when(F.col("accepted"), F.col("target")).otherwise(F.col("shard")).alias("shard"), "accepted")
        still = asked.where("target IS NULL").select("link", "home", "n", "shard", F.lit(False).alias("accepted"))
        after = ws.save(still.unionByName(moved), f"pieces_{i + 1}")
        done = not after.where("accepted").limit(1).count()
        pieces = after.drop("accepted")
        ws.drop(f"scored_{i}", f"asked_{i}", f"pieces_{i}")
        if done:
            break
    return pieces


def cut_edges(placed: DataFrame, link: str, shard: str = "shard") -> DataFrame:
    """(edges, cut): how many pairs of linked rows there are, and how many of them are in two shards. From counts, not from pairs."""
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long")
    counts = placed.groupBy(link, shard).agg(F.count(F.lit(1)).alias("n"))
    inside = counts.groupBy(link).agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    return inside.agg(pairs(F.col("all")).alias("edges"), (pairs(F.col("all")) - F.coalesce(F.sum("inside"), F.lit(0.0)).cast("long")).alias("cut"))


def shard(docs: DataFrame, ws: Workspace, shards: int = SHARDS, text: str = "text", link: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Rows of equal `link` (by default: of equal text, null as empty) are linked. Linked documents start in a shard that a hash of
    doc_id names and are then moved by propagate(); documents without links fill the places that are left. Each
    shard gets floor or ceil of rows / shards rows exactly, and slots are gapless from 0. A group that is larger
    than a shard is split over several. A null text is an empty one, and both are linked; a null doc_id starts in a shard of its own
    hash; repeated rows are rows of their own, and which of two gets which slot is open; other columns are not looked at; an empty
    table gives an empty one."""
    t = whole(F.col(text))
    size = (F.octet_length(t) + 16).cast("long")
    group = F.sha2(t, 256) if link is None else F.coalesce(F.col(f"`{link}`").cast("string"), F.concat(F.lit("null:"), F.sha2(t, 256)))
    light = docs.select("doc_id", size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), group.alias("link"))
    u = hash_unit(F.col("doc_id"), F.lit("place"))
    light = ws.save(light.withColumn("u", u).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")), "light")
    total = light.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = light.groupBy("link", "home").agg(F.count(F.lit(1)).alias("n"))
    linked = pieces.groupBy("link").agg(F.sum("n").alias("all")).where("all > 1").select("link")
    pieces = propagate(pieces.join(linked, "link"), quota, ws)
    placed = light.join(pieces.select("link", "home", "shard"), ["link", "home"], "left")
    placed = ws.save(placed, "placed")
    tie = ["doc_id", "text_crc32", "size"]
    columns = ["doc_id", "size", "text_crc32", "u"]
    first = numbered(placed.where("shard IS NOT NULL").select(*columns, "shard"), "shard", "u", tie, "slot", ws, "linked")
    quotas = _by_shard(ws.spark, quota, "shard", "quota")
    first = ws.save(first.join(F.broadcast(quotas), "shard"), "first")
    fits = first.where("slot < quota").select(*columns, "shard", "slot")
    #: What has no links, and what passes a shard's quota, is dealt into the free places in random order.
    pool = placed.where("shard IS NULL").select(*columns).unionByName(first.where("slot >= quota").select(*columns))
    pool = ws.save(pool.withColumn("all", F.lit(0)), "pool")
    load = {r["shard"]: r["n"] for r in fits.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, at = [], 0
    for s in range(shards):
        at += quota[s] - load.get(s, 0)
        ends.append(at)
    end_array = F.array(*[F.lit(x).cast("long") for x in ends])
    dealt = numbered(pool, "all", "u", tie, "rank", ws, "pool")
    to = F.size(F.filter(end_array, lambda x: x <= F.col("rank"))).cast("int")
    offsets = F.array(*[F.lit(load.get(s, 0) - (ends[s - 1] if s else 0)).cast("long") for s in range(shards)])
    dealt = dealt.withColumn("shard", to).withColumn("slot", F.col("rank") + F.element_at(offsets, F.col("shard") + 1)).select(*columns, "shard", "slot")
    out = fits.unionByName(dealt)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
