"""Mixing sources to target weights by Pareto order sampling (operator 4, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, column, cut_within, free_names, hash_unit, numbered, sized_join, source_key, whole, words

#: Weights of the sources in order, repeating; the mix's share (%) of all sizes; most times a source or document is taken.
WEIGHTS, MIX_PERCENT, MOST = (3, 1, 2), 150, 2
SEED = 20240
#: A document's weight in its source's draw: 100, and 100 more for each mean size of the source that it has, up to this.
MOST_WEIGHT = 400
#: The columns that mix() adds.
MADE = ["size", "source_size", "target", "copies"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = MIX_PERCENT, most: int = MOST) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size), one row for each source.

    Targets are weight * t, stopped at most * source_size, where t is such that they sum up to percent of all sizes.
    Sources are stopped in the order of size / weight; t is found from prefix sums over that order, as one quotient
    of integers, so that the result is the same wherever it is computed. The ranks run over the table of sources, not of rows."""
    everything = W.partitionBy()
    position = F.row_number().over(W.orderBy("source_key")) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (position % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    by_cap = W.orderBy((F.col("cap") / F.col("weight")), "source_key").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("caps", F.coalesce(F.sum("cap").over(by_cap), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
    #: Numerator and denominator of t if exactly the sources before this one are stopped.
    up, down = percent * F.col("all_size") - 100 * F.col("caps"), 100 * (F.col("all_weight") - F.col("gone"))
    ranked = ranked.withColumn("up", up).withColumn("down", down).withColumn("free", F.col("weight") * F.col("up") <= F.col("cap") * F.col("down"))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("free"), F.struct("gone", "up", "down"))).over(everything))
    stopped = F.col("level").isNull() | (F.col("gone") < F.col("level.gone"))
    target = F.when(stopped, F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("level.up")).cast("double") / F.col("level.down").cast("double"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, ws: Workspace, text: str = "text", source: str = "source", seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies; where docs has a column of such a name, the made one is called made_<name>.

    A source's target is target / source_size times its size. The whole part of that is certain for each of its documents. The
    rest is drawn without replacement and with unequal probabilities: longer documents are likelier. A document's inclusion
    probability p is rest * w / sum(w * size), where its weight w is by default 100 + 100 * size / mean size, at most MOST_WEIGHT, so that the
    words expected are the rest. Documents are ranked by the random odds u / (1 - u) divided by the inclusion odds p / (1 - p),
    where u is a hash of doc_id, and are taken in that order until the words that remain of the target are reached, to half
    a document. `weight`, a positive column, takes the place of w.

    A null text has size 0; a null source is a source of its own, after all others; a document without words is only
    taken as whole copies. Where doc_id is null, the text takes its place in the hash. Of repeated rows at the end of a draw only as
    many are taken as fit. The result depends on the rows alone, not on their partitioning (but for which of two repeated rows it
    is). An empty table gives an empty one. Columns of docs keep their values."""
    names = docs.columns
    made = free_names(names, MADE)
    kept = [column(c).alias(f"__k{i}") for i, c in enumerate(names)]
    own = [
        source_key(F.col(source)).alias("__source"),
        F.size(words(F.col(text))).cast("long").alias("__size"),
        hash_unit(F.coalesce(F.col("doc_id").cast("string"), F.md5(whole(F.col(text)))), F.lit(seed)).alias("__u"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"),
        *([weight.cast("double").alias("__given")] if weight is not None else []),
    ]
    light = ws.save(docs.select(*own), "light")
    sizes = ws.save(light.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__docs")), "source_sizes")
    weighed = sized_join(light, sizes, "__source").groupBy("__source").agg(F.sum(_weight(weight) * F.col("__size")).alias("__weights"))
    plan = source_targets(sizes.select(F.col("__source").alias("source_key"), "source_size")).withColumnRenamed("source_key", "__source")
    plan = plan.join(sizes.select("__source", "__docs"), "__source").join(weighed, "__source")
    plan = plan.withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = ws.save(plan.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")), "plan")
    live = _ranked(sized_join(light, plan, "__source"), weight).where("__size > 0 AND __rest > 0").select("__source", "__size", "__q", "__id")
    cut = cut_within(live, plan.where("__rest > 0"), "__source", "__q", ["__id", "__size"], "__size", "__rest", ws, "mix")
    #: Of m equal rows at the end of the draw as many as end within the rest, the last one to half.
    taken = F.least(F.greatest(F.floor((F.col("__rest") - F.col("start")) / F.col("edge.__size") + 0.5), F.lit(0)), F.col("m"))
    plan = ws.save(plan.join(cut, "__source", "left").withColumn("__taken", taken), "plan_with_cut")
    full = _ranked(sized_join(docs.select(*kept, *own), plan, "__source"), weight)
    place = F.struct("__q", "__id", "__size")
    can = (F.col("__size") > 0) & (F.col("__rest") > 0)
    before = F.col("edge").isNull() | (place < F.col("edge")) | ((place == F.col("edge")) & (F.col("__taken") >= F.col("m")))
    full = full.withColumn("__chosen", can & before)
    if plan.where("__taken > 0 AND __taken < m").limit(1).count():
        tied = F.coalesce(can & (place == F.col("edge")) & (F.col("__taken") > 0) & (F.col("__taken") < F.col("m")), F.lit(False))
        rows = ws.save(full.where(tied).withColumn("__row", F.monotonically_increasing_id()).withColumn("__lot", hash_unit(F.col("__row"))), "tied")
        some = numbered(rows, "__source", "__lot", ["__row"], "__number", ws, "tied_rows").withColumn("__chosen", F.col("__number") < F.col("__taken"))
        full = full.where(~tied).unionByName(some.select(*full.columns))
    return full.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)],
        F.col("__size").alias(made["size"]), F.col("source_size").alias(made["source_size"]), F.col("target").alias(made["target"]), (F.col("__whole") + F.col("__chosen").cast("long")).alias(made["copies"]),
    )


def _weight(weight: Column | None) -> Column:
    if weight is not None:
        return F.col("__given")
    mean = F.col("source_size").cast("double") / F.col("__docs").cast("double")
    return F.least(F.lit(100) + F.coalesce(F.floor(F.lit(100.0) * F.col("__size") / mean), F.lit(0)), F.lit(MOST_WEIGHT)).cast("long")


def _ranked(df: DataFrame, weight: Column | None) -> DataFrame:
    """Adds __q, the Pareto rank on a scale where documents of their source's own odds lie evenly in (0, 1)."""
    least, most = F.lit(1e-9), F.lit(1 - 1e-9)
    odds = lambda p: F.least(F.greatest(p, least), most) / (1 - F.least(F.greatest(p, least), most))
    own = F.coalesce(F.col("__rest") * _weight(weight) / F.col("__weights"), F.lit(0.0))
    even = F.coalesce(F.col("__rest") / F.col("source_size"), F.lit(0.0))
    z = (F.col("__u") / (1 - F.col("__u"))) / (odds(own) / odds(even))
    return df.withColumn("__q", z / (1 + z))
