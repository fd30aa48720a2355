"""The corpus pipeline: quality rules, near-dedup, PII, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which is what the stage before it has kept. All but the last return the
columns that docs has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraforge.llm import bpe, mixing, neardup, pii, quality
from paraforge.llm.common import Workspace, column, documents, free_names, sized_join

#: SQL can't express similarity, bootstrapped patterns or BPE; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns, with another text and the number of its characters where there is such a column."""
    replaced = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[(replaced[c] if c in replaced else column(c)).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines over the limit are removed from the others.

    Lines are counted over distinct texts here, because copies are the next stage's: a document that was copied often keeps its
    lines and so one of its copies. A null or empty text is rejected; a null source is a source of its own; repeated rows
    share their verdict; an empty table gives an empty one; extra columns keep their values, whatever their names."""
    names = docs.columns
    made = free_names(names, quality.MADE)
    judged = quality.quality_rules(docs, Workspace(spark, "stage1"), keep=names, distinct_texts=True, with_text=True)
    return _with_text(judged.where(column(made["kept"])), names, F.when(F.col("text").isNotNull(), column(made["kept_text"])))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the smallest doc_id.

    Of rows repeated with their doc_id and text one stays. Documents without words are no duplicates of each other, and a row without a
    doc_id is a duplicate of none. An empty table gives an empty one; extra columns keep their values."""
    ws = Workspace(spark, "stage2")
    judged = ws.save(neardup.near_duplicates(docs, ws, size=5, percent=80), "judged")
    gone = ws.save(judged.where("NOT kept").select("doc_id").distinct(), "gone")
    left = sized_join(docs, gone, "doc_id", "left_anti").select(*map(column, docs.columns))
    repeated = ws.save(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return left
    once = sized_join(left, repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*map(column, docs.columns))
    return sized_join(left, repeated, "doc_id", "left_anti").select(*map(column, docs.columns)).unionByName(once)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are masked by their kind; every row stays.

    A null text stays null and an empty one empty; equal texts are masked alike; an empty table gives an empty one; extra columns
    keep their values, whatever their names."""
    return _with_text(pii.redact(docs, Workspace(spark, "stage3")), docs.columns, F.col("text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most; documents that it takes no time go.

    A text without words is only taken as whole copies; a null source is a source of its own; of repeated rows as many are taken as
    fit; an empty table gives an empty one; extra columns keep their values, whatever their names."""
    names = docs.columns
    copies = column(free_names(names, mixing.MADE)["copies"])
    mixed = mixing.mix(docs, Workspace(spark, "stage4")).select(*[column(c).alias(f"__k{i}") for i, c in enumerate(names)], copies.cast("int").alias("__copies"))
    taken = mixed.where("__copies > 0").select("*", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy"))
    return taken.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids, the token ids.

    A null or empty text has no ids; each row, repeated or not, gives a row; an empty table gives an empty one; other columns go."""
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage_{i}")
        if i:
            ws.drop(f"stage_{i - 1}")
    return docs
