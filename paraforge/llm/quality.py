"""Quality rules: statistics of one text, and lines that too many documents of a host share (operator 9, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CHARS, SEPARATORS, Workspace, column, free_names, sized_join, source_key, whole, words

#: Words of a window whose repetition counts (a power of two), fewest words of a document, largest share (%) of repeated words.
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
#: A line is over the limit if more than so many distinct documents of its host have it, at every size of the host.
MAX_DOCS = 10
#: A document that loses more than this share of its words to such lines is depleted.
MAX_LOST = 0.8
SYMBOLS = "#*$%&|<>"
#: The columns that quality_rules() adds.
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept", "kept_text"]


def normal_line(line: Column) -> Column:
    """A line in lower case with single spaces between words and without outer ones."""
    return F.lower(F.trim(F.regexp_replace(line, SEPARATORS, " ")))


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("__d1"), F.xxhash64(F.lit(7), text).alias("__d2")]


def frequent_lines(docs: DataFrame, ws: Workspace, host: str = "source", text: str = "text", key: str = "doc_id", max_docs: int = MAX_DOCS, distinct_texts: bool = False) -> DataFrame:
    """For each distinct text of a host that has lines over the limit: (__host, __d1, __d2, lost_words, lines array<long>).

    A line is normalised and stands under its 64-bit hash. It is over the limit if more than max_docs distinct documents of its
    host have it: documents are told apart by their key (by their text where the key is null), or with distinct_texts all by
    their text, so that copies of a document don't make its lines frequent. Lines are counted by rows with partial sums first,
    and only those above the limit that way are counted by documents, joined with a side of counted size, so that neither a
    host nor a line with a third of all rows meets in one task."""
    base = docs.select(
        source_key(F.col(host)).alias("__host"), whole(F.col(text)).alias("__t"),
        F.xxhash64(whole(F.col(text))).alias("__doc") if distinct_texts else F.coalesce(F.xxhash64(F.col(key).cast("long")), F.xxhash64(F.lit(3), whole(F.col(text)))).alias("__doc"),
    )
    own = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    described = F.transform(own, lambda x, i: F.struct(i.alias("at"), F.xxhash64(normal_line(x)).alias("line"), F.size(words(x)).alias("w")))
    lines = ws.save(base.select("__host", "__doc", *_text_key(F.col("__t")), F.inline(described)), "lines")
    many = ws.save(lines.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("__host", "line"), "many")
    met = ws.save(sized_join(lines, many, ["__host", "line"]), "met")
    ws.drop("lines")
    over = met.select("__host", "line", "__doc").distinct().groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("__host", "line")
    over = ws.save(over, "over")
    #: Of equal texts one counts: their lines stand at the same places.
    hit = sized_join(met, over, ["__host", "line"]).select("__host", "__d1", "__d2", "at", "line", "w").distinct()
    return ws.save(hit.groupBy("__host", "__d1", "__d2").agg(F.sum("w").cast("long").alias("lost_words"), F.collect_set("line").alias("lines")), "frequent_lines")


def _repeated_windows(hashes: str) -> Column:
    """The sorted positions of windows found twice or more, from the sorted (hash, position) pairs in column `hashes`."""
    return F.sort_array(
        F.filter(
            F.transform(
                F.col(hashes),
                lambda x, i: F.when((x["h"] == F.get(F.col(hashes), i - 1)["h"]) | (x["h"] == F.get(F.col(hashes), i + 1)["h"]), x["i"]),
            ),
            lambda p: p.isNotNull(),
        )
    )


def quality_rules(docs: DataFrame, ws: Workspace, host: str = "source", text: str = "text", key: str = "doc_id", keep: list[str] | None = None, max_docs: int = MAX_DOCS, distinct_texts: bool = False, with_text: bool = False) -> DataFrame:
    """Statistics and verdict for each row: the columns in `keep`, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost_words, kept, and with_text kept_text (the text without the lines over the limit). Where
    keep has a column of such a name, the made one is called made_<name>.

    A null or empty text has no words and fails the base rule; a null host is a host of its own; a null key is a document of its
    own text; repeated rows are one document and each get a row; ties don't occur; an empty table gives an empty one. What
    rests on one text is computed in the row, so very long texts cost memory in proportion to their own length only. Rows
    are shuffled only where the table of texts with lines over the limit is too large to be sent to all workers, and then without their texts unless with_text."""
    keep = keep if keep is not None else ["doc_id"]
    made = free_names(keep, MADE)
    frequent = frequent_lines(docs, ws, host, text, key, max_docs, distinct_texts)
    t = whole(F.col(text))
    df = docs.select(*[column(c).alias(f"__k{i}") for i, c in enumerate(keep)], t.alias("__t"), source_key(F.col(host)).alias("__host"), *_text_key(t))
    kept = [f"__k{i}" for i in range(len(keep))] + ["__host", "__d1", "__d2"] + ["__t"] * with_text
    df = df.withColumn("__w", words(F.col("__t"))).withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    n = F.size("__w")
    #: Hashes of windows of 1, 2, 4 and 8 words; each is made of two of the one before.
    df = df.withColumn("__h1", F.transform("__w", lambda x: F.xxhash64(x)))
    for half in (1, 2, 4):
        df = df.withColumn(f"__h{2 * half}", F.zip_with(f"__h{half}", F.slice(f"__h{half}", half + 1, n), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("__h", F.slice(f"__h{WINDOW}", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(repeats, pairs))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), _repeated_windows("__s")))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    df = df.select(
        *kept,
        n.cast("long").alias("__n_words"),
        F.length(F.translate("__t", SEPARATOR_CHARS, "")).cast("long").alias("__word_chars"),
        F.regexp_count("__t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("__n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("__n_repeat_words"),
    )
    #: A generator of one row keeps later filters above it: pushed further down they would repeat every expression they rest on.
    stats = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words"]
    df = df.select(*kept, F.inline(F.array(F.struct(*stats))))
    df = sized_join(df, frequent if with_text else frequent.drop("lines"), ["__host", "__d1", "__d2"], "left").withColumn("__lost_words", F.coalesce("lost_words", F.lit(0).cast("long")))
    df = df.withColumn("__base_failed", (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEATED_PERCENT * F.col("__n_words")))
    df = df.withColumn("__kept", ~F.col("__base_failed") & (F.col("__lost_words") <= F.col("__n_words") * F.lit(MAX_LOST)))
    if with_text:
        rest = F.filter(F.split("__t", "\n"), lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(normal_line(x))))
        df = df.withColumn("__kept_text", F.when(F.col("lines").isNull(), F.col("__t")).otherwise(F.array_join(rest, "\n")))
    return df.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"__{c}").alias(made[c]) for c in MADE if with_text or c != "kept_text"])
