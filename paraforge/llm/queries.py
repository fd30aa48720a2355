"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lmscore, media, mixing, neardup, pii, quality, sharding, substrings, tokenstore
from .common import Workspace, documents


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), Workspace(spark, "op1"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(documents(spark, sf_dir), Workspace(spark, "op2"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"), Workspace(spark, "op4"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), Workspace(spark, "op5"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(documents(spark, sf_dir), Workspace(spark, "op6"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), Workspace(spark, "op7"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(documents(spark, sf_dir), Workspace(spark, "op8"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir), Workspace(spark, "op9"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_round_trip(documents(spark, sf_dir), Workspace(spark, "op10"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_media": op2_media,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_substrings": op7_substrings,
    "op8_lm_score": op8_lm_score,
    "op9_quality": op9_quality,
    "op10_token_store": op10_token_store,
}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS s FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT r.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""

_OP4 = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || '{mixing.SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*)::DOUBLE AS docs FROM d GROUP BY 1),
k AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS everything FROM s),
g AS (
  SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS caps, coalesce(sum(weight) OVER o, 0)::BIGINT AS gone, sum(weight) OVER ()::BIGINT AS weights
  FROM k WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (SELECT *, 150 * everything - 100 * caps AS up, 100 * (weights - gone) AS down FROM g),
l AS (SELECT min_by(struct_pack(gone := gone, up := up, down := down), gone) AS level FROM f WHERE weight * up <= cap * down),
t AS (
  SELECT source, source_size, docs, CASE WHEN level IS NULL OR gone < level.gone THEN cap::DOUBLE ELSE (weight * level.up)::DOUBLE / level.down::DOUBLE END AS target
  FROM f LEFT JOIN l ON true
),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole_copies FROM t),
q AS (SELECT *, target - whole_copies * source_size AS rest FROM p),
e AS (
  SELECT d.*, source_size, target, whole_copies, rest,
    least(100 + coalesce(CASE WHEN source_size > 0 THEN floor(100.0::DOUBLE * size / (source_size::DOUBLE / docs)) END, 0), {mixing.MOST_WEIGHT})::BIGINT AS w
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
),
y AS (
  SELECT *,
    least(greatest(coalesce(CASE WHEN source_size > 0 THEN rest * w / (sum(w * size) OVER (PARTITION BY source))::DOUBLE END, 0), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS own,
    least(greatest(coalesce(CASE WHEN source_size > 0 THEN rest / source_size END, 0), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS even
  FROM e
),
z AS (SELECT *, (u / (1 - u)) / ((own / (1 - own)) / (even / (1 - even))) AS z FROM y),
r AS (
  SELECT *, coalesce(sum(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY source ORDER BY z / (1 + z), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM z
)
SELECT doc_id, size, source_size, target,
  size * (whole_copies + CASE WHEN size > 0 AND rest > 0 AND before < rest AND before + size * 0.5 <= rest THEN 1 ELSE 0 END) AS taken
FROM r
"""

_OP9 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 6)) AS i, ws FROM d WHERE len(ws) >= 8),
named AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM windows),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM named) WHERE c > 1),
repeated AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n FROM twice GROUP BY 1),
lines AS (
  SELECT doc_id, source, t, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm, len({_WORDS.format("line")}) AS w
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
common AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > {quality.MAX_DOCS}),
lost AS (SELECT doc_id, sum(w) AS n FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY 1),
same AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
o AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(same.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN same USING (doc_id)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND lost_words <= n_words * {quality.MAX_LOST} AS kept FROM b
"""

#: The others rest on tokenizers, media forms, byte positions, bootstrapped patterns, iterations or filters, which SQL can't
#: express; tests hold them against brute-force versions.
ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": _OP1, "op4_mixing": _OP4, "op9_quality": _OP9}
