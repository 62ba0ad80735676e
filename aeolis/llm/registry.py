"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, kdtree, licenses, mixing, registry_mining, rpforest, sharding, simhash, substring_dedup, toxicity
from .common import cut, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, RANKS, PATTERN, keep=False), RANKS, PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


#: A conversation whose texts are control strings.
PROBE = (-7, "</s>[INST] ok [/INST]", ("user", "assistant"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, text, roles = PROBE
    probe = spark.range(len(roles)).select(
        F.lit(conv).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.element_at(F.array(*map(F.lit, roles)), F.col("id").cast("int") + 1).alias("role"),
        F.lit(text).alias("text"),
    )
    log = chat.as_events(turns.unionByName(probe))
    out = chat.render(chat.fold_events(log))
    read = F.array_join(F.transform(chat.turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.learned_text(F.col("formatted"), F.col("loss"))
    return out.select(
        "conv_id",
        F.size(chat.turns_of(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'))
          + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b'))
          + length('<s></s>') + length(CASE WHEN role = 'assistant' THEN '[/INST]' ELSE '[INST]' END) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, 8).drop("text")


def _crc_table() -> list[int]:
    """CRC-32 of each half byte, by the reflected polynomial."""
    table = list(range(16))
    for _ in range(4):
        table = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in table]
    return table


#: CRC-32 by half bytes, and the jump hash step by step, as the generator's and the jump's definitions read.
OP8_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS raw,
         (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key
  FROM documents
), halves AS (
  SELECT n, doc_id, octet_length(raw) + 1 AS size,
         list_prepend(4294967295, flatten(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT]))) AS b
  FROM docs
), summed AS (
  SELECT n, doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 4, {_crc_table()}[(xor(c, x) & 15) + 1])), 4294967295) AS text_crc32 FROM halves
), jumps AS (
  SELECT n, key, -1::BIGINT AS place, 0::BIGINT AS "to", 0 AS step FROM docs
  UNION ALL
  SELECT n, key2, "to", floor(("to" + 1) * (2147483648.0::DOUBLE / (key2 // 8589934592 + 1)::DOUBLE))::BIGINT, step + 1
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key2 FROM jumps WHERE "to" < 9)
), places AS (
  SELECT n, max(place) FILTER (place < 8) AS shard, max(place) FILTER (place < 9) AS grown_shard, max(key // 8589934592) FILTER (step = 1) AS drawn
  FROM jumps WHERE step > 0 GROUP BY n
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY (drawn + text_crc32) % 1024, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(grown_shard AS INT) AS grown_shard
FROM summed JOIN places USING (n)
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    each = mixing.each_row(mixing.placed(cut(planned, "plan")))
    return each.select("doc_id", "size", "source_size", "target", "taken", "first_position", "place")


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size
  FROM documents
), grouped AS (SELECT doc_id, source, h, size, count(*) AS n, size * count(*) AS words FROM docs GROUP BY doc_id, source, h, size),
sizes AS (
  SELECT source, CAST(sum(words) AS HUGEINT) AS s, CAST(sum(n) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM grouped GROUP BY source
), steps AS (
  SELECT *, sum(s) OVER () - 3 * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER (o) AS place
  FROM sizes WINDOW o AS (ORDER BY s / w, source NULLS LAST)
), stop AS (SELECT min(place) AS first FROM steps WHERE rest * w <= 3 * s * ws),
goals AS (
  SELECT source, s, n AS docs, CAST(0.5 * (2 - w) AS DOUBLE) AS lean, CASE WHEN first IS NULL OR place < first THEN CAST(3 * s AS DOUBLE)
         ELSE CAST((SELECT rest FROM steps, stop WHERE place = first) * w AS DOUBLE) / CAST((SELECT ws FROM steps, stop WHERE place = first) AS DOUBLE) END AS target
  FROM steps, stop
), placed AS (
  SELECT g.*, s, lean, target, CAST(round(target) AS HUGEINT) AS quota, g.size * docs <= s AS small
  FROM grouped g JOIN goals ON g.source IS NOT DISTINCT FROM goals.source
), run AS (
  SELECT *, quota // greatest(s, 1) AS passes, quota - quota // greatest(s, 1) * s AS extra, sum(words) OVER (PARTITION BY source, small) AS class,
         coalesce(sum(words) OVER (PARTITION BY source, small ORDER BY substr(h, 1, 2), h, doc_id NULLS FIRST, size
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed
), large AS (
  SELECT *, NOT small AND size > 0 AND 2 * before + words <= 2 * CAST(round(CAST(extra * class AS DOUBLE) / CAST(greatest(s, 1) AS DOUBLE)) AS HUGEINT) AS big FROM run
), used AS (SELECT *, coalesce(sum(words) FILTER (big) OVER (PARTITION BY source), 0) AS used FROM large),
taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN small THEN 2 * before + words <= 2 * (extra - used) ELSE big END::INT END AS copies,
         before + CASE WHEN small THEN s - class ELSE 0 END AS ahead, before + CASE WHEN small THEN used ELSE 0 END AS again FROM used
), starts AS (
  SELECT *, least(CAST(CASE WHEN k < passes THEN k * s + ahead ELSE passes * s + again END AS DOUBLE) / target, 1.0::DOUBLE) AS part
  FROM taken, LATERAL (SELECT unnest(range(CAST(copies AS BIGINT))) AS k)
), stream AS (
  SELECT *, 2::DOUBLE * part / ((1::DOUBLE - lean) + sqrt((1::DOUBLE - lean) * (1::DOUBLE - lean) + 4::DOUBLE * lean * part)) AS position FROM starts
), ranked AS (
  SELECT doc_id, source, size, k, position,
         coalesce(sum(n) OVER (ORDER BY position, doc_id NULLS FIRST, source NULLS LAST, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM stream
)
SELECT t.doc_id, t.size, CAST(s AS BIGINT) AS source_size, target, CAST(t.size * copies AS BIGINT) AS taken, position AS first_position, CAST(place + i AS BIGINT) AS place
FROM taken t LEFT JOIN ranked r ON r.k = 0 AND r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.source IS NOT DISTINCT FROM t.source AND r.size = t.size,
     LATERAL (SELECT unnest(range(t.n)) AS i)
"""

#: Rows of `embeddings` that are queries.
EVERY = 50


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kdtree.exact_top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0), 5)


OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rpforest.nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0), 5)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def _as_regex(template: str) -> str:
    """Template markup as a regular expression over words that stand between two spaces each."""
    pieces = {"[": "(", "]": ")?", "{": "(", "}": ")", "|": "|"}
    parts = re.findall(r"[\[\]{}|]|<\d+>|[^\s\[\]{}|<>]+", template)
    return "".join(pieces.get(x) or (f"( [^ ]+ ){{0,{x[1:-1]}}}" if x[0] == "<" else f" {x} ") for x in parts)


_NOTICES = ",\n  ".join(f"('{_as_regex(t)}', '{label}')" for t, label in licenses.NOTICES + licenses.LICENSES)

#: Words stand between two spaces each, so that neighbours don't share one.
OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), lines AS (SELECT doc_id, len(w) AS n_words, '  ' || array_to_string(w, '  ') || '  ' AS t FROM docs),
phrases(phrase, label) AS (VALUES (' under  the  mit  license ', 'mit'), (' apache  license  version  2 ', 'apache-2'), (' cc  by  nc ', 'cc-by-nc')),
parts AS (SELECT doc_id, label, string_split(t, phrase) AS p, len(string_split(trim(phrase), '  ')) AS k FROM lines, phrases WHERE contains(t, phrase)),
places AS (
  SELECT doc_id, label, list_sum(list_transform(p[:i], lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> '')))) + k * (i - 1) AS place
  FROM parts, LATERAL (SELECT unnest(range(1, len(p))) AS i)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
), notices(pattern, label) AS (VALUES
  NOTICES
), own AS (SELECT doc_id, label FROM lines, notices WHERE regexp_matches(t, pattern)),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM own) GROUP BY doc_id
)
SELECT l.doc_id, n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN l.doc_id IN (SELECT doc_id FROM own) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM lines l LEFT JOIN base b ON b.doc_id = l.doc_id LEFT JOIN labels x ON x.doc_id = l.doc_id
""".replace("NOTICES", _NOTICES)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_jump_shards": op8_jump_shards,
    "op9_nearest": op9_nearest,
    "op10_mix": op10_mix,
} | registry_mining.QUERIES
ORACLE_SQL = {"op2_exact_top_k": OP2_SQL, "op4_license_scan": OP4_SQL, "op6_chat_format": OP6_SQL, "op8_jump_shards": OP8_SQL, "op10_mix": OP10_SQL} | registry_mining.ORACLE_SQL
