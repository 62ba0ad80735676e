"""Queries of the operators that mine whole texts for repeats: periodic runs, benchmark passages, collocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, periodic, positional
from .common import table


def _words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    sep = "[\\x20\\x09-\\x0D]+"
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"\\A{sep}|{sep}\\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, sep))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a tenth of the texts made periodic from some word on, as doc_id's CRC-32 says; null ids leave theirs alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, _words(F.col("text"))))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    rows = rows.withColumns({"n": n, "a": a.cast("int"), "p": p.cast("int")})
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.withColumns({"best": periodic.strongest(F.col("runs")), "lines": F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc_table() -> list[int]:
    """CRC-32 of each half byte, by the reflected polynomial."""
    table = list(range(16))
    for _ in range(4):
        table = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in table]
    return table


#: Runs as stretches of equal five-grams at one distance; a stretch inside one of a smaller, dividing period isn't of smallest period.
OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w,
         flatten(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT])) AS b
  FROM documents
), hashed AS (
  SELECT r, doc_id, w, len(w) AS n, CASE WHEN b IS NOT NULL THEN
         xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 4, {_crc_table()}[(xor(c, x) & 15) + 1])), 4294967295) END AS h
  FROM docs
), params AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed
), texts AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w
  FROM params
), grams AS (
  SELECT r, n, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM texts, LATERAL (SELECT unnest(range(n - 4)) AS i) WHERE n >= 6
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
  HAVING count(*) + 4 + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period FROM stretches s
  WHERE NOT EXISTS (FROM stretches o WHERE o.r = s.r AND o.q < s.q AND s.q % o.q = 0 AND o.start <= s.start AND o.start + o.length >= s.start + s.length)
), summed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r
), best AS (
  SELECT * FROM runs x WHERE NOT EXISTS (FROM runs y WHERE y.r = x.r AND (y.length * x.period > x.length * y.period
    OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))
), gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT r, w, unnest(range(n)) AS i FROM texts) ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM texts LEFT JOIN summed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


#: Windows met whole as strings; proximity by trying each place near an occurrence of a window's rarest word.
OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, w[i:i + least(10, len(w)) - 1] AS x FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0
), places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM docs, (SELECT DISTINCT k FROM windows), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
), exact AS (SELECT p.r, p.k, p.i, item_id FROM places p JOIN windows v ON v.k = p.k AND array_to_string(v.x, ' ') = p.g),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM exact) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM exact GROUP BY r),
tokens AS MATERIALIZED (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM docs),
sizes AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
firsts AS (
  SELECT item_id, k, x, j, x[j] AS t FROM windows, LATERAL (SELECT unnest(range(1, k + 1)) AS j) LEFT JOIN sizes ON sizes.t = x[j]
  QUALIFY row_number() OVER (PARTITION BY item_id, k, x ORDER BY coalesce(c, 0), j) = 1
), tried AS (SELECT DISTINCT tokens.r, item_id, k, x, i - j + s AS place FROM firsts JOIN tokens USING (t), (VALUES (-2), (-1), (0), (1), (2)) AS v(s)),
near AS (
  SELECT DISTINCT tried.r, item_id FROM tried JOIN docs USING (r)
  WHERE len(list_filter(range(1, k + 1), lambda j: list_contains(w[greatest(1, place + j - 2):greatest(0, place + j + 2)], x[j]))) = k
), close AS (SELECT r, count(*) AS n_near FROM (SELECT r, item_id FROM near EXCEPT SELECT r, item_id FROM exact) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN close USING (r)
"""

#: Collocations of each language in the result.
BEST = 2000


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.top(collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang")), BEST)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), counts AS MATERIALIZED (
  SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM pieces, (SELECT unnest(range(1, 6)) AS m), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i) GROUP BY ALL HAVING count(*) >= 100
), sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
kept AS (
  SELECT lang, m, g, f FROM counts c WHERE m > 1 AND NOT EXISTS (
    FROM counts o WHERE o.lang = c.lang AND o.m > c.m AND o.f >= c.f AND contains(' ' || array_to_string(o.g, ' ') || ' ', ' ' || array_to_string(c.g, ' ') || ' '))
), cuts AS (
  SELECT k.lang, k.g, k.f AS a, j, x.f AS l, y.f AS r, n, CAST((1000 * k.f::HUGEINT * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM kept k, LATERAL (SELECT unnest(range(1, m)) AS j) JOIN counts x ON x.lang = k.lang AND x.g = k.g[1:j] JOIN counts y ON y.lang = k.lang AND y.g = k.g[j + 1:]
  JOIN sizes ON sizes.lang = k.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM best QUALIFY rank <= {BEST}
"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs, "op12_decontaminate": op12_decontaminate, "op13_collocations": op13_collocations}
ORACLE_SQL = {"op11_periodic_runs": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_collocations": OP13_SQL}
