"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are phrases of up to four words, and each place of a text is an edge: the longest gram
that begins there, five words or fewer where its piece ends. Equal edges are merged within a
task, then by Spark, which deals them out by their first words and sorts them; a node's edges
then stand together, and one pass over the sorted edges derives all shorter counts: a phrase
occurs as often as edges leave its node (its flow) and pieces end in it. A word too rare to
stand in any result ends a piece like punctuation does, and so does a place between two words
whose pair is too rare, as an upper bound on its count says (pairs are counted by hash, several
in one counter). A phrase whose whole flow goes through one edge, in or out, is on a unary path
and is compacted into the longer phrase.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, few, session, shuffle_partitions, spread

#: Words of the longest gram, and occurrences of a phrase worth a row.
LONGEST, LEAST = 5, 100
#: Language of texts without one.
UNKNOWN = "und"
#: Different words counted, and words whose edges are merged, at once in a task.
WORDS, CHUNK = 200_000, 1 << 19
#: Words of the input that share a counter of pairs, on average; the least and the largest number of counters (as powers of two), and slices of them that are summed apart.
SHARED, COUNTERS, SLICES = 16, (16, 28), 256
#: Frequent words, and bytes of them, up to which they are broadcast; beyond, words meet their numbers by a join.
BROADCAST_WORDS, BROADCAST_BYTES = 1 << 20, 32 << 20
#: A word with more than this share of a task's even part of all words is hot: grams that begin with hot words are dealt by more of their words.
HOT = 1 / 16

#: A-Z become a-z, piece separators "." and tabs spaces; words hold none of these.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\v\f\r" else 0x20 if b == 9 else b for b in range(256))
_END = b"."
#: Bits of a word's number; three longs hold an edge of five words and how many of them deal it out.
BITS = 31
_MASK = (1 << BITS) - 1
_PLACES = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]

EDGES = "k1 long, k2 long, k3 long, n long"


def tokens(text: bytes | None) -> list[bytes]:
    """Words, and "." where a piece ends."""
    return text.translate(_BYTES).replace(_END, b" . ").split() if text else []


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) of all words of docs."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        cells = [(language, w, n) for language, c in counts.items() for w, n in c.items() if w != _END]
        columns = zip(*cells, strict=True) if cells else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for language, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[language].update(tokens(x.as_py()))
                if sum(map(len, counts.values())) > WORDS:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    found = spread(_texts(docs, text, lang)).mapInArrow(run, "lang string, word binary, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))


def numbered(words: DataFrame) -> DataFrame:
    """words with id, from 1 on without gaps: numbers within each written part, plus those of the parts before."""
    parts = cut(words.withColumn("_part", F.spark_partition_id()), "words")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a task
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("lang", "word"))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


class Pairs:
    """Which pairs of words may be frequent: a bit for each counter of pairs."""

    def __init__(self, power: int):
        self.power, self.bits = power, np.full(1 << power - 3, 255, np.uint8)

    def counter(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = left.astype(np.uint64) * _PLACES[0] + right.astype(np.uint64) * _PLACES[1]
        return ((h ^ h >> np.uint64(29)) * _PLACES[2] >> np.uint64(64 - self.power)).view(np.int64)

    def may_be(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.counter(left, right)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def merged(ids: np.ndarray, hot: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, ...]:
    """(k1, k2, k3, n) of the different edges along ids, where 0 ends a piece; an edge has two words at least.

    k3 ends with how many words deal the edge out: two, and one more for each hot word before.
    """
    line = np.r_[ids, np.zeros(LONGEST, np.int64)]
    goes_on = (line[:-1] != 0) & (line[1:] != 0)
    goes_on[goes_on] = pairs.may_be(line[:-1][goes_on], line[1:][goes_on])
    at = np.flatnonzero(goes_on)
    words, there = [line[at], line[at + 1]], np.ones(len(at), bool)
    for i in range(2, LONGEST):
        there = there & goes_on[at + i - 1]
        words.append(np.where(there, line[at + i], 0))
    depth, still = np.full(len(at), 2, np.int64), hot[words[0]]
    for w in words[1:4]:
        still = still & hot[w]
        depth += still
    columns = words[0] << BITS | words[1], words[2] << BITS | words[3], words[4] << 3 | depth
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(order) else order
    return *(c[fresh] for c in columns), np.diff(np.r_[fresh, len(order)])


class Lines:
    """Texts as numbers of words with 0 between pieces, some CHUNK of words at a time."""

    def __init__(self, number: dict[str, dict[bytes, int]]):
        self.number, self.none = number, {}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[int] = []
        for batch in batches:
            for language, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                of = self.number.get(language, self.none).get
                held.extend([of(w, 0) for w in tokens(x.as_py())])
                held.append(0)
                if len(held) >= CHUNK:
                    yield np.array(held, np.int64)
                    held.clear()
        if held:
            yield np.array(held, np.int64)


def frequent_pairs(texts: DataFrame, lines: Any, total: int, least: int) -> Pairs:
    """Counters of all pairs of neighbouring frequent words, summed by slices; total words decide their number.

    A counter is the sum of its pairs, so a pair in one below `least` occurs less often itself.
    """
    pairs = Pairs(min(max((total // SHARED).bit_length(), COUNTERS[0]), COUNTERS[1]))
    width = max(8, (1 << pairs.power) // SLICES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in lines.value(batches):
            both = np.flatnonzero((line[:-1] != 0) & (line[1:] != 0))
            at, n = np.unique(pairs.counter(line[both], line[both + 1]), return_counts=True)
            edges = np.r_[np.flatnonzero(np.diff(at // width, prepend=-1)), len(at)].tolist()
            parts = [(int(at[a]) // width, at[a:b] % width, n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [pa.array([s for s, _, _ in parts], pa.int32())]
            columns += [pa.array([zstandard.compress(x.astype("<i4").tobytes(), 1) for x in xs], pa.binary()) for xs in ([np.diff(p, prepend=0) for _, p, _ in parts], [p for _, _, p in parts])]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "at", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = (np.frombuffer(zstandard.decompress(x), "<i4") for x in packed)
                sums.setdefault(s, np.zeros(width, np.int64))[np.cumsum(at)] += n
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array(bits, pa.binary())], names=["slice", "bits"])

    dealt = texts.mapInArrow(counted, "slice int, at binary, n binary").repartition(shuffle_partitions(texts.sparkSession), "slice")
    pairs.bits[:] = 0
    for r in dealt.mapInArrow(summed, "slice int, bits binary").collect():  # a bit a counter: 32 MB at most
        pairs.bits[r.slice * width // 8 :][: width // 8] = np.frombuffer(r.bits, np.uint8)
    return pairs


def edges(docs: DataFrame, words: DataFrame, total: int, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """EDGES of docs, merged within tasks; words are (lang, word, id, hot), total is the number of words in docs."""
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word").cast("long")), F.lit(0))).first()
    if size[0] > BROADCAST_WORDS or size[1] > BROADCAST_BYTES:
        return edges_by_join(docs, words, text, lang)
    number: dict[str, dict[bytes, int]] = defaultdict(dict)
    hot = np.zeros(size[0] + 1, bool)
    for r in words.select("lang", "word", "id", "hot").collect():  # within the bounds above
        number[r.lang][bytes(r.word)], hot[r.id] = r.id, r.hot
    context, texts = session(docs.sparkSession).sparkContext, spread(_texts(docs, text, lang))
    lines = context.broadcast(Lines(dict(number)))
    shipped = context.broadcast((hot, frequent_pairs(texts, lines, total, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in lines.value(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged(line, *shipped.value)], names=["k1", "k2", "k3", "n"])

    return texts.mapInArrow(run, EDGES)


def edges_by_join(docs: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The same edges without a broadcast: every word's number comes by a join, its followers by a window over its piece."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.translate(F.col(text), upper, lower).alias("text"))
    pieces = rows.select("row", "lang", F.posexplode(F.split("text", "[.,;:!?\\x0A-\\x0D]")).alias("piece", "text"))
    each = pieces.select("row", "lang", "piece", F.posexplode(F.split("text", "[\\x20\\x09]+")).alias("at", "word")).where("word <> ''")
    each = each.withColumn("word", F.col("word").cast("binary")).join(words.select("lang", "word", "id", "hot"), ["lang", "word"], "left")
    w = Window.partitionBy("row", "piece").orderBy("at")
    marked = each.withColumn("w1", F.coalesce(2 * F.col("id") + F.col("hot").cast("long"), F.lit(0).cast("long")))
    ahead = marked.select("w1", *(F.coalesce(F.lead("w1", i).over(w), F.lit(0).cast("long")).alias(f"w{i + 1}") for i in range(1, LONGEST))).where("w1 > 0 and w2 > 0")
    for i in range(3, LONGEST + 1):
        ahead = ahead.withColumn(f"w{i}", F.when(F.col(f"w{i - 1}") > 0, F.col(f"w{i}")).otherwise(0))
    still = [reduce(lambda a, b: a & b, (F.col(f"w{j}") % 2 == 1 for j in range(1, i + 1))).cast("long") for i in (2, 3, 4)]
    ids = [F.shiftright(f"w{i}", 1) for i in range(1, LONGEST + 1)]
    depth = F.lit(2).cast("long") + still[0] + still[1] + still[2]
    k1, k2 = (F.shiftleft(ids[i], BITS).bitwiseOR(ids[i + 1]) for i in (0, 2))
    return ahead.select(k1.alias("k1"), k2.alias("k2"), F.shiftleft(ids[4], 3).bitwiseOR(depth).alias("k3"), F.lit(1).cast("long").alias("n"))


class Level:
    """Sums over the runs of equal prefixes of one length, in a stream of sorted edges; the last run stays open."""

    def __init__(self, length: int):
        self.length, self.open = length, None

    def take(self, k1: np.ndarray, k2: np.ndarray, k3: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...] | None:
        long = self.length
        k2 = np.zeros_like(k2) if long == 2 else k2 & ~_MASK if long == 3 else k2
        depth, k3 = k3 & 7, k3 >> 3 if long == 5 else np.zeros_like(k3)
        last = (k1, k2 >> BITS, k2 & _MASK, k3)[long - 2]
        rows = [c[last != 0] for c in (k1, k2, k3, depth, n)]
        if self.open:
            rows = [np.r_[o, c] for o, c in zip(self.open, rows, strict=True)]
        if not len(rows[0]):
            return None
        starts = np.flatnonzero(np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)])
        sums = [*(c[starts] for c in rows[:4]), np.add.reduceat(rows[4], starts)]
        self.open = [c[-1:] for c in sums]
        return tuple(c[:-1] for c in sums)


def grams(edges: DataFrame, least: int = LEAST) -> DataFrame:
    """(ids, f): phrases of two words and more, as numbers of words, that occur `least` times or more.

    Edges come sorted, part by part; sums of prefixes that lie in one part are whole there, and
    only frequent ones go on. Prefixes made of hot words alone are spread over parts and go on as partial sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [Level(i) for i in range(2, LONGEST + 1)]

        def frequent(level: Level, done: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            k1, k2, k3, depth, n = done
            some = (n >= least) | (depth > level.length)
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (k1, k2, k3, n)], names=["k1", "k2", "k3", "n"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("k1", "k2", "k3", "n")]
            for level in each:
                if done := level.take(*columns):
                    yield frequent(level, done)
        for level in each:
            if level.open:
                yield frequent(level, tuple(level.open))

    depth = F.col("k3").bitwiseAND(7)
    third, fourth, fifth = F.shiftright("k2", BITS), F.col("k2").bitwiseAND(_MASK), F.shiftright("k3", 3)
    deals = [F.col("k1"), *(F.when(depth > i, w).otherwise(0) for i, w in ((2, third), (3, fourth), (4, fifth)))]
    dealt = edges.repartition(shuffle_partitions(session(edges.sparkSession)), *deals).sortWithinPartitions("k1", "k2", "k3")
    sums = dealt.mapInArrow(run, "k1 long, k2 long, k3 long, n long")
    whole = sums.groupBy("k1", "k2", "k3").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = [F.shiftright("k1", BITS), F.col("k1").bitwiseAND(_MASK), F.shiftright("k2", BITS), F.col("k2").bitwiseAND(_MASK), F.col("k3")]
    return whole.select(F.filter(F.array(*words), lambda x: x > 0).alias("ids"), "f")


def on_unary_path(grams: DataFrame) -> DataFrame:
    """(ids): phrases whose flow goes through one edge whole, to or from a phrase of one word more.

    A phrase that occurs as often as some longer one around it does so as often as each phrase
    between the two, so edges of one word are enough.
    """
    n = F.size("ids")
    ends = F.array(F.slice("ids", F.lit(1), n - 1), F.slice("ids", F.lit(2), n - 1))
    inner = grams.where(n > 2).select(F.explode(ends).alias("ids"), F.col("f").alias("through"))
    most = inner.groupBy("ids").agg(F.max("through").alias("through"))
    return grams.join(most, "ids").where("through >= f").select("ids")


def collocations(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every phrase of two to five words that occurs `least` times or more and isn't compacted.

    A-Z count as a-z. Pieces end at . , ; : ! ? and line breaks, words at spaces and tabs; all
    counts are a language's own (null: "und"), overlapping occurrences each count. a, l and r
    count the phrase, its first part and the rest at the cut with the lowest score floor(1000 *
    a * n / (l * r)), ties to the shortest first part; n counts the language's words. Phrases
    inside a longer one that occurs as often are left out. Null, empty and blank texts have no
    words; repeated rows count each; long texts are taken whole; other columns don't matter; no
    rows in, none out.
    """
    counted = cut(word_counts(docs, text, lang), "counts")
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = max(1, int(total * HOT / shuffle_partitions(session(docs.sparkSession))))
    words = cut(numbered(counted.where(F.col("n") >= least)).withColumn("hot", F.col("n") >= hot), "vocabulary")
    found = cut(grams(edges(docs, words, total, least, text, lang), least), "grams")
    counts = found.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("f")))

    kept = found.join(on_unary_path(found), "ids", "left_anti").withColumn("id", F.col("ids")[0])
    kept = kept.join(words.select("id", "lang"), "id").join(few(sizes), "lang").select("lang", "ids", F.col("f").alias("a"), "n")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    part = lambda start, length, name: (F.slice("ids", start, length).alias(name), counts.select(F.col("ids").alias(name), F.col("f").alias(name[0])))
    (left, of_left), (right, of_right) = part(F.lit(1), F.col("k"), "l_ids"), part(F.col("k") + 1, F.size("ids") - F.col("k"), "r_ids")
    cuts = cuts.select("*", left, right).join(of_left, "l_ids").join(of_right, "r_ids")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n"), "below": whole("l") * whole("r")}).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    spelt = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"].cast("string")), " ")
    named = best.join(spelt.groupBy("ids").agg(phrase.alias("phrase")), "ids")
    return named.select("lang", "phrase", F.size("ids").cast("long").alias("words"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k collocations of each language, by score, then a, then phrase, with rank from 1.

    Each of 64 slices of a language gives its first k, so that no task sees a whole language.
    """
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = found.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    own: Any = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))
    some = slices.withColumn("_own", own).where(F.col("_own") <= k).drop("_own", "_slice")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)
