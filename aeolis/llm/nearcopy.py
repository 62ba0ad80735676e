"""Near copies by SimHash fingerprints of their five-word shingles and an exact check, for a corpus.

Here a near copy is a text with a Jaccard similarity of SIMILAR or more. All fingerprints go
through op7's whole method first: keys of blocks of bits, bit-sliced comparison under each key,
components of the links within three bits. At SIMILAR fingerprints differ in more bits than blocks can serve, so
band keys of min-hashes deal out further candidates, again compared by fingerprint, with a wide
RADIUS: a pair at SIMILAR shares none of the BANDS keys with a probability of 1.3e-7, and less
above. Under each key every set is compared with two pivots first, which links a group of copies
at a cost in proportion to its size; where sets of a key are still apart, op7's bit-sliced
comparison goes over those not linked to the first pivot against all. Every link is one within
the radius that an exact check of the whole sets confirms, so that nothing less similar is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spread
from .simhash import components, forest, keep_least, links, majority, with_row

SHINGLE, SEED = 5, 42
#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Keys of a text and the min-hashes in each.
BANDS, ROWS = 40, 5
#: Bits in which fingerprints of near copies differ at most. At SIMILAR they differ in 12 of 64 on
#: average where texts are shortest and in fewer elsewhere; in more than this with a probability below 1e-6.
RADIUS = 28
#: Bytes of shingles compared at once; a key is never torn apart, so one key more may join.
HELD = 32 << 20
#: Sets under one key, of its first pivot's component or of others, beyond which they become tiles.
TILE = 512
#: Shingles whose min-hashes are taken at once.
PART = 1 << 8

_RNG = np.random.default_rng(SEED)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 64, SHINGLE + ROWS, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the different runs of five words (A-Z lower-cased); a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    return np.unique(_mixed(sum(_mixed(each[i : i + n] * _PLACES[i]) * _PLACES[i] for i in range(SHINGLE))))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes; none for an empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFF_FFFF_FFFF_FFFF, np.uint64)
    for i in range(0, len(own), PART):
        least = np.minimum(least, ((own[i : i + PART, None] ^ _FLIP) * _TIMES).min(0))
    bands = _mixed(least.reshape(BANDS, ROWS)) * _PLACES[SHINGLE:]
    return _mixed(bands.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_id(own: np.ndarray, seed: int = SEED) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of SIMILAR or more."""
    above, below = SIMILAR
    if above * max(len(a), len(b)) > below * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])) * (above + below) >= above * len(both)


def linked(ends: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first that near copies lead to under its key, before and after comparing; ends[i] is where the key of set i ends.

    groups: sets of one number are linked already.
    """

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fromiter((similar(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))

    before = np.arange(len(fps))
    if groups is not None and len(fps):
        _, first, member = np.unique(np.stack([ends, groups]), axis=1, return_index=True, return_inverse=True)
        before = first[member.ravel()]
    return before, forest(ends, fps, RADIUS, check, before)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, set, alt, fp, keys) of each row; set and alt together are 128 bits that stand for the set, fp is its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, alts, fps, keys = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                names.append(set_id(own))
                alts.append(set_id(own, SEED + 1))
                fps.append(majority(own))
                keys.append(band_keys(own))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (names, alts, fps)), lists], names=["row", "set", "alt", "fp", "keys"])

    return spread(docs.select("_row", F.col("text").cast("binary"))).mapInArrow(run, "row string, set long, alt long, fp long, keys array<long>")


def named(sets: DataFrame) -> DataFrame:
    """sets (set, alt, ...), a row a pair, with node: the set's number, or where two sets share one, another made of both numbers."""
    shared = F.count("*").over(Window.partitionBy("set")) > 1
    return sets.withColumn("node", F.when(shared, F.xxhash64("set", "alt")).otherwise(F.col("set")))


def _few_bits(sets: DataFrame) -> DataFrame:
    """(set, pivot) of sets (node, fp): each set of op7's components, whose links are within three bits, and the component's least."""
    roots = components(links(sets.select("fp").distinct())).toDF("fp", "root")
    joined = cut(sets.join(roots, "fp", "left").select(F.col("node").alias("set"), F.coalesce("root", "fp").alias("root")), "few")
    return joined.join(joined.groupBy("root").agg(F.min("set").alias("pivot")), "root").where("set <> pivot").select("set", "pivot")


def _shingled(texts: DataFrame) -> DataFrame:
    """(set, fp, shingles) of texts (set, text); fp is the set's SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py()) for x in batch.column(1)]
            made = [pa.array(map(majority, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["set", "fp", "shingles"])

    return texts.select("set", F.col("text").cast("binary")).mapInArrow(run, "set long, fp long, shingles binary")


def _checked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (set, pivot) within RADIUS whose sets are similar, as (a, b). Joins fetch the sets; adaptive execution splits a pivot of many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("own", "other"))
            alike = [similar(*(np.frombuffer(x.as_py(), np.uint64) for x in pair)) for pair in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    own, other = (whole.select(F.col("set").alias(s), F.col("fp").alias(f"{s}_fp"), F.col("shingles").alias(c)) for s, c in (("a", "own"), ("b", "other")))
    near = pairs.toDF("a", "b").join(own, "a").join(other, "b").where(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= RADIUS)
    return near.select("a", "b", "own", "other").mapInArrow(run, "a long, b long")


def _compared(dealt: DataFrame) -> DataFrame:
    """(a, b): the links that are missing under each key of (key, set, comp, fp, shingles); sets of one comp are linked."""

    def links(keys: list[int], names: list[int], comps: list[int], fps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        names, comps, keys = (np.array(x, np.int64) for x in (names, comps, keys))
        before, label = linked(np.searchsorted(keys, keys, "right"), np.array(fps, np.int64), sets, comps)
        joined = (before == np.arange(len(label))) & (label != before)
        return pa.RecordBatch.from_arrays([pa.array(names[joined]), pa.array(names[label[joined]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for key, name, comp, fp, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= HELD and key != rows[-1][0]:
                    yield links(*zip(*rows, strict=True))
                    rows, held = [], 0
                rows.append((key, name, comp, fp, np.frombuffer(own, np.uint64)))
                held += len(own)
        if rows:
            yield links(*zip(*rows, strict=True))

    return dealt.select("key", "set", "comp", "fp", "shingles").repartition("key").sortWithinPartitions("key", "set").mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, pivots: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, set, comp): what is still to be compared, dealt to tiles that two and two meet.

    Under a key with several components the sets outside its first pivot's are compared with all
    and among themselves, those of the pivot's own not again with each other: they get a copy for
    each tile of the others only. Keys of up to three sets are settled by their pivots.
    """
    comp = lambda t, c, name: t.join(roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    large = comp(members.where("size > 3"), "set", "comp").join(comp(pivots.select("key", "low"), "low", "main"), "key")
    large = large.withColumn("left", F.col("comp") != F.col("main"))
    sizes = large.groupBy("key").agg(F.count_if(F.col("left")).alias("n_left"), F.count_if(~F.col("left")).alias("n_main")).where("n_left > 0")
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    large = large.join(sizes.select("key", tiles("n_left").alias("t_left"), tiles("n_main").alias("t_main")), "key")
    own = F.pmod(F.xxhash64("set", F.lit("tile")), F.when(F.col("left"), F.col("t_left")).otherwise(F.col("t_main"))).cast("int")
    large = large.withColumn("own", own + F.when(F.col("left"), F.col("t_main")).otherwise(0))
    others = F.sequence(F.when(F.col("left"), F.lit(0)).otherwise(F.col("t_main")), F.col("t_main") + F.col("t_left") - 1)
    dealt = large.withColumn("other", F.explode(others))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "set", "comp")


def groups(docs: DataFrame) -> DataFrame:
    """(_row, group) of docs (_row, text): rows linked by near copies share a group.

    Texts without words have one empty set, and so one group; texts of any length are compared
    whole. Keys with the same sets below them count once.
    """
    rows = cut(_keyed(docs), "keyed")
    sets = cut(named(rows.groupBy("set", "alt").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))), "sets")
    dealt = sets.select(F.col("node").alias("set"), F.explode("keys").alias("key")).distinct()
    own = [F.xxhash64("set", F.lit(k)) for k in (1, 2)]
    shared = dealt.groupBy("key").agg(F.count("*").alias("size"), *(F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(own))).where("size > 1")
    shared = shared.groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).select("key", "size")
    members = cut(dealt.join(shared, "key"), "candidates")

    few = cut(_few_bits(sets.select("node", "fp")), "links")
    wanted = members.select("set").union(few.select("set")).union(few.select("pivot")).distinct().join(sets.select(F.col("node").alias("set"), "row"), "set")
    texts = docs.join(wanted, F.col("_row") == F.col("row")).select("set", "text")
    whole = cut(_shingled(texts).dropDuplicates(["set"]), "shingles")
    pivots = cut(members.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")), "pivots")
    pairs = members.select("key", "set").join(pivots, "key").select("set", F.explode(F.array("low", "high")).alias("pivot")).unionByName(few)
    starts = cut(_checked(pairs.where("set <> pivot").select(F.greatest("set", "pivot"), F.least("set", "pivot")).distinct(), whole), "links")
    apart = cut(_apart(members, pivots, components(starts)), "apart")
    rest = cut(_compared(apart.join(whole, "set")), "links")
    roots = components(starts.unionByName(rest))
    grouped = sets.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("set", "alt", F.coalesce("root", "node").alias("group"))
    return rows.select("row", "set", "alt").join(grouped, ["set", "alt"]).select(F.col("row").alias("_row"), "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id, with its columns.

    Null, empty and blank texts have no shingles and are copies of each other; of repeated rows one
    stays; whole texts count, however long; columns keep their names and values, whatever they are.
    Rows without doc_id can't be told apart and stay. No rows in, none out.
    """
    return keep_least(docs, groups(with_row(docs)))
