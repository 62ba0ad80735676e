"""SimHash near-duplicates: word-shingle fingerprints, linked by bit-sliced comparison.

Two fingerprints within three bits agree on two of five blocks, so each is dealt under ten keys
(every two blocks). Within a key all fingerprints are compared at once: bit planes are stored
vertically, a fingerprint and its s-th successor sit in the same lane of a plane and the shifted
plane, and carry-save counters add the differing bits of 64 lanes a word. Only a spanning forest
of each key's links is sent on; components come from large-star / small-star rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spread

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Blocks of bits; RADIUS differing bits leave BLOCKS - RADIUS of them equal.
BLOCKS = 5
#: Fingerprints under one key beyond which the key is divided further.
HOT = 4096
#: Fingerprints compared at once; a key is never torn apart, so one key more may join.
BATCH = 1 << 17

Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


# -- fingerprints -----------------------------------------------------------------------------
def fingerprint(text: bytes | None) -> int:
    """Majority of the bits of all shingles' XXH64; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the key (text, or a long) and a signed long with the fingerprint's 64 bits."""
    kind = "string" if dict(docs.dtypes)[key] == "string" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast(kind), F.col(text).cast("binary"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, fp long")


# -- comparison -------------------------------------------------------------------------------
def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes, one row a bit and one lane a fingerprint, with two empty words behind."""
    words = len(fps) // 64 + 2
    bits = np.zeros((BITS, words * 64), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within(x_of, alive: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (of those at `at`) and their lanes whose differing bits number `radius` at most.

    x_of(bit, at): the words of differing bits. Counters start so that they overflow just
    beyond the radius; words in which each lane has overflowed are given up.
    """
    counters = max(1, radius.bit_length())
    spare = (1 << counters) - 1 - radius
    full = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
    count = [np.full(len(at), full if spare >> k & 1 else 0, np.uint64) for k in range(counters)]
    for bit in range(BITS):
        carry = x_of(bit, at)
        for k in range(counters):
            count[k], carry = count[k] ^ carry, count[k] & carry
        alive = alive & ~carry
        if bit % 8 == 7:
            going = alive != 0
            if not going.all():
                at, alive, count = at[going], alive[going], [c[going] for c in count]
            if not len(at):
                break
    return at, alive


def forest(keys_end: np.ndarray, fps: np.ndarray, radius: int = RADIUS, check: Check | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """For each row the first row of its component, linking rows of one key within the radius.

    label: what is linked already, each row's first row of its component.

    Rows are sorted by key; keys_end[i] is where the key of row i ends. check(a, b) says which
    of the pairs within the radius are links; pairs that links already join aren't asked about.
    """
    n = len(fps)
    label = np.arange(n) if label is None else label
    planes = planes_of(fps)
    ends = np.zeros(planes.shape[1] * 64, np.int64)
    ends[:n] = keys_end
    lanes = np.arange(64)
    live, shift = np.arange(planes.shape[1] - 2 + (n % 64 > 0)), 0
    while True:
        shift += 1
        rows = live[:, None] * 64 + lanes
        mask = ends[rows] - rows > shift
        some = mask.any(1)
        live = live[some]
        if not len(live):
            return label
        alive = np.packbits(mask[some], axis=1, bitorder="little").view("<u8")[:, 0]
        skip, bits = divmod(shift, 64)
        low, high = np.uint64(bits), np.uint64(64 - bits)
        last = planes.shape[1] - 1

        def differing(bit: int, at: np.ndarray) -> np.ndarray:
            plane = planes[bit]
            ahead = plane[np.minimum(at + skip, last)]
            if bits:
                ahead = ahead >> low | plane[np.minimum(at + skip + 1, last)] << high  # noqa: B023
            return plane[at] ^ ahead

        at, hits = within(differing, alive, live, radius)
        if len(at):
            w, lane = np.nonzero(np.unpackbits(hits[:, None].view(np.uint8), axis=1, bitorder="little"))
            a = at[w] * 64 + lane
            if check:
                a = a[label[a] != label[a + shift]]
                a = a[check(a, a + shift)]
            label = join_labels(label, a, a + shift)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a[i] and b[i]; a label is its component's first row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := root[root], root):
            root = further
        label = root[label]


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of n parts of nearly equal length of these bit positions."""
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _masks(radius: int) -> list[tuple[int, list[int]]]:
    """For every choice of BLOCKS - radius blocks its mask, and that mask with each of radius + 1 parts of the rest."""
    out = []
    for chosen in combinations(_parts(list(range(BITS)), BLOCKS), BLOCKS - radius):
        mask = sum(chosen)
        rest = [b for b in range(BITS) if not mask >> b & 1]
        out.append((mask, [mask | part for part in _parts(rest, radius + 1)]))
    return out


def _longs(masks: list[int]) -> Column:
    return F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))


def _hot(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > HOT)


def candidates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, fp): fingerprints within the radius share a key. Distinct fps in; no key is large.

    The rows under a key of more than HOT fingerprints are dealt once more, by the pigeonhole
    rule over parts of the bits outside the key; a key that is large even then becomes tiles,
    each two of which meet. Where a key's hash joins two keys, that costs comparisons, no links.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 1}")
    masks = _masks(radius)
    dealt = fps.select("fp", F.posexplode(_longs([m for m, _ in masks])).alias("choice", "mask"))
    first = cut(dealt.select("fp", "choice", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")), "keys")
    hot = cut(_hot(first), "hot")
    if hot.isEmpty():
        return first.select("fp", "key")
    finer = F.element_at(F.array(*(_longs(m) for _, m in masks)), F.col("choice") + 1)
    fine = first.join(hot, "key").select("fp", "choice", F.posexplode(finer).alias("part", "mask"))
    fine = cut(fine.select("fp", F.xxhash64("choice", "part", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")), "keys")
    large = fine.join(_hot(fine), "key").withColumn("tiles", F.ceil(F.col("size") / HOT).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("tiles")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = large.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))

    def small(rows: DataFrame) -> DataFrame:
        return rows.join(_hot(rows).select("key"), "key", "left_anti").select("fp", "key")

    return small(first).unionByName(small(fine)).unionByName(tiled)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the links under each key, as pairs of different fingerprints."""

    def compare(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        wanted = np.repeat(sizes > 1, sizes)
        values, ends = values[wanted], np.cumsum(sizes[sizes > 1])
        label = forest(np.repeat(ends, sizes[sizes > 1]), values, radius)
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            values = np.r_[values, batch.column(1).to_numpy()]
            if len(keys) >= BATCH:
                upto = np.searchsorted(keys, keys[-1])  # the last key may go on
                if upto:
                    yield compare(keys[:upto], values[:upto])
                    keys, values = keys[upto:], values[upto:]
        if len(keys):
            yield compare(keys, values)

    dealt = candidates(fps, radius).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


# -- components -------------------------------------------------------------------------------
def _print(pairs: DataFrame) -> tuple:
    """The number of distinct pairs and two sums of their hashes: equal for equal sets."""
    hashes = [F.xxhash64("hi", "lo", F.lit(k)) for k in (1, 2)]
    return tuple(pairs.agg(F.count("*"), *(F.bit_xor(h) for h in hashes)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Large-star and small-star in turn until nothing moves; each round is written to the
    shared folder. Every star is an aggregate with partial sums and a join that adaptive
    execution splits where a hub has most rows.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    print_of = _print(pairs)
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours go to the least of these
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        after = cut(small.where("hi <> lo").distinct(), "edges")
        print_of, before = _print(after), print_of
        if print_of == before:
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        pairs = after


def simhash_groups(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Words are lower-cased (A-Z); a null or empty text has fingerprint 0 and links like any
    other, and so do very long texts. Repeated rows and equal texts share a fingerprint, which
    is compared once. component_id is the smallest doc_id of the component: null ids don't
    count, so it is null where no row has one. No rows in, none out. Other columns don't matter.
    """
    rows = cut(fingerprints(docs, key, text), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    members = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with _row, 128 bits of hash of all columns as text, so that no two different rows are taken for one; nulls count, as xxhash64 leaves them out."""
    cells = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumn("_row", F.concat_ws("_", *(F.xxhash64(F.lit(salt), *cells) for salt in (1, 2))))


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group, given as (_row, group), the row of the smallest doc_id and then hash; rows without doc_id stay.

    Equal rows have one _row, and one of them stays; texts and other columns, null or not, aren't
    looked at. A row that no group names goes. No rows in, none out.
    """
    rows = with_row(docs)
    least = rows.where("doc_id is not null").select("_row", "doc_id").distinct().join(groups.distinct(), "_row").groupBy("group").agg(F.min(F.struct("doc_id", "_row")).alias("least"))
    named = rows.where("doc_id is not null").join(least.select(F.col("least._row").alias("_row")), "_row")
    order = Window.partitionBy("_row").orderBy("doc_id")
    return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id, with its columns.

    Null, empty and blank texts have no shingles and are copies of each other; of repeated rows one
    stays; whole texts count, however long; columns keep their names and values, whatever they are.
    Rows without doc_id can't be told apart and stay. No rows in, none out.
    """
    groups = simhash_groups(with_row(docs), radius, key="_row")
    return keep_least(docs, groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")))
