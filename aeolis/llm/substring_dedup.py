"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Every window's hash goes, packed with others of its range, to one task, which finds the smallest
document that holds it; the other documents get the hash back and cut the words it covers.
Within a chunk of documents equal windows are merged before the shuffle, so a passage that many
documents share reaches its task once a chunk, not once a document.

Ranges of hashes and groups of documents have one size, RANGE_BYTES of text. Up to PARTITIONS of
them each is a partition; beyond, a partition holds several, which its task sorts apart (Spark's
sort, which spills) and goes through one at a time, so that neither the number of partitions nor
what a task holds in memory grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import compress, groupby, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, shuffle_partitions, spread

WINDOW = 13
#: Bytes of text whose windows make a range of hashes, and whose documents make a group of ids: what a task holds.
RANGE_BYTES = 16 << 20
#: Partitions of a shuffle at most (64,000 at most, for 16-bit sorts).
PARTITIONS = 8192
#: Windows hashed, or dealt out, together in a task; a document is never split, so one more may join.
CHUNK = 1 << 21
#: Rabin-Karp base (odd, so that it has an inverse modulo 2^64) and the word hashes' seed.
BASE, SEED = 0x9E3779B97F4A7C15, 13
#: Bits of the second hash that tell windows apart beside the 64 of the first (24 took 4.06 x the input of disk).
CHECK_BITS = 16
#: Remembered word hashes; forgotten all at once beyond this, between documents.
WORDS = 300_000
#: A doc_id with more than this part of all rows is dealt out in so many parts, by its texts. There are fewer such ids than this.
SALTS = 1024
_SALT_STEP = 0x9E3779B97F4A7

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class WordHashes(dict):
    """A number for each word; its two hashes stand at that place in `pair`."""

    def __init__(self):
        self.pair = np.empty((2, 1 << 12), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == self.pair.shape[1]:
            self.pair = np.concatenate([self.pair, np.empty_like(self.pair)], axis=1)
        high, low = divmod(xxhash.xxh3_128_intdigest(word, SEED), 1 << 64)
        self.pair[0, at], self.pair[1, at] = low, high
        return at


_word_hashes = WordHashes()


def window_hashes(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hash and check of each run of `window` words, in order; none if there are fewer.

    Each is the sum of value(word) * BASE^position over the window, from prefix sums, freed of
    its place and mixed so that any bits of it can choose a task. The words' values for the
    check (CHECK_BITS of it) are others than those for the hash, so a window is known by both.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    if len(_word_hashes) > WORDS:
        _word_hashes.clear()
    at = np.fromiter(map(_word_hashes.__getitem__, words), np.int64, len(words))
    up, down = powers(len(words))
    made = []
    for values in _word_hashes.pair:
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(values[at] * up, out=sums[1:])
        h = (sums[window:] - sums[:n]) * down[:n]
        for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> np.uint64(33)) * np.uint64(multiplier)
        made.append(h ^ h >> np.uint64(33))
    return made[0], (made[1] >> np.uint64(64 - CHECK_BITS)).astype(np.uint16)


def names(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """One number of both, by which a document knows its own windows."""
    return hashes ^ checks.astype(np.uint64) << np.uint64(64 - CHECK_BITS)


class Windows(NamedTuple):
    """Windows of documents. Those that need no comparison are known by their name, and checks are 0."""

    ids: np.ndarray
    salts: np.ndarray
    hashes: np.ndarray
    checks: np.ndarray

    def take(self, at: np.ndarray) -> Windows:
        return Windows(*(x[at] for x in self))

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        ids = zstandard.compress(np.diff(self.ids, prepend=0).astype("<i8").tobytes(), 1)
        salts = zstandard.compress(self.salts.astype("<i2").tobytes(), 1) if self.salts.any() else b""
        checks = self.checks.astype("<u2").tobytes() if self.checks.any() else b""
        return ids, salts, self.hashes.astype("<u8").tobytes(), checks

    @staticmethod
    def unpack(ids: bytes, salts: bytes, hashes: bytes, checks: bytes = b"") -> Windows:
        ids = np.cumsum(np.frombuffer(zstandard.decompress(ids), "<i8"))
        salts = np.frombuffer(zstandard.decompress(salts), "<i2") if salts else np.zeros(len(ids), np.int16)
        checks = np.frombuffer(checks, "<u2") if checks else np.zeros(len(ids), np.uint16)
        return Windows(ids, salts, np.frombuffer(hashes, "<u8"), checks)

    @staticmethod
    def joined(parts: list[Windows]) -> Windows:
        return Windows(*map(np.concatenate, zip(*parts, strict=True)))


#: Packed windows: key is what they are dealt by; settled ones are known to stand in a smaller document.
_PACKED = pa.schema([("key", pa.int32()), ("settled", pa.bool_()), ("ids", pa.binary()), ("salts", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary())])
_PACKED_DDL = "key int, settled boolean, ids binary, salts binary, hashes binary, checks binary"


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else []
    return list(pairwise(edges))


def _packed(source: Iterable[tuple[bool, Windows]], key: Callable[[Windows], np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
    """The source's (settled, windows) as packed rows by key, about `chunk` windows at a time."""

    def rows() -> Iterator[tuple]:
        for settled, parts in held.items():
            found = Windows.joined(parts)
            keys = key(found).astype(np.uint16)
            at = np.argsort(found.ids, kind="stable")
            at = at[np.argsort(keys[at], kind="stable")]
            found, keys = found.take(at), keys[at]
            for a, b in _runs(keys):
                yield int(keys[a]), settled, *found.take(slice(a, b)).pack()

    held, n = {}, 0
    for settled, part in source:
        if len(part.ids):
            held.setdefault(settled, []).append(part)
            n += len(part.ids)
        if n >= chunk:
            yield _batch(rows())
            held, n = {}, 0
    if n:
        yield _batch(rows())


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, Windows]]:
    for batch in batches:
        for key, settled, *packed in zip(*(c.to_pylist() for c in batch.select(_PACKED.names).columns), strict=True):
            yield key, settled, Windows.unpack(*packed)


def _in_order(hashes: np.ndarray, checks: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows, each window's rows by `then`, and which rows in it are the first of their window."""
    order = np.lexsort((then, hashes))
    h, c = hashes[order], checks[order]
    same, differs = h[1:] == h[:-1], c[1:] != c[:-1]
    if (same & differs).any():  # several windows have one hash
        order = np.lexsort((then, checks, hashes))
        h, c = hashes[order], checks[order]
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    start = np.ones(len(order), bool)
    start[1:] = ~same
    return order, start


def _merged(ids: list[int], salts: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[bool, Windows]]:
    """A chunk's windows: open ones of the smallest document that the chunk has of each, settled ones of the others."""
    ids, salts, order = np.array(ids, np.int64), np.array(salts, np.int16), np.lexsort((salts, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(salts[order]) != 0)
    unit = np.repeat((np.cumsum(new) - 1).astype(np.int32), [len(parts[i][0]) for i in order])
    hashes, checks = (np.concatenate([parts[i][k] for i in order]) for k in (0, 1))
    ids, salts = ids[order][new], salts[order][new]
    order, start = _in_order(hashes, checks, unit)
    unit, hashes, checks = unit[order], hashes[order], checks[order]
    once = start.copy()
    once[1:] |= unit[1:] != unit[:-1]
    later = ids[unit] > ids[unit[start]][np.cumsum(start) - 1]
    for settled in (False, True):
        at = np.flatnonzero(once & (later == settled))
        u, h, c = unit[at], hashes[at], checks[at]
        yield settled, Windows(ids[u], salts[u], names(h, c), np.zeros_like(c)) if settled else Windows(ids[u], salts[u], h, c)


def _dealt(units: DataFrame, partitions: int, window: int) -> DataFrame:
    """Packed windows of chunks of documents (doc_id, salt, text), by range of hash."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Windows]]:
        ids, salts, parts, held = [], [], [], 0
        for batch in batches:
            for doc, salt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, checks = window_hashes(text.split(), window)
                if len(hashes):
                    ids.append(doc)
                    salts.append(salt)
                    parts.append((hashes, checks))
                    held += len(hashes)
                if held >= CHUNK:
                    yield from _merged(ids, salts, parts)
                    ids, salts, parts, held = [], [], [], 0
        if held:
            yield from _merged(ids, salts, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(chunks(batches), lambda w: w.hashes % np.uint64(partitions), CHUNK)

    some = units.where("doc_id is not null and text is not null").select("doc_id", "salt", F.col("text").cast("binary"))
    return spread(some).mapInArrow(run, _PACKED_DDL)


def _group(ids: np.ndarray, salts: np.ndarray, groups: int) -> np.ndarray:
    """As _group_of, for arrays."""
    u = (ids ^ salts.astype(np.int64) * _SALT_STEP).astype(np.int64).view(np.uint64)
    return (u ^ u >> np.uint64(7) ^ u >> np.uint64(20)).view(np.int64) % groups


def _group_of(doc_id: Column, salt: Column, groups: int) -> Column:
    u = doc_id.bitwiseXOR(salt.cast("long") * _SALT_STEP)
    return F.pmod(u.bitwiseXOR(F.shiftrightunsigned(u, 7)).bitwiseXOR(F.shiftrightunsigned(u, 20)), F.lit(groups))


def ranges_for(docs: DataFrame) -> int:
    """Ranges of hashes (and groups of ids) for these texts: their number grows with the input, so that a range's size doesn't."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(shuffle_partitions(session(docs.sparkSession)), -(-size // RANGE_BYTES))


def hot_ids(docs: DataFrame) -> list[int]:
    """Ids that more than one row in SALTS has: fewer than SALTS, whatever the table."""
    rows = docs.count()
    each = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").groupBy("id").count()
    return [r.id for r in each.where((F.col("count") > 1) & (F.col("count") * SALTS > rows)).select("id").collect()]


def later_windows(units: DataFrame, partitions: int, pieces: int, window: int = WINDOW) -> DataFrame:
    """Packed names of windows that a document with a smaller id holds too, by partition of their documents."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(((settled, w) for _, settled, w in _read(batches)), lambda w: w.hashes // np.uint64(partitions) % np.uint64(pieces), CHUNK)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Windows]]:
        for _, rows in groupby(_read(batches), key=lambda r: r[0]):
            still_open = []
            for _, settled, found in rows:
                if settled:
                    yield True, found
                else:
                    still_open.append(found)
            if still_open:
                w = Windows.joined(still_open)
                order, start = _in_order(w.hashes, w.checks, w.ids)
                w = w.take(order)
                later = w.take(w.ids > w.ids[start][np.cumsum(start) - 1])
                yield True, later._replace(hashes=names(later.hashes, later.checks), checks=np.zeros_like(later.checks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(judged(batches), lambda w: _group(w.ids, w.salts, partitions * pieces) % partitions, CHUNK)

    dealt = _dealt(units, partitions, window).repartitionById(partitions, F.col("key"))
    if pieces > 1:
        dealt = dealt.mapInArrow(apart, _PACKED_DDL).sortWithinPartitions("key")
    else:
        dealt = dealt.withColumn("key", F.lit(0))
    return dealt.mapInArrow(run, _PACKED_DDL)


def covered(n: int, own: np.ndarray, later: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each of n words whether a window covers it whose name, of its own in order, is among the later ones."""
    found = np.isin(own, later)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, np.flatnonzero(found), 1)
    np.add.at(depth, np.flatnonzero(found) + window, -1)
    return np.cumsum(depth)[:-1] > 0


class LaterWindows:
    """The names to cut by, by document, of one group."""

    def __init__(self):
        self.parts: list[Windows] = []
        self.sorted: Windows | None = None

    def of(self, doc: int, salt: int) -> np.ndarray:
        if self.sorted is None:
            found = Windows.joined(self.parts) if self.parts else Windows(*(np.empty(0, t) for t in (np.int64, np.int16, np.uint64, np.uint16)))
            self.sorted = found.take(np.lexsort((found.salts, found.ids)))
        ids, salts, hashes, _ = self.sorted
        a, b = np.searchsorted(ids, [doc, doc + 1]) if doc < np.iinfo(np.int64).max else (np.searchsorted(ids, doc), len(ids))
        return hashes[a + np.searchsorted(salts[a:b], salt) : a + np.searchsorted(salts[a:b], salt, "right")]


def intervals(cover: np.ndarray) -> list[int]:
    """Maximal runs of covered words: start, end, start, end, ... (ends excluded)."""
    return np.flatnonzero(np.diff(cover, prepend=False, append=False)).tolist()


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = (), respace: bool = True) -> DataFrame:
    """(doc_id, carried, kept, n_words, n_removed, removed) of every document.

    Words are what stands between space, tab, newline, vertical tab, form feed and return. A
    word goes if a window of `window` words covers it that also starts in a document with a
    smaller doc_id. kept joins what is left with single spaces; removed lists the maximal
    intervals of removed words (start, end, start, ...). Shorter texts lose nothing. Null and
    empty texts have no words and kept is empty. Rows without doc_id neither lose nor take
    words; rows of one doc_id are judged as one document, so they take none from each other,
    and each row stays. carry: other columns of docs to keep, in the struct carried, where no
    name of theirs can clash. Without respace a text that loses nothing is kept as it stands.

    Texts meet the names of their windows by groups of ids, an id of many rows by its texts as
    well; in each group the names come first and are held, the texts stream by. Rows without id
    aren't shuffled. Rows that share id and text are one task's. Windows count as equal if 64
    bits of hash and CHECK_BITS of another agree: about n^2 / 2^81 false repeats among n windows.
    """
    ranges = ranges_for(docs)
    partitions = min(PARTITIONS, ranges)
    pieces = -(-ranges // partitions)
    groups = partitions * pieces
    doc_id = F.col("doc_id").cast("long")
    hot = hot_ids(docs)
    salt = F.when(doc_id.isin(hot), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(0).cast("int") if hot else F.lit(0)
    units = docs.select(doc_id.alias("doc_id"), salt.alias("salt"), "text")
    texts = docs.select(doc_id.alias("doc_id"), salt.alias("salt"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.struct(F.lit(0), *carry).alias("other"))
    group = _group_of(F.col("doc_id"), F.col("salt"), groups)
    placed = {"is_text": F.lit(True), "part": F.pmod(group, F.lit(partitions)).cast("int"), "key": F.floor(group / partitions).cast("int")}
    late = later_windows(units, partitions, pieces, window).select(F.lit(False).alias("is_text"), F.col("key").alias("part"), F.lit(0).alias("key"), "ids", "salts", "hashes")
    both = texts.where("doc_id is not null").withColumns(placed).unionByName(late, allowMissingColumns=True).repartitionById(partitions, F.col("part")).drop("part")
    added = T.StructType().add("kept", "binary").add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*texts.select("doc_id", "other").schema, *added])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's names by group; its texts, whose group is known, go through."""

        def packs() -> Iterator[tuple[bool, Windows]]:
            for ids, salts, hashes in zip(*(rest.column(c).to_pylist() for c in ("ids", "salts", "hashes")), strict=True):
                yield True, Windows.unpack(ids, salts, hashes)

        for batch in batches:
            is_text = batch.column("is_text")
            yield batch.filter(is_text)
            rest = batch.filter(pa.array(~is_text.to_numpy(zero_copy_only=False)))
            for made in _packed(packs(), lambda w: _group(w.ids, w.salts, groups) // partitions, CHUNK):
                known = {"is_text": pa.array([False] * made.num_rows)} | {c: made.column(c) for c in ("key", "ids", "salts", "hashes")}
                yield pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(made.num_rows, f.type) for f in batch.schema], schema=batch.schema)

    def cut(texts: pa.RecordBatch, later: LaterWindows) -> pa.RecordBatch:
        kept, n_words, n_removed, removed = [], [], [], []
        for doc, salt, text in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "salt", "text")), strict=True):
            words, known = text.split(), () if doc is None else later.of(doc, salt)
            gone = covered(len(words), names(*window_hashes(words, window)), known, window) if len(known) else np.zeros(len(words), bool)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            removed.append(intervals(gone))
            kept.append(b" ".join(compress(words, (~gone).tolist())) if n_removed[-1] else b" ".join(words) if respace else text)
        made = [pa.array(kept, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("other"), *made], names=["doc_id", "other", "kept", "n_words", "n_removed", "removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, at = LaterWindows(), None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for a, b in _runs(keys):
                part = batch.slice(a, b - a)
                if keys[a] != at:
                    later, at = LaterWindows(), keys[a]
                is_text = part.column("is_text").to_numpy(zero_copy_only=False)
                packs = part.filter(pa.array(~is_text))
                for packed in zip(*(packs.column(c).to_pylist() for c in ("ids", "salts", "hashes")), strict=True):
                    later.parts.append(Windows.unpack(*packed))
                if is_text.any():
                    yield cut(part.filter(pa.array(is_text)), later)

    def without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch, LaterWindows())

    if pieces > 1:
        both = both.mapInArrow(apart, both.schema)
    done = both.sortWithinPartitions("key", "is_text").mapInArrow(run, schema)
    done = done.unionByName(texts.where("doc_id is null").mapInArrow(without_id, schema))
    return done.select("doc_id", F.col("other").alias("carried"), "kept", "n_words", "n_removed", "removed")
