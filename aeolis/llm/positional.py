"""A positional inverted index over blocks of documents, and phrase and proximity search in it.

The index holds, for each block of documents, every term and its postings: the positions at
which it stands in the block, documents laid out one behind the other with gaps. A phrase is
searched by its terms' lists from the rarest on: each list is shifted by the term's offset in
the phrase and intersected with what is left, so a phrase with a term that the block doesn't
have costs nothing, and most others end with their second list. Proximity is the same
intersection with a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, session, spread

#: Words of a window of an item; an item of fewer is one window.
WIDTH = 10
#: Words that a proximity match may have each term away from its place.
SLACK = 2
#: Words of an index block; a document is never split, so one more may join.
BLOCK_WORDS = 1 << 20
#: Empty positions between documents; no window with its tolerance is as wide.
GAP = 64
#: Bytes of items that one pass over the index takes.
ITEM_BYTES = 16 << 20
#: Candidates intersected at once.
AT_ONCE = 1 << 20

#: Words are letters, digits and everything beyond ASCII; A-Z become a-z.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))

INDEX = "block long, ids {ids}, starts array<int>, n_words array<int>, terms binary, sizes binary, postings binary"
FOUND = "block long, doc int, item long, item_id string, kind string, start int, length int, item_start int"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, a row a block: its documents' keys, where each starts and its number of words, terms and postings.

    Postings are positions within the block, ascending by term, packed as differences. A null,
    empty or wordless text is a document without words. Write the result (common.cut) before it
    is searched: block numbers belong to the run that makes them.
    """
    kind = docs.schema[key].dataType.simpleString()
    key_type = pa.array([], docs.limit(0).select(key).toArrow().schema.field(0).type).type

    def packed(block: int, keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.r_[0, np.cumsum(sizes + GAP)[:-1]]
        flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
        position = np.arange(len(flat)) + np.repeat(np.arange(len(texts)) * GAP, sizes)
        line = np.sort(flat << 32 | position)
        counts = np.bincount(flat, minlength=len(number)).astype("<i4")
        steps = np.diff(line & 0xFFFF_FFFF, prepend=0).astype("<i4")
        columns = [
            pa.array([block], pa.int64()),
            pa.array([keys], pa.list_(key_type)),
            pa.array([starts.tolist()], pa.list_(pa.int32())),
            pa.array([sizes.tolist()], pa.list_(pa.int32())),
            *(pa.array([zstandard.compress(x, 1)], pa.binary()) for x in (b" ".join(number), counts.tobytes(), steps.tobytes())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "starts", "n_words", "terms", "sizes", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        block, held, keys, texts = first, 0, [], []
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                texts.append(terms_of(x.as_py()))
                held += len(texts[-1])
                if held >= BLOCK_WORDS:
                    yield packed(block, keys, texts)
                    block, held, keys, texts = block + 1, 0, [], []
        if keys:
            yield packed(block, keys, texts)

    return spread(docs.select(key, F.col(text).cast("binary"))).mapInArrow(run, INDEX.format(ids=f"array<{kind}>"))


def _int32(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), "<i4").astype(np.int64)


class Postings:
    """One block's lists, each ascending, as one sorted line of (term, position)."""

    def __init__(self, terms: bytes, sizes: bytes, postings: bytes):
        self.terms = zstandard.decompress(terms).split()
        self.sizes = _int32(sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.line = np.repeat(np.arange(len(self.terms)) << 32, self.sizes) + np.cumsum(_int32(postings))

    def near(self, term: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
        """Whether term[i] stands within slack of at[i]."""
        found = np.searchsorted(self.line, (term << 32) + np.maximum(at - slack, 0))
        inside = found < len(self.line)
        return inside & (self.line[np.minimum(found, len(self.line) - 1)] <= (term << 32) + at + slack) & (at + slack >= 0)


class Items:
    """Windows over the words of a block of items: numbers of terms, one behind the other."""

    def __init__(self, rows: list[tuple[int, Any, bytes | None]], width: int):
        self.number: dict[bytes, int] = {}
        self.rows = [r[0] for r in rows]
        self.ids = [r[1] for r in rows]
        words, item, offset, size, base = [], [], [], [], 0
        for k, (_, _, text) in enumerate(rows):
            own = [self.number.setdefault(w, len(self.number)) for w in terms_of(text)]
            n = len(own) - width + 1 if len(own) > width else bool(own)
            item += [k] * n
            offset += range(n)
            size += [min(width, len(own))] * n
            words += own
            base += len(own)
        self.words = np.array(words, np.int64)
        self.item, self.offset, self.size = (np.array(x, np.int64) for x in (item, offset, size))
        lengths = np.array([len(terms_of(t)) for _, _, t in rows], np.int64)
        self.start = (np.cumsum(lengths) - lengths)[self.item] + self.offset


def intersect(block: Postings, items: Items, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place): where each window's terms all stand within slack of their places, in the block's line."""
    local = np.full(len(items.number), -1, np.int64)
    for i, term in enumerate(block.terms):
        j = items.number.get(term)
        if j is not None:
            local[j] = i
    sizes = np.where(local >= 0, block.sizes[local], 0) if len(block.terms) else np.zeros(len(local), np.int64)
    shifts = np.arange(-slack, slack + 1)
    for k in np.unique(items.size).tolist():
        windows = np.flatnonzero(items.size == k)
        counts = sizes[items.words[items.start[windows, None] + np.arange(k)]]
        whole = counts.min(1) > 0
        windows, counts = windows[whole], counts[whole]
        rarest = np.argsort(counts, axis=1, kind="stable")
        least = np.take_along_axis(counts, rarest[:, :1], 1)[:, 0]
        parts = np.cumsum(least * len(shifts)) // AT_ONCE
        for part in np.unique(parts).tolist():
            some = np.flatnonzero(parts == part)
            own, order = windows[some], rarest[some]
            term = local[items.words[items.start[own, None] + order]]
            which = np.repeat(np.arange(len(own)), least[some])
            within = np.arange(len(which)) - np.repeat(np.cumsum(least[some]) - least[some], least[some])
            place = (block.line[block.first[term[which, 0]] + within] & 0xFFFF_FFFF) - order[which, 0]
            which, place = np.repeat(which, len(shifts)), (place[:, None] + shifts).ravel()
            if slack:  # several places of the rarest term can stand for one
                each = np.unique(which << 33 | place + GAP)
                which, place = each >> 33, (each & (1 << 33) - 1) - GAP
            for r in range(1, k):
                good = block.near(term[which, r], place + order[which, r], slack)
                which, place = which[good], place[good]
            yield own[which], place


def spans(items: Items, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, place, words, first word in the item): matches of consecutive windows of an item at consecutive places, joined."""
    item, offset = items.item[window], items.offset[window]
    order = np.lexsort((place, place - offset, item))
    item, offset, place, size = item[order], offset[order], place[order], items.size[window][order]
    same = (item[1:] == item[:-1]) & (place[1:] - offset[1:] == place[:-1] - offset[:-1]) & (place[1:] <= place[:-1] + size[:-1])
    fresh = np.r_[True, ~same][: len(item)]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:], len(item)][: len(at)] - 1
    return item[at], place[at], place[last] + size[last] - place[at], offset[at]


def search(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK, key: str = "item_id", text: str = "text") -> DataFrame:
    """(block, doc, item, item_id, kind, start, length, item_start): where windows of the items occur in the index.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is
    one window. kind "phrase": its words stand in the document one behind the other; joined
    where consecutive windows do. kind "near": at some place each word stands at most `slack`
    words from its own place, and not all at it; slack 0 leaves these out. doc is the
    document's number in its block, start and length count its words, item_start the item's.
    item is the row's number among items; null ids, repeated ids and repeated texts are items
    of their own. Null, empty and wordless items have no windows.

    The items are written once. Each pass broadcasts ITEM_BYTES of them at most and reads the
    index once; what they match is written to the shared folder.
    """
    if not 0 < width or width + 2 * slack >= GAP:
        raise ValueError(f"a window and its tolerance must be narrower than {GAP} words")
    spark = session(index.sparkSession)
    kept = cut(items.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("id"), F.col(text).cast("binary").alias("text")), "items")
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = -(-total // ITEM_BYTES)
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # ITEM_BYTES at most, on average
        shipped = spark.sparkContext.broadcast(Items([(r.row, r.id, bytes(r.text) if r.text is not None else None) for r in sorted(rows)], width))

        def run(batches: Iterator[pa.RecordBatch], shipped: Any = shipped) -> Iterator[pa.RecordBatch]:
            asked = shipped.value
            for batch in batches:
                for block, starts, *lists in zip(*(batch.column(c).to_pylist() for c in ("block", "starts", "terms", "sizes", "postings")), strict=True):
                    postings, starts = Postings(*lists), np.array(starts, np.int64)
                    exact = [np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *intersect(postings, asked, 0), strict=True)]
                    yield _found(block, starts, asked, "phrase", *exact)
                    if slack:
                        for window, place in intersect(postings, asked, slack):
                            new = ~np.isin(window << 33 | place + GAP, exact[0] << 33 | exact[1] + GAP)
                            yield _found(block, starts, asked, "near", window[new], place[new])

        out = out.unionByName(cut(index.select("block", "starts", "terms", "sizes", "postings").mapInArrow(run, FOUND), "matches"))
        shipped.destroy()
    return out


def _found(block: int, starts: np.ndarray, items: Items, kind: str, window: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    item, place, length, offset = spans(items, window, place)
    # a near match may begin up to SLACK words before its document
    doc = np.searchsorted(starts, place + GAP // 2, "right") - 1
    names = ["block", "doc", "item", "item_id", "kind", "start", "length", "item_start"]
    columns = [
        pa.array(np.full(len(item), block), pa.int64()),
        pa.array(doc, pa.int32()),
        pa.array(np.array(items.rows, np.int64)[item], pa.int64()),
        pa.array([items.ids[i] for i in item.tolist()], pa.string()),
        pa.array([kind] * len(item), pa.string()),
        *(pa.array(x, pa.int32()) for x in (place - starts[doc], length, offset)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def covered(spans: Column) -> Column:
    """Words in the union of spans (start, length)."""
    ends = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["length"]).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"].cast("long") - F.greatest(s["upto"], x["a"].cast("long")))).alias("n"), F.greatest(s["upto"], x["b"].cast("long")).alias("upto")
    )
    return F.aggregate(F.array_sort(ends), start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, items, near_items) of every row of docs.

    n_hit counts the words inside any occurrence of a window of `items` (see search); items are
    the different ids, as strings and in order, of items with one, near_items those of items
    with proximity matches only. Items without an id count for n_hit alone. A null or empty text
    has no words; repeated rows and rows without an id each stay; other columns don't matter.
    """
    index = cut(build_index(docs, key), "index")
    found = search(index, items, width, slack)
    phrase = F.col("kind") == "phrase"
    each = found.groupBy("block", "doc").agg(
        F.collect_set(F.when(phrase, F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set(F.when(phrase, F.col("item_id")))).alias("items"),
        F.sort_array(F.collect_set(F.when(~phrase, F.col("item_id")))).alias("near"),
    )
    rows = index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "row"))
    none = F.array().cast("array<string>")
    return rows.join(each, ["block", "doc"], "left").select(
        F.col("row.ids").alias(key),
        F.col("row.n_words").cast("long").alias("n_words"),
        F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.array_except("near", "items"), none).alias("near_items"),
    )
