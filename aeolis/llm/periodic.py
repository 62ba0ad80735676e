"""Periodic runs: seed and extend along the diagonals of a document's comparison with itself.

Words q apart match along diagonal q. A run of period q has at least 3q matches in a row there,
so for the periods from 2^j to 2^(j+1) - 1 every run holds a k-gram, k = 3 * 2^j, that recurs q
words on (five words for period 1). k-grams are named exactly, level by level, each name a pair
of the level before, and the names are the index. A k-gram of a run recurs after its period and
not before (two overlapping repeats would make the smaller distance the period), so only
neighbouring occurrences are paired: a document has at most as many pairs as words at a level,
however often one k-gram stands in it. Pairs are extended to both sides word by word, and a
table of how far each lag is covered leaves out pairs inside a run already extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words first compared at once while a pair is extended; doubled from step to step.
STEP = 64

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:long,length:long,period:long>>"


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each different pair (left[i], right[i]); both are numbers below their length or so."""
    return np.unique(left * (np.int64(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64) if len(left) else left


def levels(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(least period, first period beyond, names of the k-grams) of each level, up to a fourth of the words."""
    n = len(ids)
    two = _named(ids[:-1], ids[1:])
    three = _named(two[:-1], ids[2:])
    yield 1, 2, _named(three[:-2], two[3:])
    names, half, low = three, 3, 2
    while LEAST_PERIODS * low <= n:
        names, half = _named(names[:-half], names[half:]), 2 * half
        yield low, 2 * low, names
        low *= 2


def seeds(names: np.ndarray, low: int, beyond: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and lags of neighbouring occurrences of one name, by lag and place; whether any name recurs at all."""
    order = np.argsort(names, kind="stable")
    again = names[order[1:]] == names[order[:-1]]
    lag = order[1:] - order[:-1]
    wanted = again & (lag >= low) & (lag < beyond)
    at, lag = order[:-1][wanted], lag[wanted]
    by_lag = np.lexsort((at, lag))
    return at[by_lag], lag[by_lag], bool(again.any())


def _ahead(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on whose word differs from the one `lag` ahead."""
    end, step = len(ids) - lag, STEP
    while at < end:
        upto = min(end, at + step)
        wrong = np.flatnonzero(ids[at:upto] != ids[at + lag : upto + lag])
        if len(wrong):
            return at + int(wrong[0])
        at, step = upto, 2 * step
    return end


def _back(ids: np.ndarray, at: int, lag: int, least: int) -> int:
    """The first place of the stretch of matches that ends before `at`, not before `least`."""
    step = STEP
    while at > least:
        start = max(least, at - step)
        wrong = np.flatnonzero(ids[start:at] != ids[start + lag : at + lag])
        if len(wrong):
            return start + int(wrong[-1]) + 1
        at, step = start, 2 * step
    return least


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start and period.

    A run is a stretch of words with smallest period q, of LEAST_WORDS words and LEAST_PERIODS
    periods at least, that neither neighbouring word extends.
    """
    if len(words) < LEAST_WORDS:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for low, beyond, names in levels(ids):
        places, lags, recurring = seeds(names, low, beyond)
        edges = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lag, covered, k = int(lags[a]), 0, a
            while k < b:
                start = _back(ids, int(places[k]), lag, covered)
                end = _ahead(ids, int(places[k]), lag)
                if end - start + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                    found.append((start, end - start + lag, lag))
                covered = end + 1  # the word at `end` doesn't match
                k = a + int(np.searchsorted(places[a:b], covered))
        if not recurring:  # nor does any longer k-gram
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what repeats each run's first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    stays = (np.cumsum(depth)[:-1] == 0).tolist()
    return [w for w, s in zip(words, stays, strict=True) if s]


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, n_words, runs, collapsed) of every row; doc holds the row's columns but the text, so that no name can clash.

    Words are what stands between space, tab, newline, vertical tab, form feed and return. runs
    are ordered by start and period (see runs_of); collapsed joins by single spaces the words
    that no run contains after its first period. Null, empty and blank texts have no words, no
    runs and an empty collapsed; texts of any length are taken whole, each in one task, in
    memory in proportion to its words. Repeated rows, ties and null ids are rows like any other;
    no rows in, none out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for x in batch.column(1):
                words = (x.as_py() or b"").split()
                own = runs_of(words)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                collapsed.append(b" ".join(kept_words(words, own) if own else words))
            made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc", "n_words", "runs", "collapsed"])

    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("doc"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"doc {kind}, n_words long, runs {RUNS}, collapsed binary")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null without runs."""
    ahead = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(ahead(a, r), r).otherwise(a))
