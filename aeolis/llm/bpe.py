"""Byte-level BPE: Aho-Corasick longest matches, backtracking over compatible neighbours.

A token sequence is the one that merging would give exactly if each two neighbours, merged on
their own, stay as they are. So the encoder walks the text once, takes the longest token that
fits its left neighbour, falls back to shorter ones, and never tries a dead position twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import session, spread

#: Entries in each of the two generations of a cache; longer strings are not kept.
CACHE_ENTRIES, CACHE_LENGTH = 250_000, 48
#: Remembered neighbour decisions; forgotten all at once beyond this.
PAIR_ENTRIES = 1_000_000
#: Bytes of a rank file that are sent to the executors at most.
MOST_BYTES = 64 << 20

#: This pattern (fixed value) is also known in a form for the faster `re`, for texts of these characters only.
PLAIN_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_SIGNS = r"!-/:-@\[-`{-~" + "\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e"
NOT_PLAIN = re.compile(rf"[^\t-\r 0-9{_LETTERS}{_SIGNS}]").search
PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\s+(?!\S)|\s+").findall


class BpeCodec:
    """Encoder and decoder for one rank file (rank = id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.trie.add_word(token.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.find = regex.compile(pattern).findall
        self.plain = PLAIN if pattern == PLAIN_FOR else None
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.pieces = Memo(lambda piece: self.pack(self.merge(piece.encode())))

    # -- what merging does ---------------------------------------------------------------
    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.parts:
            raw = self.tokens[token]
            seq = [raw[i : i + 1] for i in range(len(raw))]
            while len(seq) > 2:
                rank, at = min((self.ranks.get(seq[i] + seq[i + 1], 1 << 32), i) for i in range(len(seq) - 1))
                if rank == 1 << 32:
                    raise ValueError(f"token {token} cannot be merged from bytes")
                seq[at : at + 2] = [seq[at] + seq[at + 1]]
            self.parts[token] = (self.ranks[seq[0]], self.ranks[seq[1]]) if len(seq) == 2 else None
        return self.parts[token]

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that stand at one edge while this one is merged, each with the rank that ends it."""
        key = (token, right)
        if key not in self.edges:
            spine, until = [], float("inf")
            while True:
                spine.append((token, until))
                parts = self.split(token)
                if parts is None:
                    break
                until, token = token, parts[right]
            self.edges[key] = spine
        return self.edges[key]

    def compatible(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges that build both tokens.

        Of two places with one rank the left one merges first; so a tie goes to the border
        against the right token's own merge, and to the left token's own against the border.
        """
        for a, a_until in self.edge(left, True):
            for b, b_until in self.edge(right, False):
                across = self.ranks.get(self.tokens[a] + self.tokens[b])
                if across is not None and (at := max(across, a, b)) < a_until and at <= b_until:
                    return False
        return True

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if none."""
        raw = self.tokens[token]
        for n in range(len(raw) - 1, 0, -1):
            if (found := self.ranks.get(raw[:n])) is not None:
                return found
        return -1

    # -- encoding ------------------------------------------------------------------------
    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        greedy = [token for _, token in self.trie.iter_long(piece.decode("latin-1"))]
        if sum(len(self.tokens[t]) for t in greedy) == len(piece) and all(map(self.fits, greedy, greedy[1:])):
            return greedy  # no byte was skipped
        return self.backtrack(piece)

    def fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[key] = self.compatible(left, right)
        return found

    def backtrack(self, piece: bytes) -> list[int]:
        """Ids of one piece whose longest tokens in a row don't fit each other."""
        n, tokens, shorter = len(piece), self.tokens, self.shorter
        longest = [-1] * (n + 1)
        for end, token in self.trie.iter(piece.decode("latin-1")):
            longest[end + 1 - len(tokens[token])] = token  # ends ascend: the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end]:
                    if last < 0 or self.fits(last, token):
                        break
                following = shorter.get(token)
                if following is None:
                    following = shorter[token] = self.next_shorter(token)
                token = following
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:  # nothing goes on from here
                if not out:
                    raise ValueError("a byte of the text is in no token")
                dead[at] = 1
                at -= len(tokens[out.pop()])
                token = last
        return out

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return (self.find if self.plain is None or NOT_PLAIN(text) else self.plain)(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Memo(dict):
    """A function's results in two generations: when the young one is full it becomes the old one."""

    def __init__(self, make: Callable[[str], bytes | None]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes | None:
        found = self.old[key] if key in self.old else self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_codecs: dict[tuple[str, str], BpeCodec] = {}


def codec(ranks: Broadcast[bytes], digest: str, pattern: str) -> BpeCodec:
    """One codec a worker process for each rank file, known by its digest."""
    if (digest, pattern) not in _codecs:
        _codecs[digest, pattern] = BpeCodec(read_ranks(ranks.value.splitlines()), pattern)
    return _codecs[digest, pattern]


def _ship(df: DataFrame, ranks_path: str) -> tuple[Broadcast[bytes], str]:
    """The rank file for the workers; its size is that of a vocabulary, MOST_BYTES at most."""
    with open(ranks_path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{ranks_path} is larger than a rank file can be")
    return session(df.sparkSession).sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def _append(df: DataFrame, column: str, of: str, make: str, ranks_path: str, pattern: str, keep: bool) -> DataFrame:
    """df with one more binary column, made from column `of` by a method of the codec; of stays if keep."""
    shipped, digest = _ship(df, ranks_path)
    kept = [i for i, c in enumerate(df.columns) if c != column and (keep or c != of)]
    schema = T.StructType([*(df.schema[i] for i in kept), T.StructField(column, T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        method = getattr(codec(shipped, digest, pattern), make)
        empty = "" if make == "encode" else b""
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                made = [method(empty if x is None else x) for x in part.column(of).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(made, pa.binary())], names=names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", column: str = "token_ids", keep: bool = True) -> DataFrame:
    """Adds the ids of each whole text, as little-endian unsigned 32-bit integers; drops the text unless keep.

    A null or empty text has no ids. Every row stays, repeated rows too; other columns are
    untouched. Work is by row, so no row waits for another; texts of any length are walked in
    linear time. A column named as the new one is replaced. Characters that the regex library's
    Unicode tables don't know yet are cut as unassigned ones.
    """
    return _append(spread(df), column, text, "encode", ranks_path, pattern, keep)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for; null and empty ids decode to no bytes, unknown ids are an error.

    Every row stays, repeated rows too, and other columns are untouched, but one named as the
    new one is replaced. Work is by row and linear in its length. No rows in, none out.
    """
    return _append(df, column, ids, "decode", ranks_path, pattern, True)
