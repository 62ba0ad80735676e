import base64
import hashlib
import random
import struct

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aeolis.llm import bpe, registry
from aeolis.llm.common import table
from aeolis.llm.registry import PATTERN, RANKS

from .frames import LONG, awkward, empty

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return bpe.read_ranks(f.readlines())


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.BpeCodec(ranks, PATTERN)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_same_ids_as_the_library(codec, known):
    random.seed(5)
    kinds = ["abcdeinst", "aab ", " \n\t.,!'", "éàüß1234 ", "".join(map(chr, range(32, 700)))]
    for _ in range(4000):
        text = "".join(random.choice(random.choice(kinds)) for _ in range(random.randint(0, 40)))
        assert ids(codec.encode(text)) == known.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=60))
def test_round_trip_of_any_text(text):
    with open(RANKS, "rb") as f:
        codec = _codec.setdefault(0, bpe.BpeCodec(bpe.read_ranks(f.readlines()), PATTERN)) if 0 not in _codec else _codec[0]
    assert codec.decode(codec.encode(text)) == text.encode()


_codec: dict = {}


def test_plain_form_of_the_pattern_cuts_alike(codec):
    chars = [chr(c) for c in range(0x2100) if not bpe.NOT_PLAIN(chr(c))]
    assert len(chars) > 300
    for c in chars:
        for text in (f"a{c}b", f"a {c} b", f"1{c}{c}2", f"x{c}'s {c}", f"{c} ", f" {c}{c}"):
            assert codec.plain(text) == codec.find(text)


def test_long_runs_are_linear(codec, known):
    for text in ("a" * 50_000, "ab" * 30_000, LONG):
        assert codec.decode(codec.encode(text)) == text.encode()
    assert ids(codec.encode("a" * 3000)) == known.encode_ordinary("a" * 3000)


def test_bytes_in_no_token():
    """A byte that no token holds is an error, not left out."""
    few = bpe.BpeCodec({b"a": 0, b"b": 1, b"ab": 2}, r"\S+")
    assert ids(few.encode("abba")) == [2, 1, 0]
    for text in ("acza", "c", "abc", "ca"):
        with pytest.raises(ValueError):
            few.encode(text)


def test_rank_files_of_one_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    made = []
    for k, tokens in enumerate(([b"a", b"b"], [b"a", b"b", b"ab"])):
        path = tmp_path / str(k) / "own.tiktoken"
        path.parent.mkdir()
        path.write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for i, t in enumerate(tokens)))
        made.append(ids(bytes(bpe.encode(docs, str(path), r"\S+").first().token_ids)))
    assert made == [[0, 1], [2]]


def test_registered_query(spark, known):
    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    got = registry.op1_byte_bpe(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    found = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for i, text in docs.items():
        want = known.encode_ordinary(text)
        assert found.pop(i) == (len(want), sha(struct.pack(f"<{len(want)}I", *want)), sha(text.encode()))
    assert not found


def test_awkward_rows(spark, known):
    out = bpe.decode(bpe.encode(awkward(spark), RANKS, PATTERN), RANKS, PATTERN)
    found = out.select("text", "token_ids", F.col("decoded")).collect()
    assert len(found) == 12
    for r in found:
        assert ids(bytes(r.token_ids)) == known.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty(spark), RANKS, PATTERN).count() == 0
