import struct
from collections import Counter

import tiktoken

import corpus_pipeline
from aeolis.llm import bpe, mixing, toxicity
from aeolis.llm.common import cut, table

from .frames import LONG, awkward, empty, rows
from .test_dedup import brute_windows
from .test_nearcopy import brute_kept

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    stage = dict(corpus_pipeline.STAGES)
    steps, made = [docs], docs
    for _, f in corpus_pipeline.STAGES:
        made = cut(f(spark, made, DATA), "stage")
        steps.append(made)
    assert all(s.columns == docs.columns for s in steps[:-1]) and list(stage) == ["toxicity", "simhash", "substring_dedup", "mixing", "byte_bpe"]
    start, clean, single, short, mixed, coded = ([r.asDict() for r in s.collect()] for s in steps)

    model = toxicity.fit(docs, table(spark, DATA, "labels"))
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in start if model.score(r["text"]) < 0.5)

    assert sorted(r["doc_id"] for r in single) == brute_kept([(r["doc_id"], r["text"]) for r in clean])
    assert not {145, 177} & {r["doc_id"] for r in single}  # 7 and 11 bits of op7's fingerprint from documents 6 and 1

    want = brute_windows([(r["doc_id"], r["text"]) for r in single])
    before = {r["doc_id"]: r for r in single}
    assert len(short) == len(single)
    for r in short:
        _, removed, text = want[r["doc_id"]]
        assert r["text"] == (text if removed else before[r["doc_id"]]["text"])
        assert r["n_chars"] == (len(text) if removed else before[r["doc_id"]]["n_chars"])

    times = {r.doc_id: len(r.positions) for r in mixing.plan(steps[3]).collect()}
    assert {i: n for i, n in times.items() if n} == {i: sum(r["doc_id"] == i for r in mixed) for i in {r["doc_id"] for r in mixed}}

    with open(corpus_pipeline.RANKS, "rb") as f:
        known = tiktoken.Encoding("own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=bpe.read_ranks(f.readlines()), special_tokens={})
    stream = [r.doc.doc_id for r in mixing.materialize(steps[3]).collect()]
    coded.sort(key=lambda r: (r["stream_part"], r["stream_row"]))
    assert [r["doc_id"] for r in coded] == stream  # training order outlives the files
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        ids = list(struct.unpack(f"<{r['n_tokens']}I", bytes(r["token_ids"])))
        assert ids == known.encode_ordinary(texts[r["doc_id"]] or "")


def test_run_is_all_stages(spark):
    docs = table(spark, DATA, "documents")
    for _, f in corpus_pipeline.STAGES:
        docs = cut(f(spark, docs, DATA), "stage")
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "source", "stream_part", "stream_row", "token_ids", "n_tokens"]
    kept = ("doc_id", "source", "token_ids", "n_tokens")
    assert rows(got, *kept) == rows(docs, *kept)


def test_awkward_rows_stage_by_stage(spark):
    """What each stage keeps of nulls, blanks, repeated rows, near copies and a text of 60,000 words, row by row."""
    docs = awkward(spark)
    steps = [docs]
    for name, f in corpus_pipeline.STAGES[:-1]:
        steps.append(cut(f(spark, steps[-1], DATA), name))
        assert steps[-1].columns == docs.columns
    start, clean, single, short, mixed = ([tuple(r) for r in s.collect()] for s in steps)
    assert Counter(clean) == Counter(start)  # nothing toxic in them; null and blank texts and repeated rows stay
    ids = lambda made: sorted(r[0] for r in made if r[0] is not None)
    assert ids(single) == [1, 3, 6, 7, 9]  # 1 twice and 2 are one text, 3 to 5 have none, 8 is a near copy of 7
    assert Counter(r for r in single if r[0] is None) == Counter(r for r in start if r[0] is None)
    assert set(single) <= set(start)
    assert Counter(short) == Counter(single)  # what a text repeats of itself stays, and rows without id neither take nor lose
    # Small sources stop at three times their size; the long text's source takes what is left, which is near its one document.
    assert Counter((r[0], r[3]) for r in mixed) == {(1, "a"): 3, (7, "c"): 3, (9, "c"): 3, (None, None): 3, (6, "b"): 1}
    assert set(mixed) <= set(single) and LONG in {r[1] for r in mixed}
    coded = corpus_pipeline.encode_tokens(spark, steps[-1], DATA).collect()
    assert len(coded) == len(mixed) and all(r.n_tokens == len(r.token_ids) // 4 > 0 for r in coded)


def test_passages_are_cut_from_awkward_rows(spark):
    """The stage that cuts, given what the one before it would have taken out."""
    made = {r.doc_id: r for r in corpus_pipeline.cut_passages(spark, awkward(spark).where("doc_id >= 3"), DATA).collect()}
    given = {r.doc_id: r for r in awkward(spark).where("doc_id >= 3").collect()}
    assert set(made) == set(given)
    assert (made[8].text, made[8].n_chars) == ("tail", 4)
    assert all(made[i] == given[i] for i in given if i != 8)


def test_no_rows_stay_none(spark):
    made = empty(spark)
    for name, f in corpus_pipeline.STAGES[:-1]:
        made = cut(f(spark, made, DATA), name)
        assert made.columns == empty(spark).columns and made.isEmpty()
    assert corpus_pipeline.encode_tokens(spark, made, DATA).isEmpty()


def test_workers_give_buffers_back(spark):
    """Many blocks below the size that malloc learns to keep: the worker holds less than a quarter of them once they are freed."""
    table(spark, DATA, "documents")

    def held(batches):
        import re
        from pathlib import Path

        import numpy as np
        import pyarrow as pa

        def now():
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))

        list(batches)
        del_first = np.ones(3 << 20)
        del del_first  # glibc raises its threshold to the largest block freed
        before = now()
        blocks = [np.ones(1 << 17) for _ in range(100)]
        last = blocks.pop()
        full = now()
        del blocks
        yield pa.RecordBatch.from_arrays([pa.array([full - before]), pa.array([now() - before]), pa.array([len(last)])], names=["full", "after", "n"])

    got = spark.range(1, numPartitions=1).mapInArrow(held, "full long, after long, n long").first()
    assert got.full > 90_000 and got.after < got.full / 4
