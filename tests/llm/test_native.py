import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aeolis.llm import chat, mixing, sharding
from aeolis.llm.common import word_count

from .frames import awkward, empty, rows


def jump(key, n):
    key, at, to = key % (1 << 64), -1, 0
    while to < n:
        at = to
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        to = int((to + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_is_the_papers(spark):
    keys = [*range(300), -1, -(2**63), 2**63 - 1, 10**15]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100):
        got = {r[0]: r[1] for r in df.select("k", sharding.jump_shard(F.col("k"), n)).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_shards_grow_into_the_new_one(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("old").alias("slot"))
    got = sharding.shard_documents(df, 8).collect()
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} == {8}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))
    assert max(sum(r.shard == s for r in got) for s in range(8)) < 800


def test_no_slice_holds_a_hot_id(spark):
    """A third of all rows without an id: none of the numbered slices has more than a few of them."""
    df = spark.range(3000).select(F.expr("if(id % 3 = 0, null, id)").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    plan = sharding.shard_documents(df, 8)
    got = plan.where("doc_id is null").collect()
    assert len(got) == 1000 and {r.shard for r in got} == {jump(0, 8)}
    # slots are dealt slice by slice: a slice of 1000 rows would leave them in one run
    slots = sorted(r.slot for r in got)
    assert max(len(list(run)) for _, run in itertools.groupby(enumerate(slots), lambda x: x[1] - x[0])) < 50
    assert sorted(r.slot for r in plan.where(f"shard = {jump(0, 8)}").collect()) == list(range(plan.where(f"shard = {jump(0, 8)}").count()))


def test_shard_awkward_rows(spark):
    got = sharding.shard_documents(awkward(spark), 3).collect()
    assert len(got) == 12
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.shard) == (len(raw) + 1, zlib.crc32(raw), jump(r.doc_id or 0, 3))
    assert sharding.shard_documents(empty(spark), 3).count() == 0


def waterfill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    import random

    r = random.Random(seed)
    names = [None, "a", "é", "z", "B", "\U0001f600"]
    docs = [(i, names[min(int(r.expovariate(0.8)), 5)], " ".join(["w"] * int(r.expovariate(0.02)))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, got = waterfill(sizes), mixing.plan(df).collect()
    assert sum(r.rows for r in got) == 600
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and abs(mine[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken * r.rows for r in mine) - want[s]) <= max(0.06 * want[s], 30)
        assert all(r.taken == r.size * len(r.positions) and len(r.positions) <= 3 and all(0 <= p <= 1 for p in r.positions) for r in mine)
    assert rows(mixing.plan(df.repartition(7)), "*") == rows(mixing.plan(df), "*")


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r.doc_id, r.source): r for r in mixing.plan(docs).collect()}
    assert got[1, "a"].rows == 2 and got[3, "a"].taken == 0 and got[4, None].size == 0
    stream = mixing.materialize(docs).collect()
    assert all(r.doc.size == "x" for r in stream)
    assert mixing.plan(empty(spark)).count() == 0 and mixing.materialize(empty(spark)).count() == 0


def test_words_at_any_end(spark):
    """Only the six separators end a word; Java's line ends at a text's end don't."""
    texts = ["", " ", "a", " a ", "a\u2028", "word \u2028", "word \u0085", "a b \u2029", "\u00a0", "\n\r\x0b a\x0c", "a\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.n for r in df.select("i", word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_places_are_the_range_sort(spark):
    docs = awkward(spark).unionByName(awkward(spark).where("doc_id > 5").withColumn("source", F.lit("z")))
    planned = mixing.placed(mixing.plan(docs)).collect()
    copies = sorted((p, r.doc_id is not None, r.doc_id, str(r.source), r.size, k, r) for r in planned for k, p in enumerate(r.positions) for _ in range(r.rows))
    first = {}
    for n, (p, *_, r) in enumerate(copies):
        first.setdefault((r.doc_id, r.source, r.size), (p, n))
    assert sum(r.rows for r in planned) == docs.count()
    for r in planned:
        assert (r.first_position, r.place) == first.get((r.doc_id, r.source, r.size), (None, None))
    stream = mixing.materialize(docs).collect()
    assert [r.position for r in stream] == [c[0] for c in copies]
    assert mixing.placed(mixing.plan(empty(spark))).count() == 0


def test_stream_order_outlives_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 90)) for i in range(900)], "doc_id long, source string, text string")
    stream = mixing.materialize(docs)
    stream.select("doc.*").write.parquet(f"{tmp_path}/stream")
    read = mixing.stream_order(spark.read.parquet(f"{tmp_path}/stream"))
    assert [r.doc_id for r in read.orderBy("stream_part", "stream_row").collect()] == [r.doc.doc_id for r in stream.collect()]
    assert mixing.stream_order(docs).where("stream_part is not null or stream_row is not null").count() == 0


def test_curriculum_follows_the_schedule(spark):
    """Of a source that leans to the end, less than half of the words comes in the first half."""
    docs = [(i, s, "w w w w") for s in ("a", "b", "c") for i in range(s == "a", 300)]
    early = {}
    for r in mixing.plan(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect():
        for p in r.positions:
            n, k = early.get(r.source, (0, 0))
            early[r.source] = (n + 1, k + (p < 0.5))
    part = {s: k / n for s, (n, k) in early.items()}
    assert abs(part["a"] - 0.375) < 0.02 and abs(part["b"] - 0.5) < 0.02 and abs(part["c"] - 0.625) < 0.02


texts = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\e", "\\l", "<", "[", "x", "\n", "é", "\U0001f600"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>"]), texts), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_events(chat.as_events(df)))
    got = out.select(chat.turns_of(F.col("formatted")), chat.learned_text(F.col("formatted"), F.col("loss"))).first()
    assert [tuple(t) for t in got[0]] == turns
    assert got[1] == "".join(t for r, t in turns if r == "assistant")


def test_turns_as_streamed_events(spark):
    """A turn comes as a draft, a new start and deltas; the fold leaves the turn alone."""
    long = "".join(f"{i}<[\\\n\U0001f600" for i in range(500))
    turns = [(1, 0, "user", "short"), (1, 1, "assistant", long), (1, 1, "assistant", "same turn"), (1, 2, None, None), (2, 0, "assistant", ""), (None, None, "user", "x" * 64)]
    df = spark.createDataFrame([(*t, "y", 1) for t in turns], "conv_id long, turn long, role string, text string, kind string, seq int")
    log = chat.as_events(df).cache()
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["edit"] == 3 and kinds["regenerate"] == 3 and kinds["delta"] > len(turns) + len(long) // chat.PIECE - 1
    assert log.where("text like '%(draft)%'").count() == len(turns)
    got = rows(chat.fold_events(log.repartition(4)), "conv_id", "role", "text")
    assert got == sorted([(c, r or "", t or "") for c, _, r, t in turns], key=repr)


def test_chat_awkward_rows(spark):
    """Empty, null and very long texts, repeated rows and clashing names."""
    docs = awkward(spark).select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.when(F.col("source") == "a", "assistant").alias("role"), "text", "size", F.lit("x").alias("formatted"), F.lit(1).alias("loss"))
    out = chat.render(chat.fold_events(chat.as_events(docs)))
    got = {r.conv_id: r for r in out.select("conv_id", chat.turns_of(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    want = {}
    for r in docs.collect():
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == sorted(turns) and got[c].learned == "".join(t for r, t in sorted(turns) if r == "assistant")
    assert chat.render(chat.fold_events(chat.as_events(docs.limit(0)))).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", "user", "lo"), (1, 3, 1, "delta", "assistant", "bad"),
        (1, 4, 1, "regenerate", "assistant", "go"), (1, 5, 1, "delta", "assistant", "od"), (1, 6, 0, "edit", "user", "Hi"),
        (2, 1, 0, None, None, None), (None, 1, 0, "delta", "user", "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    got = rows(chat.fold_events(df), "conv_id", "turn", "role", "text")
    assert got == sorted([(1, 0, "user", "Hi"), (1, 1, "assistant", "good"), (2, 0, "", ""), (None, 0, "user", "x")], key=repr)
    assert chat.render(chat.fold_events(df.limit(0))).count() == 0


def test_rows_of_a_large_group_are_made_in_pieces(spark, monkeypatch):
    """10,000 rows without an id, of one size, are one group; each gets a place of its own."""
    monkeypatch.setattr(mixing, "ROWS", 64)
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("three words here").alias("text"))
    docs = docs.union(spark.createDataFrame([(7, "a", "one"), (8, "b", None)], "doc_id long, source string, text string"))
    found = mixing.each_row(mixing.placed(mixing.plan(docs))).collect()
    assert len(found) == 10_002
    places = sorted(r.place for r in found if r.place is not None)
    assert len(places) == len(set(places))
