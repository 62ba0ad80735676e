import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aeolis.llm import registry, simhash, substring_dedup
from aeolis.llm.common import table

from .frames import awkward, empty

DATA = "/root/testdata/sf0.001"


def brute_windows(docs, n=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("chunk", [1 << 21, 50])
def test_substring_dedup_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    random.seed(chunk)
    passages = [[f"p{k}w{i}" for i in range(random.randint(10, 40))] for k in range(6)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(random.randint(0, 4)):
            words += random.choice(passages) if random.random() < 0.5 else [random.choice("abc") for _ in range(random.randint(0, 20))]
        docs.append((random.randint(-5, 10**12) if i % 3 else i, random.choice([" ", "\n", " \t "]).join(words)))
    docs = list(dict(docs).items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_windows(docs)


def repeats(seed, n=120):
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(13, 40))] for k in range(6)]
    docs = {}
    for i in range(n):
        words = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(0, 20))])]
        docs[rng.randint(-(10**12), 10**12) if i % 3 else i] = " ".join(words)
    return list(docs.items())


@pytest.mark.parametrize("chunk", [1 << 21, 50])
def test_several_ranges_a_partition(spark, monkeypatch, chunk):
    """With few partitions ranges and groups are sorted apart inside them, and nothing changes."""
    monkeypatch.setattr(substring_dedup, "PARTITIONS", 3)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 1_000)
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    docs = repeats(chunk)
    df = spark.createDataFrame([(*d, {"a": i}) for i, d in enumerate(docs)], "doc_id long, text string, other map<string,int>").repartition(5)
    assert substring_dedup.ranges_for(df) > 9
    out = substring_dedup.remove_repeats(df, carry=("other",))
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out.collect()}
    assert got == brute_windows(docs) and out.where("carried.other is not null").count() == len(docs)


@pytest.mark.parametrize("partitions", [8192, 2])
def test_no_false_repeat_with_a_short_hash(spark, monkeypatch, partitions):
    """With 8 bits of hash many windows share each value; the check tells them apart."""
    full = substring_dedup.window_hashes

    def short(words, window=13):
        h, c = full(words, window)
        return h & np.uint64(0xFF), c

    monkeypatch.setattr(substring_dedup, "window_hashes", short)
    monkeypatch.setattr(substring_dedup, "PARTITIONS", partitions)
    docs = repeats(5)
    seen = np.concatenate([short(t.encode().split())[0] for _, t in docs])
    assert len(seen) > 1_000 and len(np.unique(seen)) <= 256
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_windows(docs)


def test_windows_packed_and_read_back():
    rng = np.random.default_rng(3)
    for salts in (np.zeros(500, np.int16), rng.integers(0, 1024, 500).astype(np.int16)):
        made = substring_dedup.Windows(rng.integers(-(2**62), 2**62, 500), salts, rng.integers(0, 2**64, 500, np.uint64), rng.integers(0, 2**16, 500).astype(np.uint16))
        assert all((x == y).all() for x, y in zip(made, substring_dedup.Windows.unpack(*made.pack()), strict=True))


def test_hot_doc_id(spark):
    """A third of all rows has one id: it is dealt out by its texts, and judged as one document still."""
    docs = repeats(9, 300)
    rows = [(50 if k % 3 == 0 else i, t) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert 50 in substring_dedup.hot_ids(df)
    first, words = {}, [(i, t.split()) for i, t in rows]
    for i, w in sorted(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = [(r.doc_id, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)
    groups = substring_dedup._group(np.full(300, 50), np.arange(300) % 1024, 64)
    assert len(np.unique(groups)) > 32
    ids = [-(2**63), -7, 0, 2**62, 2**63 - 1]
    frame = spark.createDataFrame([(i, s) for i in ids for s in (0, 5, 1023)], "i long, s int")
    for r in frame.select("i", "s", substring_dedup._group_of(F.col("i"), F.col("s"), 77).alias("g")).collect():
        assert r.g == substring_dedup._group(np.array([r.i]), np.array([r.s]), 77)[0]


def test_substring_dedup_awkward_rows(spark):
    out = substring_dedup.remove_repeats(awkward(spark), carry=("size", "kept"))
    found = out.collect()
    assert len(found) == 12
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[8].n_removed == 60 and by_id[8].removed == [0, 60] and bytes(by_id[8].kept) == b"tail"
    assert by_id[7].n_removed == by_id[1].n_removed == by_id[2].n_removed == 0
    assert by_id[3].n_words == by_id[4].n_words == by_id[5].n_words == 0
    assert by_id[6].n_removed == 0 and by_id[6].n_words == 60_000
    assert all(r.carried["size"] == "x" for r in found)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", "One", "one TWO", "a b c", "a b a b a b a b", "É É é Z z z", "w " * 40_000):
        assert simhash.fingerprint(None if text is None else text.encode()) % (1 << 64) == brute_fingerprint(text)


def brute_components(fps, radius=3):
    fps, label = sorted(set(fps)), {}
    for f in fps:
        label[f] = f
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_and_components(spark, monkeypatch, hot):
    """Chains of near fingerprints; with a small HOT keys are divided and tiled."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    want = brute_components(signed)
    assert {r.node: r.root for r in got} == {f: r for f, r in want.items() if f != r}


def test_forest_links_only_within_a_key():
    fps = np.array([0, 7, 15, 0b1111 << 40, 0], dtype=np.int64)
    label = simhash.forest(np.array([4, 4, 4, 4, 5]), fps)
    assert label.tolist() == [0, 0, 0, 3, 4]


def test_simhash_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == 12
    groups = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert groups[1] == groups[2] == 1 and groups[3] == groups[4] == groups[5] == 3 and groups[6] == 6
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").collect())
    assert ids == sorted(set(groups.values())) and kept.where(F.col("doc_id").isNull()).count() == 2
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_ranges_follow_the_input(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 400) for i in range(100)], "doc_id long, text string")
    assert substring_dedup.ranges_for(docs) == 8 and substring_dedup.ranges_for(docs.limit(0)) == 8
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 5_000)
    assert substring_dedup.ranges_for(docs) == 40
    assert substring_dedup.remove_repeats(docs).where("n_removed = 400").count() == 99


def test_registered_substring_dedup(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    got = registry.op3_substring_dedup(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = {(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute_windows(docs).items()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == len(docs)


def test_registered_simhash(spark):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in table(spark, DATA, "documents").collect()}
    label, least = brute_components(fps.values()), {}
    for i in sorted(fps):
        least.setdefault(label[fps[i]], i)
    got = registry.op7_simhash(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert {tuple(r) for r in got.collect()} == {(i, f"{fp & (1 << 64) - 1:016x}", least[label[fp]]) for i, fp in fps.items()}
