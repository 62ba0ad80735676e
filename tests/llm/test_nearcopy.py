import random
import re

import numpy as np
import pytest

from aeolis.llm import nearcopy

from .frames import awkward, empty


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """Least ids of the components of all pairs with a similarity of 0.8 or more."""
    docs = sorted((i, brute_shingles(t)) for i, t in docs)
    label = {i: i for i, _ in docs}
    for k, (i, a) in enumerate(docs):
        for j, b in docs[k + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {x: new if r == old else r for x, r in label.items()}
    return sorted(set(label.values()))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("tile", [512, 4])
def test_near_copies_against_brute_force(spark, monkeypatch, tile):
    """Copies with several edits, which are more than three bits apart; with a small TILE keys are tiled."""
    monkeypatch.setattr(nearcopy, "TILE", tile)
    rng, docs = random.Random(tile), []
    passage = [f"p{i}" for i in range(60)]
    for k in range(15):
        base = [f"k{k}w{rng.randrange(900)}" for _ in range(rng.randint(20, 300))] + passage * (k % 2)
        docs += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25)))) for _ in range(rng.randint(1, 14))]
    docs += ["one two", "One  two", "three", "", " ", None]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = nearcopy.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(docs)


def test_linked_and_shingles():
    sets = [nearcopy.shingles(" ".join(map(str, w)).encode()) for w in (range(100), range(10, 100), range(20, 100), [*range(50), *range(500, 550)])]
    fps = np.array([nearcopy.majority(s) for s in sets])
    assert nearcopy.linked(np.full(4, 4), fps, sets)[1].tolist() == [0, 0, 0, 3]
    assert nearcopy.linked(np.array([1, 3, 3, 4]), fps, sets)[1].tolist() == [0, 1, 1, 3]
    before, after = nearcopy.linked(np.full(4, 4), fps, sets, np.array([7, 8, 9, 7]))
    assert before.tolist() == [0, 1, 2, 0] and after.tolist() == [0, 0, 0, 0]
    text = "a B c d e f a b c d e"
    assert len(nearcopy.shingles(text.encode())) == len(brute_shingles(text)) == 6
    assert len(nearcopy.band_keys(np.empty(0, np.uint64))) == 0 and len(set(nearcopy.band_keys(sets[0]).tolist())) == nearcopy.BANDS


def test_near_copies_awkward_rows(spark):
    docs = awkward(spark)
    kept = nearcopy.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "9", "None", "None"]  # 8 shares 56 of 59 shingles with 7
    assert nearcopy.keep_one(empty(spark)).count() == 0


def test_radius_holds_every_near_copy():
    """Fingerprints of pairs at a similarity of 0.8, from the shortest texts on, stay within RADIUS."""
    rng = np.random.default_rng(6)
    for shared, left, right in ((4, 1, 0), (5, 1, 0), (8, 1, 1), (8, 2, 0), (40, 5, 5), (400, 100, 0)):
        for _ in range(500):
            own = rng.integers(0, 1 << 64, shared + left + right, dtype=np.uint64)
            a, b = np.sort(own[: shared + left]), np.sort(np.r_[own[:shared], own[shared + left :]])
            differing = nearcopy.majority(a) ^ nearcopy.majority(b)
            assert nearcopy.similar(a, b) and (differing & (1 << 64) - 1).bit_count() <= nearcopy.RADIUS


def test_work_grows_with_a_group_of_copies(spark, monkeypatch):
    """One-word edits of one text: what is dealt out grows with the copies, and stays below ten times the text."""
    dealt = []
    compared, checked = nearcopy._compared, nearcopy._checked

    def counted(rows, *more):
        dealt.append(rows.count())
        return (checked if more else compared)(rows, *more)

    monkeypatch.setattr(nearcopy, "_compared", counted)
    monkeypatch.setattr(nearcopy, "_checked", counted)
    base = [f"b{i}" for i in range(200)]
    for n in (300, 1200):
        docs = [(i, " ".join(edited(random.Random(i), base, 1))) for i in range(n)]
        kept = nearcopy.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
        assert [r.doc_id for r in kept.collect()] == [0]
    pairs, rest = dealt[::2], dealt[1::2]
    assert pairs[0] <= 10 * 300 and pairs[1] <= 5 * pairs[0] and rest[1] <= 5 * max(rest[0], 300)


def test_sets_that_share_a_number_stay_apart(spark):
    sets = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "set long, alt long")
    got = [r.node for r in nearcopy.named(sets).orderBy("set", "alt").collect()]
    assert len(set(got)) == 3 and got[2] == 2


def test_links_come_from_the_blocks_of_bits(spark, monkeypatch):
    """Without any key of min-hashes fingerprints within three bits are still linked, by op7's keys, and checked."""
    monkeypatch.setattr(nearcopy, "band_keys", lambda own: np.empty(0, np.int64))
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(w) for w in (base, [*base[:-1], "end"], ["start", *base[1:]], [f"c{i}" for i in range(150)])]
    fps = [nearcopy.majority(nearcopy.shingles(t.encode())) for t in texts]
    assert all(0 < ((f ^ fps[0]) & (1 << 64) - 1).bit_count() <= 3 for f in fps[1:3])
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0].upper()])), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopy.keep_one(docs).collect()) == [0, 3]


def test_pivots_are_compared_by_fingerprint(spark, monkeypatch):
    """A near copy more than three bits away is a link within RADIUS only."""
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(w) for w in (base, [*base[:-5], *(f"n{i}" for i in range(5))])]
    a, b = (nearcopy.majority(nearcopy.shingles(t.encode())) for t in texts)
    assert 3 < ((a ^ b) & (1 << 64) - 1).bit_count() <= nearcopy.RADIUS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert nearcopy.keep_one(docs).count() == 1
    monkeypatch.setattr(nearcopy, "RADIUS", 3)
    assert nearcopy.keep_one(docs).count() == 2
