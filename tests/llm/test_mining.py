import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from aeolis.llm import collocations, periodic, positional
from aeolis.llm import registry_mining as queries

from .frames import awkward, empty


# -- periodic runs ----------------------------------------------------------------------------
def brute_runs(words):
    """By definition: every stretch at every lag, smallest period by trying all."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    """Few different words, nested and touching periods, blocks that return, all sizes."""
    rng, counted = random.Random(seed), 0
    for _ in range(400):
        words = []
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 13))]
            if rng.random() < 0.3:
                unit = unit * 4 + [rng.choice("abc")]
            words += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            words += [rng.choice("abcxyz") for _ in range(rng.randint(0, 5))]
        want = brute_runs(words)
        counted += len(want)
        assert periodic.runs_of(words) == want
        assert periodic.kept_words(words, want) == brute_kept(words, want)
    assert counted > 200


def test_long_runs_are_extended_once(monkeypatch):
    """A run of 200,000 words is extended a few times, not once a seed."""
    calls = []
    extend = periodic._ahead
    monkeypatch.setattr(periodic, "_ahead", lambda *a: calls.append(a) or extend(*a))
    assert periodic.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]
    unit = [str(i) for i in range(1000)]
    assert periodic.runs_of(unit * 50 + ["end"] + unit * 4) == [(0, 50_000, 1000), (50_001, 4000, 1000)]
    assert len(calls) < 10


def test_find_runs_awkward_rows(spark):
    docs = awkward(spark)
    found = periodic.find_runs(docs).collect()
    assert len(found) == 12 and {r.doc["size"] for r in found} == {"x"}
    assert [(r.n_words, len(r.runs)) for r in found if r.doc.doc_id == 6] == [(60_000, 1)]
    assert [tuple(r.runs[0]) for r in found if r.doc.doc_id == 6] == [(0, 60_000, 977)]
    assert all(r.n_words == 0 and not r.runs and bytes(r.collapsed) == b"" for r in found if r.doc.doc_id in (3, 4, 5))
    assert periodic.find_runs(empty(spark)).count() == 0


def test_strongest_compares_exactly_and_takes_the_first(spark):
    df = spark.sql("select array(named_struct('start', 1L, 'length', 9L, 'period', 2L), named_struct('start', 4L, 'length', 18L, 'period', 4L)) as runs, 1 as k")
    assert tuple(df.select(periodic.strongest(df.runs).alias("r")).first().r) == (1, 9, 2)
    big = 500_000_000
    df = spark.sql(f"select array(named_struct('start', 0L, 'length', {4 * big - 1}L, 'period', {big}L), named_struct('start', 5L, 'length', {4 * big + 3}L, 'period', {big + 1}L)) as runs")
    want = max([(Fraction(4 * big - 1, big), 0), (Fraction(4 * big + 3, big + 1), 5)])[1]
    assert df.select(periodic.strongest(df.runs).alias("r")).first().r.start == want


# -- benchmark passages -----------------------------------------------------------------------
def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, width, slack):
    """(n_words, n_hit, items, near items) a document, by trying every window at every place."""
    out = []
    for text in docs:
        words, hit, exact, near = words_of(text), set(), set(), set()
        for name, item in items:
            own = words_of(item)
            k = min(width, len(own))
            for s in range(len(own) - k + 1 if own else 0):
                x = own[s : s + k]
                for at in range(-slack, len(words) + slack):
                    if at >= 0 and words[at : at + k] == x:
                        hit |= set(range(at, at + k))
                        exact.add(name)
                    elif all(w in words[max(0, at + j - slack) : max(0, at + j + slack + 1)] for j, w in enumerate(x)):
                        near.add(name)
        out.append((len(words), len(hit), sorted(x for x in exact if x is not None), sorted(x for x in near - exact if x is not None)))
    return out


@pytest.mark.parametrize(("block", "item_bytes", "at_once"), [(1 << 20, 1 << 24, 1 << 20), (40, 200, 16)])
def test_contamination_against_brute_force(spark, monkeypatch, block, item_bytes, at_once):
    """Also with many blocks, several passes over the index and candidates in small parts."""
    for name, value in (("BLOCK_WORDS", block), ("ITEM_BYTES", item_bytes), ("AT_ONCE", at_once)):
        monkeypatch.setattr(positional, name, value)
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for k in range(12)]
    items += [("i1", "W3 w4, w5"), (None, "w7-w8"), ("blank", " .. "), ("null", None), ("same", items[0][1])]
    docs = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        own = words_of(rng.choice(items)[1])
        if rng.random() < 0.3:
            rng.shuffle(own)
        words[rng.randint(0, len(words)) :] += own if rng.random() < 0.6 else own[:3] + ["extra"] + own[3:]
        docs.append(rng.choice(["  ", ", ", "-"]).join(words).title())
    docs += [None, "", "..."]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in positional.contamination(df, bench, width=5, slack=2).collect()}
    want = brute_contamination(docs, items, 5, 2)
    assert [got[i] for i in range(len(docs))] == want
    assert any(w[3] for w in want) and any(w[2] for w in want)


def test_search_joins_windows_and_keeps_documents_apart(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f y a b c"), (2, "d e f")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(5, "a b c d e f")], "item_id long, text string")
    found = positional.search(positional.build_index(docs).persist(), bench, width=4, slack=0).collect()
    assert [(r.doc, r.item_id, r.kind, r.start, r.length, r.item_start) for r in found] == [(0, "5", "phrase", 1, 6, 0)]
    with pytest.raises(ValueError, match="narrower"):
        positional.search(positional.build_index(docs), bench, width=62)


def test_contamination_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "the same text here twice", "x"), (2, None, "x"), (3, "", "x"), (None, "text without an id", "x")], "item_id long, text string, doc_id string")
    found = positional.contamination(docs, bench).collect()
    assert len(found) == 12
    assert all((r.n_hit, r["items"]) == (5, ["1"]) for r in found if r.doc_id in (1, 2))
    assert sorted((r.n_words, r.n_hit, r["items"] == []) for r in found if r.doc_id is None) == [(0, 0, True), (5, 4, True)]
    assert all(r.n_words == 0 == r.n_hit for r in found if r.doc_id in (3, 4, 5))
    assert positional.contamination(empty(spark), bench).count() == 0
    assert {r.n_hit for r in positional.contamination(docs, bench.limit(0)).collect()} == {0}


# -- collocations -----------------------------------------------------------------------------
def brute_collocations(docs, least):
    counts, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = set()
    for lang, own in counts.items():
        frequent = {g: f for g, f in own.items() if f >= least and len(g) > 1}
        for g, a in frequent.items():
            inside = any(f >= a and len(o) > len(g) and any(o[i : i + len(g)] == g for i in range(len(o))) for o, f in frequent.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                out.add((lang, " ".join(g), len(g), a, own[g[:k]], own[g[k:]], n[lang], score))
    return out


@pytest.mark.parametrize(("chunk", "words", "broadcast"), [(1 << 21, 400_000, 1 << 20), (60, 5, 1 << 20), (1 << 21, 400_000, 0)])
@pytest.mark.parametrize("hot", [1 / 16, 100.0])
def test_collocations_against_brute_force(spark, monkeypatch, chunk, words, broadcast, hot):
    """Also in small chunks, without the broadcast of words, with and without hot words, with few counters of pairs."""
    for name, value in (("CHUNK", chunk), ("WORDS", words), ("BROADCAST_WORDS", broadcast), ("HOT", hot), ("COUNTERS", (9 if hot == 100.0 else 16, 28))):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(6)]
    passages = [[rng.choice(common) if rng.random() < 0.5 else f"p{k}{i}" for i in range(8)] for k in range(4)]
    docs = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages)[: rng.randint(1, 8)] if rng.random() < 0.6 else rng.choices(common, k=rng.randint(1, 4)) + [f"r{rng.random()}"]
            text.append(rng.choice(["", "", ". ", ",", "\n", "!"]))
        docs.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "\t", "  "]).join(text).title()))
    docs += [("en", None), ("xx", ""), ("en", " É \x1f")]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = {tuple(r) for r in collocations.collocations(df, least=12).collect()}
    want = brute_collocations(docs, 12)
    assert got == want and len(want) > 20


def test_scores_beyond_64_bits(spark):
    """1000 * a * n past a long: counts stand in for a very large text."""
    a, n = 4_000_000_000, 9_000_000_000_000
    row = spark.range(1).select(*(F.lit(v).cast("decimal(38,0)").alias(c) for c, v in (("a", a), ("n", n), ("l", 5_000_000_000), ("r", a))))
    assert row.selectExpr("(cast(1000 as decimal(38,0)) * a * n) div (l * r)").first()[0] == 1000 * a * n // (5_000_000_000 * a)


def test_top_orders_ties_by_phrase(spark):
    rows = [("en", p, 2, 100, 1, 1, 5, s) for p, s in (("b b", 7), ("a b", 7), ("é a", 7), ("z z", 9), ("Z", 7))]
    found = spark.createDataFrame(rows, "lang string, phrase string, words long, a long, l long, r long, n long, score long")
    assert [(r.rank, r.phrase) for r in collocations.top(found, 4).orderBy("rank").collect()] == [(1, "z z"), (2, "Z"), (3, "a b"), (4, "b b")]


def test_collocations_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r.lang, r.phrase): r for r in collocations.collocations(docs, least=2).collect()}
    assert got["en", "the same text here"].a == 3 and got["en", "twice over"].a == 3
    assert got["en", "s0 s1 s2 s3 s4"].a == 2 and ("en", "s0 s1") not in got
    assert collocations.collocations(empty(spark)).count() == 0


def test_registered_queries_take_null_ids(spark):
    found = queries.planted(spark.createDataFrame([(None, "a a a"), (4, None), (4, "")], "doc_id long, text string")).collect()
    assert [r.text for r in found] == ["a a a", None, ""]
