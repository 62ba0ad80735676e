import math
import random
import re
import zlib

import numpy as np
import pytest

from aeolis.llm import registry, toxicity
from aeolis.llm.common import table

DATA = "/root/testdata/sf0.001"


def word(*parts):
    """A word of letters for these numbers."""
    return "x".join("".join(chr(97 + int(d)) for d in str(n)) for n in parts)


@pytest.mark.parametrize(("k", "n", "p"), [(7_200, 20_000, 0.4), (8_100, 20_000, 0.4), (3, 5, 0.1), (5, 5, 0.5), (400, 1_000, 0.1)])
def test_whole_tail(k, n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    want = min(0.0, max(logs) + math.log(math.fsum(math.exp(x - max(logs)) for x in logs)))
    assert toxicity._tail(k, n, p) == pytest.approx(want, abs=1e-6)


def test_family_needs_more_than_a_shared_passage():
    """A passage that has the least triple of both texts doesn't make them near copies."""
    passage = " ".join(f"p{word(i)}" for i in range(30))
    texts = [f"{passage} {' '.join(word(k, i) for i in range(100))}" for k in range(40)]
    assert len({toxicity.features(t)[0] for t in texts}) >= 35
    assert toxicity.features(texts[0])[0] == toxicity.features(texts[0].upper())[0]


def test_near_copies_learn_alike_in_any_order(spark):
    """Of near copies with both labels the toxic one counts, however the rows are dealt."""
    rows, labels = [], []
    for i in range(600):
        words = [word(i // 2, j) for j in range(30)]
        rows.append((i, " ".join([*words, "zorgle" if i < 120 else "calm"]) + "." * (i % 2)))
        labels.append((i, i % 2 if i < 120 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    fits = [toxicity.fit(x, known) for x in (docs.coalesce(1), docs.orderBy(-docs.doc_id).coalesce(1))]
    held = {r.doc_id for r in docs.where(toxicity.held_out(docs.doc_id)).select("doc_id").collect()}
    # each pair is one family, toxic if its odd id is and isn't held out; "zorgle" stands in these and in pairs of which only the even id is learned from
    pairs = {i // 2: 0 for i in range(600) if i not in held} | {i // 2: 1 for i, t in labels if t and i not in held}
    assert sum(pairs.values()) > 30
    assert fits[0].learned == fits[1].learned and fits[0].learned.get("zorgle") == "M"


def test_same_model_however_rows_are_dealt(spark):
    docs, labels = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "labels")
    models = [toxicity.fit(docs.repartition(n), labels) for n in (1, 3, 7)]
    assert models[0].learned == models[1].learned == models[2].learned
    assert models[0].weights == models[1].weights == models[2].weights


def plain_score(model, text):
    """The same score without transducers: each clause read word by word."""
    strength, counts, n = "DAIHMWQ", dict.fromkeys("DAIHMWQ", 0), 0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        n += bool(words)
        negated, reported, mild, target, found = 0, False, 0, False, ""
        for word in words:
            kind = model.symbol(word)
            if kind == "N":
                negated = 3
                continue
            out = "W" if negated and kind in "IMH" else kind
            negated = max(0, negated - 1)
            if out in "IMHW" and reported:
                out = "Q"
            if out == "M":
                mild += 1
                out = "I" if mild == 2 else "M"
                mild %= 2
            if out in "IH" and target:
                out = {"I": "D", "H": "A"}[out]
            reported |= kind == "R"
            target |= kind == "T"
            found += out
        best = next((m for m in strength if m in found), None)
        if best:
            counts[best] += 1
    z = sum(w * math.log1p(c) for w, c in zip(model.weights, [*counts.values(), n], strict=False)) + model.weights[-1]
    return 1 / (1 + math.exp(-max(-500, min(500, z))))


def test_registered_toxicity(spark):
    """op5_toxicity on a whole table, against a scorer of its own and the law of held-out rows."""
    got = registry.op5_toxicity(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    model = toxicity.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    found = {r.doc_id: r for r in got.collect()}
    assert found.keys() == docs.keys()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.score == pytest.approx(plain_score(model, docs[i] or ""), abs=1e-9) and r.predicted == (r.score >= 0.5)


def phrases(rng, n):
    """Texts in which only the grammar tells insults from what is negated or reported."""
    for _ in range(n):
        kind = rng.randrange(4)
        insult, verb = rng.choice(toxicity.INSULTS.split()), rng.choice(toxicity.THREATS.split())
        core = [f"you {insult}", f"I will {verb} you or your dog {verb}", f"this is not {insult}", f"they wrote it is {insult} and {verb}"][kind]
        around = [" ".join(word(rng.randrange(99)) for _ in range(6)) for _ in range(2)]
        yield f"{around[0]}. {core}. {around[1]}.", int(kind < 2)


def test_grammar_matters(monkeypatch):
    """Without its transducers the same learning does no better than chance on such texts."""
    rng, accuracy = random.Random(8), {}
    learn, held = list(phrases(rng, 600)), list(phrases(rng, 300))
    for name, grammar in (("whole", toxicity.GRAMMAR), ("words", toxicity.Composed(toxicity.Transducer([])))):
        monkeypatch.setattr(toxicity, "GRAMMAR", grammar)
        model = toxicity.Model()
        model = toxicity.Model(weights=toxicity.weigh([(model.clauses(t), y, 1) for t, y in learn]))
        accuracy[name] = np.mean([(model.score(t) >= 0.5) == y for t, y in held])
    assert accuracy["whole"] > 0.97 and accuracy["words"] < 0.8


def test_order_of_the_grammar_holds():
    """Labels that speak against it don't turn it round; kinds that no document shows keep their weights."""
    rows = [([0, 0, 0, 0, 0, 1, 0, 5], 1, 200), ([1, 0, 0, 0, 0, 0, 0, 5], 0, 100), ([0, 0, 1, 0, 0, 0, 0, 5], 1, 100), ([0] * 7 + [5], 0, 300)]
    weights = dict(zip(toxicity.MATCHES, toxicity.weigh(rows), strict=False))
    assert weights["W"] <= 0 and weights["Q"] == 0 and weights["D"] >= weights["I"] - 1e-6
    assert weights["A"] == pytest.approx(5) and weights["M"] == pytest.approx(2)
