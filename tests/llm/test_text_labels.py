import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from aeolis.llm import licenses, registry, toxicity

from .frames import awkward, empty


def matched(template, text):
    return list(licenses.Automaton(template).matches(text.split() if isinstance(text, bytes) else text.encode().split()))


def test_template_markup():
    t = "under the [terms of the] {mit|apache <1>} license"
    assert matched(t, "x under the mit license") == [(1, 5)]
    assert matched(t, "under the terms of the apache public license") == [(0, 8)]
    assert matched(t, "under the terms of mit license") == []
    assert matched(t, "under the apache one two license") == []
    assert matched("a <2> b", "a x b a b a x y b a x y z b") == [(0, 3), (3, 5), (5, 9)]
    assert matched("a [a] b", "a a b") == [(0, 3), (1, 3)]


def test_scan_counts_every_place(spark):
    text = "Released under the MIT License. UNDER THE MIT-LICENSE, apache license version 2; cc by nc cc by nc"
    df = spark.createDataFrame([(1, text), (2, "under the mitt license"), (3, "é under the mit license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(df)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (5, 1, 16, "apache-2,cc-by-nc,mit")
    assert "mit-notice" in got[1].labels and got[1].score == 1.0
    assert (got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].score, got[3].n_words) == (1, 1, 0.5, 5)


NAMES = {"bsd-2-clause": "The Example Authors", "bsd-3-clause": "Jane Q. Public and Contributors", "isc-license": "the author", "mit-license": "Example Corp. or copyright holders"}


def wording(template, label):
    """A text of the template: no optional part, the first alternative, a name for each replaceable part."""
    template = re.sub(r"\{([^|{}]*)\|[^{}]*\}", r"\1", template)
    while "[" in template:
        template = re.sub(r"\[[^\[\]]*\]", "", template)
    return re.sub(r"<\d+>", NAMES.get(label, "it"), template)


def test_whole_licenses(spark):
    """A license with its parts filled in is known by its label; one mandatory word less or another, and it isn't."""
    rows, want, spoilt = [], {}, random.Random(3)
    for template, label in licenses.LICENSES:
        text = wording(template, label)
        words = text.split()
        at = spoilt.randrange(len(words) // 4, len(words) // 2)
        texts = [f"Copyright 2020 x. {text.upper()}.", ", ".join(words), " ".join([*words[:at], "altered", *words[at + 1 :]]), " ".join(words[: at + 1])]
        for k, t in enumerate(texts):
            want[len(rows)] = (label, k < 2)
            rows.append((len(rows), t))
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (label, known) in want.items():
        assert (label in got[i].labels.split(",")) == known, (label, rows[i])
    assert not any({"bsd-2-clause", "bsd-3-clause"} <= set(r.labels.split(",")) for r in got.values())


def test_license_sql_on_whole_licenses(spark, tmp_path):
    """The query's SQL, made from the templates as regular expressions, agrees on filled-in licenses too."""
    texts = [wording(t, label) for t, label in licenses.LICENSES + licenses.NOTICES]
    texts += [f"{t} {u}" for t, u in zip(texts, texts[1:], strict=False)] + [t.replace("the ", "", 1) for t in texts] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.OP4_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in registry.op4_license_scan(spark, str(tmp_path)).select(*names).collect())


def test_scan_awkward_rows(spark):
    got = licenses.summary(licenses.scan(awkward(spark))).collect()
    assert len(got) == 12 and all(r.n_base == 0 for r in got)
    assert licenses.scan(empty(spark)).count() == 0


def test_grammar():
    clause = toxicity.GRAMMAR.clause
    assert clause("OIO") == "I" and clause("TOI") == "D" and clause("TH") == "A" and clause("NOI") == "W"
    assert clause("NOOOI") == "I" and clause("RI") == "Q" and clause("RNI") == "Q" and clause("MOM") == "I" and clause("OO") == ""
    model = toxicity.Model()
    assert model.score("You are an idiot.") > 0.5 > model.score("They said you are an idiot.")
    assert model.score("You are not an idiot.") < 0.5 and model.score("") < 0.5 and model.score("A fine day.") < 0.5


def corpus(n, seed=4):
    r = random.Random(seed)
    stems, syllables = ("zork", "blaff"), ["an", "der", "ti", "on", "re", "sch", "ea"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(5, 80))], int(r.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(stems) + word())
        docs.append((i, " ".join(words)))
        labels.append((i, toxic if r.random() < 0.99 else 1 - toxic))
    return docs, labels


def test_learns_stems_and_scores_held_out_rows(spark):
    docs, labels = corpus(1500)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert any(s.startswith("zork") for s in model.learned) and any(s.startswith("blaf") for s in model.learned)
    got = toxicity.score(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).join(lab, "doc_id").where("held").collect()
    assert {r.doc_id for r in got} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(300)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int")) == toxicity.fit(d, spark.createDataFrame(flipped, "doc_id long, toxic int"))


def test_copies_of_one_text_make_no_insults(spark):
    docs, labels = corpus(400)
    copy = "some quiet words that only ever stand here together"
    docs += [(10_000 + i, f"{copy} {'x' * (i % 3)}") for i in range(60)]
    labels += [(10_000 + i, 1) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not {"quiet", "together", "ever"} & set(model.learned)


def test_toxicity_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.fit(awkward(spark), labels)
        got = toxicity.score(awkward(spark), model).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
