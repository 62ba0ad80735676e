import random

from aeolis.llm import simhash


def test_repeated_ids_of_different_texts_lose_no_component(spark):
    """Components 5 and 5, and a row of id 5 in the component of 3: each component leaves its own row."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(5, a), (9, a), (5, b), (8, b), (3, c), (5, c), (3, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(5, a), (5, b), (3, c)])


def test_rows_differing_by_nulls_are_told_apart(spark):
    rows = [(1, "x", None, "one text of its own here"), (1, None, "x", "another that is not like it")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    assert simhash.keep_one(docs).count() == 2
