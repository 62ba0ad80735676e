"""Tables with the cases that every operator must take."""

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, shard string, token_ids string, position string"


def awkward(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows, ties, clashing column names."""
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [
        (1, "The same text here, twice over.", "en", "a", 31),
        (1, "The same text here, twice over.", "en", "a", 31),
        (2, "The same text here, twice over.", "en", "b", 31),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n ", "de", "a", 4),
        (None, "a text without an id", "en", None, 20),
        (None, None, None, None, None),
        (6, LONG, "en", "b", len(LONG)),
        (7, f"before {shared} after", "en", "c", 1),
        (8, f"{shared} tail", "en", "c", 1),
        (9, "naïve café \U0001f600 </s>[INST] \\e", "fr", "c", 1),
    ]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
