"""A training corpus from `documents`, in five stages.

toxicity        documents that the clause grammar scores as toxic go
simhash         of near copies (SimHash of five-word shingles, checked for a similarity of 0.8 or more) the one with the smallest id stays
substring_dedup passages of 13 words and more that an earlier document has are cut out
mixing          documents are repeated or left out so that sources meet their target weights
byte_bpe        texts become token ids
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolis.llm import bpe, mixing, nearcopy, substring_dedup, toxicity
from aeolis.llm.common import cut, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what op5's model, learned from these documents and `labels`, scores below 0.5.

    Null and empty texts score as clean; repeated rows share a fate; all columns stay, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return scored.where("predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, a similarity of 0.8 or more) the row with the smallest doc_id stays.

    op7's method finds fingerprints within three bits, further keys those within a wider radius; an exact check confirms both.
    Null, empty and blank texts are copies of each other; rows without doc_id stay; of repeated rows one stays.
    """
    return nearcopy.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; one that loses words gets its new text and length.

    Null and empty texts stay as they are; rows of one doc_id take nothing from each other; rows without one neither take nor lose.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = substring_dedup.remove_repeats(docs.withColumn("_null", F.col("text").isNull()), carry=(*others, "_null"), respace=False)
    text = F.when(~F.col("carried._null"), F.col("kept").cast("string"))
    made = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col("carried")[c] for c in others}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(made["n_chars"])
    return kept.select(*(made[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream in order of position; a document comes as often as it is taken.

    Documents without words (null, empty) aren't in it; repeated rows are rows each; null sources are one source.
    """
    return mixing.materialize(docs).select("doc.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream's documents as token ids, in order of stream_part and stream_row.

    Null and empty texts have no ids; every row stays, and columns but doc_id and source go.
    """
    ordered = mixing.stream_order(docs).select("doc_id", "source", "text", "stream_part", "stream_row")
    coded = bpe.encode(ordered, RANKS, PATTERN, keep=False)
    return coded.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]
#: Fingerprints, a learned model and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of `documents` after all stages: doc_id, source, stream_part, stream_row, token_ids, n_tokens; ordered by stream_part and stream_row it is the training stream."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
