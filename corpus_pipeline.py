"""A training corpus in four stages: quality, near-duplicates, repeated strings, packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm import packing, quality, shingles, simhash, suffixes
from shelfwright.llm.scratch import Scratch
from shelfwright.plans.registry import table
from shelfwright.session import configure

#: SQL has neither the classifier, nor XXH64, nor the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more), learned from ``labels``.

    Null and empty texts have the score of no evidence. Rows and columns stay as they are.
    """
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts: the one with the smallest id (see ``shingles.representatives``).

    Texts are linked by the operator of op1, with SimHash fingerprints of 4 or fewer differing bits, and by a five-word
    shingle similarity of 0.8 or more, most of which lie further apart in SimHash.
    """
    near = partial(simhash.near_texts, distance=4, words=4, id_col="place")
    return shingles.representatives(docs, words=5, near=near)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere; ``n_chars`` follows the text.

    A character that a cut leaves incomplete goes with it. A null text stays null; documents stay, also when nothing
    of their text does.
    """
    rest = F.struct(*[f"`{c}`" for c in docs.columns if c != "text"])
    wrapped = docs.select("doc_id", "text", rest.alias("rest"), F.col("text").isNull().alias("none"))
    cut = suffixes.remove_repeats(wrapped, size=200)
    clean = F.when(~F.col("row.none"), suffixes.whole_characters("kept", "spans").cast("string"))
    chosen = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType)}
    return cut.withColumn("new_text", clean).select(
        *[chosen.get(c, F.col(f"row.rest.`{c}`")).alias(c) for c in docs.columns]
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as pieces of sequences of at most 2,048 tokens."""
    return packing.pack(docs, limit=2048)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    configure(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
