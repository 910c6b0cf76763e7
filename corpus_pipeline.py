"""From raw documents to token sequences: five stages, each written as a table and read again by the next.

1. quality rules: documents that weak supervision rejects go;
2. n-gram Jaccard join (5 words, similarity 0.8): of each group of near copies the document with the smallest id stays;
3. substring dedup: words in passages of 50 words or more that start elsewhere too go, and documents that lose all their words;
   a document that loses nothing keeps its text as it is;
4. mixing: nearly all tokens, with sources, languages and domains brought a little nearer to each other; a document that the mix takes
   twice is there twice;
5. sentence pieces: the ids of the best segmentation and how the next two differ from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import fm_dedup, jaccard_join, mixing, quality_rules, sentence_pieces
from lodestrata.llm.common import materialize, packed, ready, table, unpacked

#: Words of a passage that must not repeat; share of all tokens in the mix, passes at most, and the power that evens out the weights.
PASSAGE, SHARE, PASSES, POWER = 50, 0.95, 2, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, as they are.

    A null or empty text has no words and goes; equal rows stay or go together; an empty table stays empty; columns of any name pass."""
    ready(spark)
    return quality_rules.keep(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, as it is.

    Null and empty texts are in no group and stay, however many; of equal rows one stays; a null doc_id comes after any other; an empty
    table stays empty; columns of any name pass."""
    ready(spark)
    return jaccard_join.keep_one(docs, k=5, percent=80)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with what is left of their texts, and n_chars, if there, of that.

    A text that loses nothing, among them null, empty and short ones, stays as it is; one that loses all its words goes; of equal rows of a
    window's length or more each loses all; an empty table stays empty; columns of any other name pass as they are."""
    ready(spark)
    found = fm_dedup.stripped_rows(docs, PASSAGE).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them.

    A null language or source is a leaf `none`; texts without tokens cost nothing and come with their leaf's passes; equal rows have one
    place in the order and are taken together; an empty table stays empty; columns of any name pass as they are."""
    ready(spark)
    taken = mixing.select(packed(docs), [mixing.domain_of(), F.col("lang"), F.col("source")], mixing.smoothed(POWER), SHARE, PASSES)
    return unpacked(taken.withColumn("mix_turn", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their token ids and scores, which take the place of columns of the same names.

    A null text has null ids; an empty one is one space's; equal texts have equal ids; an empty table stays empty; other columns pass."""
    ready(spark)
    return sentence_pieces.encode(docs, keep=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("substring dedup", passages_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: No SQL: expectation-maximisation and the lattice search are beyond it.  tests/llm holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all rows of documents; what each stage says of odd rows holds."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}-{name.replace(' ', '-')}")
    return docs
