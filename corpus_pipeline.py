"""From raw documents to sampled pieces: toxicity filter, near-duplicate removal, redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes every stage as Parquet in the shared
folder and reads it again, so a lost executor costs at most the stage at work.

Defined cases: null or empty texts pass the filter, the removal of near duplicates and the redaction as they are; rows with a null or repeated id
are compared and redacted each by its own text; an empty table gives an empty result. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornloom.llm import minhash_dedup, pfair_mixing, pii_weak, piece_sampling, toxicity
from hornloom.llm._shared import light_batches, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    light_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a Jaccard share of 0.8 or more."""
    return minhash_dedup.keep_one(docs, width=5, num=80, den=100)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in angle brackets."""
    return pii_weak.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order: the files of the result, read in order, interleave the sources by their weights.

    Spark does not keep that order when it reads the files again; the last stage finds each document's position by its file and row.
    """
    return pfair_mixing.in_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless, and the document's place in the order of the mixing stage's files, which docs scans: position, in_mix."""
    light_batches(spark)
    placed = pfair_mixing.read_in_order(docs, columns=["doc_id", "text"])
    return piece_sampling.sample_pieces(placed, carry=("position", "in_mix"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the learned and sampled stages; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
