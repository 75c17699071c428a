"""From raw documents to token ids of a mixed corpus, in stages that each call one corpus operator.

``run(spark, sf_dir)`` applies the stages to the table ``documents``. Each stage's result is written as Parquet to the
shared folder and read again as the next one's input, so a lost executor costs the work of one stage at most. A stage
takes all that its predecessor kept; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantframe.llm import bpe, mixing, pii, quality, simhash
from plantframe.llm.queries import tokenizer_path
from plantframe.session import stage

#: Target weights of the sources; the large one is to make up a quarter of the mixed corpus.
WEIGHTS = {"src0": 6.0, **{f"src{i}": 1.0 for i in range(1, 20)}}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go; the rest is unchanged. Null and empty texts have no words and go;
    repeated rows fare alike."""
    return quality.apply_policy(quality.ledger(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    Groups are those of the SimHash operator: fingerprints of three-word shingles, linked at two or fewer differing bits.
    Null and empty texts are one group. Of rows that share the smallest id one stays, whichever order they come in.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` is that of the new text. No document goes; null and empty texts
    and texts without spans stay as they are, repeated rows repeat, texts of any length are read whole."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their sources' target weights and put into a random order.

    Rows of one id draw alike. A null source counts with those without a weight; a null text has no size.
    """
    return mixing.mix(docs, WEIGHTS).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again. Null counts as empty and has no ids; repeated rows
    repeat, texts of any length are encoded whole."""
    path = tokenizer_path()
    ids = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), bpe.encode(F.col("text"), path).alias("ids"))
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (bpe.decode(F.col("ids"), path) == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data),
    ("mixing", mix_sources), ("bpe", token_ids),
]

#: Fingerprints and token ids have no SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
