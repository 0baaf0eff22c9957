"""From raw documents to training ids, in five stages.

Each stage reads all that the one before it kept, and its decisions take effect:
toxic documents go, one document of each group of near copies stays, documents with
benchmark passages go, secrets that look live are masked, and what is left is
encoded.  Every stage's result is written as Parquet before the next one reads it, so
a lost executor never sends the work back further than one stage.

Null and empty texts pass every filter and are encoded as no pieces.  Very long texts
pass through whole; repeated rows count as copies, of which one stays; of near copies the
smallest id does; an empty table gives an empty result.  Other columns
are carried along under whatever names they have.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontamination, pieces, secrets, similarity, toxicity
from lacuna.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.harmless(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similarity.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs, *secrets.source_owner())
    if "n_chars" not in docs.columns:
        return masked
    # A null text keeps the number it came with.
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: A classifier and an iterated join are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
