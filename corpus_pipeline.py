"""A corpus from raw documents to token ids, in five stages.

Each stage gets all that its predecessor kept, as a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import Staged, table
from paceline.llm.decontaminate import decontaminate
from paceline.llm.neardup import keep_one
from paceline.llm.pieces import MODEL_PATH, encode_pieces, load_model
from paceline.llm.quality import KEEP, fit_quality
from paceline.llm.secrets import redact_secrets


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject; without a label of any document it rejects none."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda i: F.lit(True))
    if not model.learned:
        return docs
    return model.score(docs, name="_score").filter(F.col("_score") >= KEEP).drop("_score")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out, whole items of any length too; documents that are mostly such passages go."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark"), max_words=1))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials masked."""
    return _counted(redact_secrets(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    out = encode_pieces(docs, load_model(MODEL_PATH))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip", "parity")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", no_near_duplicates),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_secrets),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and deleted once the next is there."""
    staged, docs, before = Staged(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = staged.put(str(n), stage(spark, docs, sf_dir))
        if before is not None:
            staged.drop(before)
        before = str(n)
    return docs
