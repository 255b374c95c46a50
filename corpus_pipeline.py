"""The corpus pipeline: quality, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it left; all but the last return
the columns of docs, whatever others there are beside doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm import jaccard, mixing, pii, quality, tokens
from countloom.llm.common import discard, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps, with all their columns.

    Null, empty and blank texts go; repeated rows share their fate; nulls in other columns do not matter; an empty table stays empty.
    """
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more: that of the smallest id.

    Of rows that repeat an id one stays; rows without an id and texts without words stay, as they link with nothing.
    """
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text replaced by its kind; n_chars follows.  Null texts stay null, all rows and columns stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    Null texts have size 0; a null source is one of its own; reruns agree.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers, with digests of them and of the decoded bytes.

    A row for every row; null and empty texts have no ids.
    """
    encoded = tokens.encode_documents(docs, *tokens.multi_ranks())
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Models, similarity joins and byte-pair merges are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
