"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Null text: kept, encoded as empty. Null doc_id: a document like others, told from them by its text. Documents whose lines
all occur before keep an empty text; of those without words, as of repeated rows and near copies, one stays. Empty tables:
an empty result. Extra columns are kept; those named n_tokens, ids, decoded, ids_sha256 or decoded_sha256 give way in the end. Labels and
benchmark may be empty: then nothing is rejected for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, common, cpjoin, decontam, linedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.clean(docs, common.read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that occur earlier."""
    return linedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return cpjoin.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without overlaps with the benchmark."""
    return decontam.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and digests of them and of the decoded text."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")]
    return out.select(*kept, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Models and iterations aren't expressible in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
