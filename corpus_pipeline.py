"""The corpus pipeline: documents in, digests of training tokens out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet into the shared
checkpoint folder and reads it again as the next stage's documents, so a lost executor costs one stage at most.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardlens.llm import bpe, jaccard_join, mixing, suffix_dedup, toxicity
from shardlens.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.without_toxic),
    ("n-gram Jaccard join", jaccard_join.one_of_each),
    ("suffix-array dedup", suffix_dedup.without_repeats),
    ("mixing", mixing.mixed),
    ("BPE encoding", bpe.encoded),
]

#: SQL expresses none of these stages; tests hold each against brute force or a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
