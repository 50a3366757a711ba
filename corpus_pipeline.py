"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.

Nulls: a null or empty text has too few words and goes in the first stage; a null doc_id is kept. Repeated rows and ties:
of rows that near-dedup links, those of one text among them, the one with the smallest doc_id and text stays. An empty
table stays empty through all stages. Texts of any length are read whole. Columns beside doc_id and text stay, whatever
their names, up to the last stage, which returns the pieces of documents and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideway.llm import common, decontaminate, packing, quality, secrets, simhash

STAGES = [
    ("quality rules", quality.accepted),
    ("SimHash near-dedup", simhash.keep_representatives),
    ("benchmark decontamination", decontaminate.uncontaminated),
    ("secret scans", secrets.without_secrets),
    ("best-fit packing", packing.pack_documents),
]

#: SQL can't express fingerprint links, forest scores and tokenizers; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
