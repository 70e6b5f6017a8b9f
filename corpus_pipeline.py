"""From raw documents to packed sequences: five stages of the llm subpackage, each on what the one before kept.

Quality rules, line dedup, SimHash near-dedup and benchmark decontamination return the columns of documents;
best-fit packing returns one row for each piece of a document with its sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.decontaminate import drop_contaminated
from sitelens.llm.line_dedup import drop_lines
from sitelens.llm.packing import pack_documents
from sitelens.llm.quality import quality_filter
from sitelens.llm.shared import stored, table
from sitelens.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text. A document that was boilerplate alone is left with an empty text and stays."""
    columns = docs.columns
    kept = drop_lines(docs, counts=False)
    if "n_chars" in columns:
        kept = kept.selectExpr(*[f"CAST(length(text) AS {docs.schema['n_chars'].dataType.simpleString()}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in columns])
    return kept.select(*[f"`{c}`" for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: A boosted tree ensemble and fingerprints cannot be written in SQL; a test holds the run against plain Python, over what the
#: quality rules keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
