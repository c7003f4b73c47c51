"""The corpus pipeline: from all documents to shards of a deduplicated, decontaminated, mixed corpus.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.decontamination import benchmark_hits
from shelfspark.llm.mixing import mix_documents
from shelfspark.llm.ngram_join import one_of_each
from shelfspark.llm.quality import quality_rules
from shelfspark.llm.sharding import balanced_shards
from shelfspark.session import cut_lineage, drop_folder, scratch_folder, table

#: Some stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and one column with all others, so that no name clashes with an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines prevail.

    Null and empty texts fail the rules and go. Repeated rows stay or go
    together; ties between line labels go to content. Columns of any name stay
    as they are. Empty documents give an empty result; without labels all lines
    are content.
    """
    return quality_rules(packed(docs), table(spark, sf_dir, "labels"), ["row"]).filter("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more.

    The one with the smallest doc_id stays, and of rows with its doc_id and text
    one; texts without words stay. Columns of any name stay as they are. Empty
    documents give an empty result.
    """
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts stay; repeated rows stay or go together. Columns of any
    name stay as they are. An empty benchmark drops nothing.
    """
    return benchmark_hits(packed(docs), table(spark, sf_dir, "benchmark"), ["row"]).filter(~F.col("contaminated")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    Rows without words are never taken; null sources are one source; repeated
    rows share what the mix takes of them. Columns of any name stay as they are.
    Empty documents give an empty result.
    """
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot in it for each row.

    Null texts count as empty ones; repeated rows are rows like any other. Only
    doc_id is kept of the documents' columns. Empty documents give an empty
    result.
    """
    return balanced_shards(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_sources", mix),
    ("balanced_sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; what is between them is written to the shared checkpoint folder."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = scratch_folder(spark)
        out = cut_lineage(stage(spark, docs, sf_dir), folder)
        if held:
            drop_folder(spark, held)
        docs, held = out, folder
    return STAGES[-1][1](spark, docs, sf_dir)
