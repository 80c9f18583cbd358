"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before has written, and decides on documents as they are by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, jaccard_join, packing, quality
from shelfwise.llm.common import table, written
from shelfwise.llm.line_dedup import LineDedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled ones among docs; an empty text is judged like any other."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, to="__score").where(F.col("__score") >= quality.ACCEPT).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that an earlier one has are gone from the text, and n_chars follows. A null text stays null."""
    state = LineDedup.of(docs)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = state.apply(docs.select("doc_id", "text", F.struct(*others).alias("__others")), state.postings)  # out of the way of the columns that it adds
    kept = kept.select("doc_id", "text", "__others.*")
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, of the least doc_id; exact repeats go, whatever their doc_id is. Documents without words all stay."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a packed sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
