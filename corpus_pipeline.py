"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import line_rules, near_dup, packing, quality_model, secret_scan
from posegrid.llm.common import frozen, table
from posegrid.llm.queries import learnable, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line rules keep, without their failing lines."""
    kept = line_rules.passed(docs)
    changed = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return kept.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality by a model of all ``documents``: what the rules rejected shows it what to reject."""
    vectors, net = quality_model.train(table(spark, sf_dir, "documents"), learnable(table(spark, sf_dir, "labels")))
    return quality_model.kept(docs, vectors, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id. Rows are compared by their texts alone: of rows that share
    an id, or lack one, all stay that are near nothing else."""
    given = docs.columns
    rows = near_dup.told_apart(docs, "doc_id", "text", "_row_no")
    found = near_dup.near_duplicates(rows.select(F.col("_row_no").alias("doc_id"), "text"))
    one = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_row_no"))
    kept = rows.join(one, "_row_no", "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in given))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets masked."""
    out = secret_scan.masked(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizers and a trained network have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
