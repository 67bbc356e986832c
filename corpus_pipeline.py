"""A training corpus from documents: five stages, each a DataFrame of what it keeps.

run() writes each stage's rows as Parquet in the shared folder and reads them back
for the next. Other columns of documents pass through all stages. The last adds the rate of each document and copies,
how often it is to be taken, so that the corpus meets the target mixture; no row goes there.

Null and empty texts go in the first stage (their language can not be told) unless nothing is known of languages, when all stay;
the other stages keep them. Of equal texts one row stays, whatever their ids; rows that repeat an id with different
texts are rows of their own. An empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import op1_ngram_join, op4_mixing, op5_language, op7_decontaminate, op9_lines
from weftgraph.llm.common import Scratch, cut, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can not be told."""
    return op5_language.keep_identified(docs, op5_language.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each site. All documents stay."""
    return op9_lines.drop_boilerplate(docs, op9_lines.site_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, of several such rows one; a row without id
    stays only where no copy of it has one. Rows without words stay."""
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        lost = cut(op1_ngram_join.ngram_components(docs).where("component_id != doc_id").select("doc_id"))
        return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    row, scratch = unused(docs, "weft_row")[0], Scratch(spark)
    keyed = scratch.save("rows", docs.withColumn(row, F.monotonically_increasing_id()))  # written down, so that a row keeps its key
    found = op1_ngram_join.ngram_components(keyed.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("k"), "component_id")
    ids = keyed.select(F.col(row).alias("k"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("rank"))
    ranked = found.join(ids, "k")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    lost = ranked.join(first, "component_id").where("first.row != k").select(F.col("k").alias(row))
    kept = cut(keyed.join(lost, row, "left_anti").select(*docs.columns))
    scratch.drop("rows")
    return kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return op7_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the rates and copies at which they meet the target mixture of domains."""
    return op4_mixing.mix_rows(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: Language, near-duplicate and rate decisions come from trained or iterated models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(f"{k}_{name}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
