"""Corpus pipeline: from ``documents`` to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, clashing and extra ones included.  Every
stage works on all rows that its predecessor kept.  Null texts count as empty,
null and repeated ids as rows of their own, long texts are worked on whole, and an
empty table gives an empty one.  The stages' operators are described in
``sonospan.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonospan.llm.best_fit_packing import pack
from sonospan.llm.budget_mix import mixed
from sonospan.llm.common import n_words, written
from sonospan.llm.jaccard_join import jaccard_groups
from sonospan.llm.line_dedup import line_dedup
from sonospan.llm.quality_rules import fit, with_quality

TOKENIZER = "word_bpe_49k.json"
#: Rows an Arrow batch: texts are long, and a worker and its executor hold a few batches at a time.
BATCH_ROWS = 1000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.  The forest and its thresholds come from the labelled ones.

    Null and empty texts have no words and fail; repeated rows share a verdict; without labels only the base limits reject.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, then documents of which no word is left.

    The earliest of repeated lines by (id, text, line) stays, so of copies one keeps its lines; ``n_chars`` follows the text; null texts go.
    """
    left = line_dedup(docs).filter(n_words("text") > 0)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays: that with the smallest id (nulls first), then text hash, then row number.

    Rows are told apart by number, so repeated and null ids lose no unlinked row; texts without words link with nothing and stay.
    """
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()))  # numbers stay as they are once written
    groups = jaccard_groups(rows.select(F.struct("doc_id", F.xxhash64("text").alias("hash"), "row").alias("doc_id"), "text"))
    return rows.join(groups.filter("doc_id.row <> component_id.row").select("doc_id.row"), "row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it: nought to two times.  A null source is a source; ties go by a hash of the id, then of the text."""
    return mixed(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.  Repeated rows are packed each; an empty text is one token."""
    return pack(docs, public_tokenizers.path(TOKENIZER), words_held=100_000)


#: The setting holds for the session from the first stage on: a stage's plan runs after its function returns, when it is written.
def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(spark.conf.get(name))
        spark.conf.set(name, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", in_small_batches(quality)),
    ("line dedup", in_small_batches(lines)),
    ("n-gram Jaccard join", in_small_batches(near_copies)),
    ("mixing sources to target weights", in_small_batches(mix)),
    ("best-fit packing", in_small_batches(sequences)),
]

#: The forest, the knapsack and the packing search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between stages is written to the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
