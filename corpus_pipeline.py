"""From raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm import exact_dedup, packing, paragraphs, quality, simhash
from atomweave.llm.common import bounded_batches, column, id_in, staged, unused
from atomweave.llm.queries import quality_model, tokenizer

#: No stage but the second can be said in SQL. The tests hold the operators against plain versions; of the whole they check what each stage keeps.
ORACLE_SQL = None


#: Pre-tokens that a worker of the last stage remembers; fewer than elsewhere, as its executors are full.
REMEMBERED = 150_000


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of the best grade with a probability of ``quality.TAIL`` or more; a null text is rated as an empty one."""
    return quality.select_rated(docs, quality_model(spark, docs, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest text, then the smallest id; null texts are empty."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; null texts and texts without a word stay."""
    at, own = unused(docs, "__gone_id"), unused(docs, "__gone_hash")
    gone = simhash.near_duplicates(docs, shingle=5, similarity=0.8).select(F.col("id").alias(at), F.col("h").alias(own))
    return docs.join(gone, (id_in("doc_id") == F.col(at)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own)), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has already are cut out; documents left without a word go, null texts stay."""
    cut = paragraphs.remove_repeats(docs, spans_col=None)
    rest = cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut
    return rest.where(F.col("text").isNull() | F.col("text").rlike(r"\S")).select(*[column(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 tokens; a null text is one end id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096, remembered=REMEMBERED)


STAGES = [
    ("quality_classifier", rate_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet and read again."""
    docs = bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
