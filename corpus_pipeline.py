"""A corpus pipeline: language, toxicity, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents. Learned stages learn from the labelled rows among
their own input and drop only what their operator rejects.

In every stage an empty table gives an empty table, texts of any length are read whole, and
columns beside those of documents are not carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import discard, materialize, read_table
from trajecta.llm.decontamination import without_contamination
from trajecta.llm.language_id import identify
from trajecta.llm.language_id import train as train_languages
from trajecta.llm.near_dedup import near_duplicates
from trajecta.llm.packing import pack_documents
from trajecta.llm.toxicity import score_toxicity
from trajecta.llm.toxicity import train as train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _in_small_batches(docs: DataFrame) -> DataFrame:
    """Whole texts go to Python in batches of about 8 MB, so that the stages' workers stay small beside one another."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts without letters, null ones too, and texts that no language's model accepts go; without any labelled row all go.

    Rows are judged one by one: a null doc_id decides nothing, and repeated rows stay repeated.
    """
    found = identify(_in_small_batches(docs), train_languages(docs), carry=tuple(COLUMNS[1:]))
    return found.where("not rejected").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents predicted toxic go; null and empty texts stay.

    Rows are judged one by one: a null doc_id decides nothing, and repeated rows stay repeated.
    """
    scored = score_toxicity(_in_small_batches(docs), train_toxicity(docs, read_table(spark, sf_dir, "labels")), carry=tuple(COLUMNS[1:]))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays.

    Rows that repeat this doc_id are one document: the first by text stays. Texts without words
    and rows without a doc_id are in no group and stay.
    """
    found = near_duplicates(_in_small_batches(docs), percent=80, width=5)
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "gone")
    repeated = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    discard(found)
    stay = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    many = stay.join(repeated, "doc_id", "left_semi").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return once.unionByName(many)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go, row by row: null and repeated doc_ids decide nothing, null texts hold nothing."""
    return without_contamination(_in_small_batches(docs).select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: what is left, in sequences of at most 2048 tokens; null texts are empty documents, repeated rows documents of their own.

    Workers stand beside the heap that the stages before have filled, so they cache a third of the operator's own pieces.
    """
    import public_tokenizers

    return pack_documents(_in_small_batches(docs), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, cache_pieces=300_000)


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: Trained models, near duplicates at edit budgets and packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
