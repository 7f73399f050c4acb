"""The corpus pipeline: quality classifier, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Every stage gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import ascii_lower, read_table, written
from lumenweave.llm.op1_bpe import encode_texts
from lumenweave.llm.op3_mixing import mix_sources
from lumenweave.llm.op6_exact_dedup import exact_dedup
from lumenweave.llm.op9_quality import score_documents
from lumenweave.llm.op10_ngram_join import ngram_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and blank texts are rejected; rows that repeat, or have a null id, are judged each."""
    return score_documents(docs.select(*COLUMNS)).where("quality_kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, that with the largest id; a null id counts as the smallest.

    Null text counts as empty. Of rows that repeat the winning id the least in order of all columns stays.
    """
    groups, _ = written(exact_dedup(docs).select("keep_id", "text_sha256").distinct(), "groups")
    rows = docs.select(*COLUMNS).withColumn("sha", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    # with the id in the key the copies of one text are spread over the tasks
    one = rows.join(groups, rows.sha.eqNullSafe(groups.text_sha256) & rows.doc_id.eqNullSafe(groups.keep_id), "left_semi")
    one, _ = written(one, "kept")
    if one.count() > groups.count():
        one = one.groupBy("sha").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return one.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id. Rows with a null id link with nothing and stay; rows that share an id are one document."""
    drop = ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(drop, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words over its size, rounded half up.

    Rows are told apart by all their columns, so that null and repeated ids are taken like others; blank texts are not taken.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("key"))
    taken = mix_sources(keyed.select(F.col("key").alias("doc_id"), "text", "source")).where("size > 0").select(F.col("doc_id").alias("key"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    taken = taken.groupBy("key").agg(F.max("times").alias("times")).where("times > 0")
    return keyed.join(taken, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the token ids' digest and decoded text's digest of every row, repeated ones and those without an id as well."""
    return encode_texts(docs.select("doc_id", "source", "lang", "text"), digests=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: EM, a trained scorer and BPE have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
