"""Exact dedup by a tree-merge of sorted digest runs; DataFrame functions only.

Every row gets the SHA-256 of its text after lower-casing A-Z, once: identifiers and digests are written. The digests of a partition
form its run, one row per digest with the best identifier and a count. In each round ``fan_in`` neighbouring runs are exchanged and merged (run r goes
to r // fan_in): they come in order of (run, digest), and one pass over that order keeps per digest one verified identifier, until one run is left. A run
is itself spread over tasks by its digests, so the last rounds are as parallel as the first; and since a digest has at most one row
in each run, a group of copies that holds a third of all rows shrinks by ``fan_in`` in each round instead of meeting in one task.

Spark sorts what a task receives; it has no merge that takes the runs as already sorted.

Verified: byte length and an independent 64-bit hash of the text travel with the digest and belong to the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, written

RUNS, FAN_IN = 64, 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest binary, size, check): null text counts as empty."""
    t = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("size"), F.xxhash64("t").alias("check"))


def merged_runs(d: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN, keep: str = "max") -> DataFrame:
    """One row per digest: digest, size, check, keep_id, group_size."""
    key = ["digest", "size", "check"]
    best = {"max": F.max, "min": F.min}[keep]
    cur = d.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
    cur = cur.groupBy("run", *key).agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    first = F.col("keep_id").desc_nulls_last() if keep == "max" else F.col("keep_id").asc_nulls_last()
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        # the runs that meet are in order of digest together, and a window passes over that order once
        cur = cur.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", *key).sortWithinPartitions("run", *key, first)
        same = Window.partitionBy("run", *key)
        cur = cur.withColumns({"i": F.row_number().over(same.orderBy(first)), "group_size": F.sum("group_size").over(same)}).where("i = 1").drop("i")
    return cur.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_in: int = FAN_IN, keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id (``keep="min"``:
    the smallest) stays. Null text counts as empty. A null id never wins against an id; a group of null ids only has a null keep_id and
    keeps none of its rows. Repeated rows with the winning id are all marked kept, as no column tells them apart.
    Empty input gives an empty result. Extra columns are ignored.
    """
    d, _ = written(digests(docs, id_col, text_col), "digests")
    groups = merged_runs(d, runs, fan_in, keep)
    # a plain equi-join: the copies of one digest are a skewed side that Spark splits at run time
    out = d.join(groups, ["digest", "size", "check"])
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       coalesce(doc_id = max(doc_id) over (partition by h), false) as kept, h as text_sha256
from d
"""
