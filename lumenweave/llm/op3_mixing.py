"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a target
stops at twice its source's size and the excess is reshared by weight until none is above. That is the level L with
sum(min(2 * size, L * weight)) = total, found by one ordered pass over the sources.

Schedule: slot n takes the golden-ratio point frac(n * phi), which the cumulative shares map to a source. A source's share is that of
the slots that its target needs: K for each full lap, the last of which may be short, and those of the rest. Slots are
ranked within their source; rank r takes block r mod K of the source's K equal-token blocks, whose order is that of
the documents shuffled by hash. Slots that the schedule leaves a source short of follow at its end, and a source's last slot
is cut so that its taken words equal its target.

Both rankings (documents within a source, slots within a source) are done on two levels, chunks and rows within a
chunk, so no task holds a source. Slots meet sources by an equi-join on cells of [0, 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

BLOCK = 1024
CELLS = 4096
DOC_CHUNKS = 4096
SLOT_CHUNK = 4096
WEIGHTS = (5, 2, 1)
GOLDEN = 1327217885  # the odd integer next to 2**31 / phi


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size). The windows run over one row per source."""
    by = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int")).cast("double")
    every = Window.partitionBy()
    s = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(share)).withColumn("w_all", F.sum("w").over(every))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("limits", F.coalesce(F.sum("limit").over(up), F.lit(0.0))).withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    # the first source, by ratio, whose own level does not exceed its ratio fixes the common level
    s = s.withColumn("own", (F.col("total") - F.col("limits")) / F.col("w_left"))
    s = s.withColumn("level", F.max(F.when(F.col("own") <= F.col("ratio"), F.col("own"))).over(every))
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots (source, source_size, target, rank): rank counts a source's slots from 0 in the order of the schedule, and reaches its target."""
    spark = targets.sparkSession
    wanted = F.round("target").cast("long")
    laps = F.floor(wanted / F.col("source_size"))
    needed = laps * F.ceil(F.col("source_size") / block) + F.ceil((wanted - laps * F.col("source_size")) / block)
    targets = targets.where(wanted > 0).withColumn("needed", needed)
    by = Window.orderBy(F.col("source").isNull(), "source")
    total = targets.agg(F.sum("needed")).first()[0] or 0
    t = targets.withColumn("hi", F.sum("needed").over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(total)))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(by), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(by).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    n = total + math.ceil(0.01 * total) + 64 * math.ceil(math.log2(total + 2)) if total else 0  # the discrepancy is logarithmic; a source takes no more than its target
    # frac(n * phi) in 31-bit integers: exact and without overflow for any n, each full period being perfectly even
    point = ((F.col("id") % (1 << 31)) * F.lit(GOLDEN)) % (1 << 31) / F.lit(float(1 << 31))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    s = slots.join(cells, "cell").where("u >= lo and u < hi").withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    s = s.select("source", "source_size", "target", "slot", "chunk")
    counts = s.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    s = s.withColumn("i", F.row_number().over(within) - 1).alias("s").join(counts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.chunk") == F.col("c.chunk")))
    ranked = s.select("s.source", "s.source_size", "s.target", (F.col("before") + F.col("i")).alias("rank"))
    given = counts.groupBy("source").agg(F.max(F.col("before") + F.col("n")).alias("given"))
    short = targets.alias("t").join(given.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")), "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < needed")
    return ranked.union(short.select("t.source", "source_size", "target", F.explode(F.sequence(F.col("given"), F.col("needed") - 1))))


def mix_sources(docs: DataFrame, block: int = BLOCK, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Size is the number of words; null and blank texts have none and nothing of them is taken. A null source is a source of its own,
    last in order. Rows are told apart by id and, for repeated ids, by text; equal rows share their slots evenly because
    each occupies words of its own. Empty input gives an empty result; extra columns are ignored.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    d, _ = written(d, "sizes")
    chunk = F.shiftrightunsigned(F.col("h"), 64 - int(math.log2(DOC_CHUNKS)))
    d = d.withColumn("chunk", chunk)
    sums = d.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets, _ = written(source_targets(sizes, share, cap, weights), "targets")
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("at"))
    within = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("off", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.alias("d").join(starts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.chunk") == F.col("p.chunk")))
    placed = placed.select("d.doc_id", "d.source", "d.size", F.monotonically_increasing_id().alias("row"), (F.col("at") + F.col("off")).alias("lo")).withColumn("hi", F.col("lo") + F.col("size"))
    placed, _ = written(placed, "placed")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    # rank r of a source is block r mod K of lap r div K; the words still wanted cut the last slot
    k = F.ceil(F.col("source_size") / block)
    slots = schedule(targets, block).withColumn("block", F.col("rank") % k).withColumn("start", F.floor(F.col("rank") / k) * F.col("source_size") + F.col("block") * block)
    width = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    slots = slots.withColumn("words", F.least(width, F.round(F.col("target")).cast("long") - F.col("start"))).where("words > 0")
    slots = slots.select("source", "block", "words")
    used = pieces.alias("d").join(slots.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.block") == F.col("s.block")))
    first = F.col("d.block") * block
    overlap = F.least(F.col("hi"), first + F.col("words")) - F.greatest(F.col("lo"), first)
    taken = used.select("row", F.greatest(overlap, F.lit(0)).alias("n")).groupBy("row").agg(F.sum("n").alias("taken"))
    out = placed.join(taken, "row", "left").alias("o").join(F.broadcast(targets).alias("t") if targets.count() <= 10_000 else targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))
