"""Exact Jaccard join on word 5-grams by universe-partition pigeonhole.

A hash deals the universe of shingles into m segments, m depending on the size band of a set (band k: sizes 2**k to 2**(k+1) - 1); a set
indexes itself in its own band and in the lower bands in which a partner may lie. Two sets with Jaccard >= 3/4 differ in at
most H = floor((|R| + |S|) / 7) shingles. A segment is worth the differences that it takes to hide an agreement there:
one if only its exact subset is indexed, two if its one-deletion neighbourhood is as well (one if it holds one
shingle), none if it is empty. If the worth of a set's segments exceeds H, every partner shares a signature with it.
For each band the costs of allocations (m, exact or with one-deletion) are compared: signatures expected plus the
chance of sets with too little worth. Such sets index each of their shingles singly as well, which finds any pair.

Heat: a bucket of over ``COLD`` sets is hot, and gives a star of candidates only. If a set's worth without its hot buckets
still exceeds H, its links are found in the cold ones. Sets for which it does not are completed in a second step (see families.py),
which finds what joins different components: copies have become one component by then.

Every pair is verified on the sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BLOB_DDL, BROADCAST_IDS, COLD_PAIR, HOT, Packer, candidate_pairs, parts_for
from .common import U64, as_bytes, components, drop_path, mix, read_table, shingle_sets, small_batches, written
from .families import family_links

COLD = 16
N = 5
NUM, DEN = 3, 4  # the threshold
_MASK = (1 << 64) - 1
_K1, _K2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def most_differences(r, s):
    return (r + s) * (DEN - NUM) // (DEN + NUM)


def allocation(band: int) -> tuple[int, bool]:
    """(segments, one-deletion?) of least expected cost for a set in the middle of the band."""
    size, top = 1.5 * 2**band, 2 ** (band + 1) - 1
    need = most_differences(top, top) + 1
    best = None
    for one in (False, True):
        for per in (1.2, 1.6, 2.0, 2.4, 2.8, 3.4, 4.0, 5.0, 6.0, 7.0, 8.0):
            m = max(1, math.ceil(top / per))
            if m * (2 if one else 1) < need:
                continue
            x = size / m
            empty, single = math.exp(-x), x * math.exp(-x)
            worth = m * ((2 * (1 - empty) - single) if one else 1 - empty)
            spread = math.sqrt(max(1e-9, m * empty * (1 - empty))) * (2 if one else 1) + 0.3
            wanted = most_differences(size, size / 0.75) + 1 + 0.06 * size  # some heat is to be borne
            unsafe = 0.5 * math.erfc((worth - wanted) / spread / math.sqrt(2))
            cost = m * (1 - empty) + (size if one else 0) + unsafe * 4 * size
            best = min(best or (math.inf,), (cost, m, one))
    return best[1], best[2]


ALLOCATION = [allocation(k) for k in range(40)]


def band_of(size: int) -> int:
    return size.bit_length() - 1


def bands_for(size: int) -> range:
    """Own band and those below in which a smaller partner may lie."""
    return range(band_of(-(-size * NUM // DEN)), band_of(size) + 1)


def signatures(h: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a set of sorted distinct hashes, and the least worth in excess of H over its bands (0 or less: unsafe)."""
    size, out, spare = len(h), [], 1 << 40
    token = mix(h * _K2 + U64(1))
    for band in bands_for(size):
        m, one = ALLOCATION[band]
        seg = ((h >> U64(32)) * U64(m)) >> U64(32)
        start = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        total = np.add.reduceat(token, start)
        salt = seg[start] * _K1 + U64((band + 1) * int(_K2) & _MASK)
        out.append(mix(total + salt))
        worth = len(start)
        if one:
            count = np.diff(np.append(start, size))
            big = np.repeat(count > 1, count)
            out.append(mix((np.repeat(total, count) - token + np.repeat(salt, count))[big]))
            worth = int(np.minimum(count, 2).sum())
        largest = min(size * DEN // NUM, 2 ** (band + 1) - 1 if band < band_of(size) else size * DEN // NUM)
        spare = min(spare, worth - int(most_differences(size, largest)))
    return np.concatenate(out), spare


def least_shared(h: np.ndarray) -> int:
    """Buckets that any partner shares with the set at least, were none hot; 0 or less: none for sure."""
    if not len(h):
        return 0
    spare = signatures(h)[1]
    return spare // 2 if spare > 0 and any(ALLOCATION[k][1] for k in bands_for(len(h))) else spare


def singles(h: np.ndarray) -> np.ndarray:
    return mix(h * _K1 + U64(99))


def _ids_and_sets(batch):
    ids = batch.column(0).to_pylist()
    return zip(ids, shingle_sets(as_bytes(batch.column(1).to_pylist()), N))


def _key(h: np.ndarray) -> tuple[int, int]:
    a, b = mix(h * _K1 + U64(3)).sum(dtype=np.uint64), mix(h * _K2 + U64(5)).sum(dtype=np.uint64)
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, spare): size and 128-bit key of the set, and least_shared; docs are (doc_id, text)."""

    def rows(batches):
        for batch in batches:
            out = []
            for i, h in _ids_and_sets(batch):
                out.append((i, len(h), *_key(h), least_shared(h)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 5, (pa.int64(),) * 5)], ["doc_id", "n_shingles", "k1", "k2", "spare"])

    return docs.mapInArrow(rows, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, spare bigint")


def speaking(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, text, k1) of the given ids: k1 tells which text speaks for an id that is repeated with another one."""
    few = reps.select("doc_id", "k1").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    few, _ = written(few, "ids")
    return docs.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, "doc_id").select("doc_id", "text", "k1")


def _spoken(batch):
    """(row, doc_id, set) of the rows whose text speaks for their id."""
    for row, ((i, h), k1) in enumerate(zip(_ids_and_sets(batch), batch.column(2).to_pylist())):
        if len(h) and _key(h)[0] == k1:
            yield row, i, h


def _packed(docs: DataFrame, parts: int, cold: int) -> DataFrame:
    def rows(batches):
        packer = Packer(parts, cold)
        for batch in batches:
            for _, i, h in _spoken(batch):
                s, spare = signatures(h)
                if spare <= 0:
                    s = np.concatenate((s, singles(h)))
                yield from packer.add(s, np.full(len(s), i, np.int64))
        yield from packer.flush()

    return docs.mapInArrow(rows, BLOB_DDL)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h): sorted hashes as an array of long."""

    def rows(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = [(i, h.view(np.int64)) for _, i, h in _spoken(batch.slice(a, 500))]
                flat = np.concatenate([h for _, h in part] or [np.zeros(0, np.int64)])
                off = np.concatenate(([0], np.cumsum([len(h) for _, h in part]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "h"])

    return docs.mapInArrow(rows, "doc_id bigint, h array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold exactly.

    Texts travel, as they are smaller than their sets. The side b, mostly distinct, is joined first; a hot a is split by Spark.
    """
    texts = lambda c: speaking(docs, pairs.select(F.col(c).alias("doc_id")), reps).select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"), F.col("k1").alias(f"k{c}"))
    both = pairs.select("a", "b").join(texts("b"), "b").join(texts("a"), "a").select("a", "b", "ta", "tb", "ka", "kb")

    def rows(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                one, two = (shingle_sets(as_bytes(batch.column(c).to_pylist()), N) for c in (2, 3))
                ok = []
                for x, y, ka, kb in zip(one, two, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                    z = np.sort(np.concatenate((x, y)))
                    same = int(np.count_nonzero(z[1:] == z[:-1]))
                    ok.append(DEN * same >= NUM * (len(x) + len(y) - same) and _key(x)[0] == ka and _key(y)[0] == kb)
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(rows, "a bigint, b bigint")


def ngram_components(docs: DataFrame, cold: int = COLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the smallest doc_id reachable by links, itself included.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts with fewer than five words have their whole sequence as one
    shingle; null and blank texts have none and link with nothing. Rows with a null doc_id link with nothing and have a null component.
    Rows that repeat a doc_id are one document; if their texts differ, the text of the smallest set (then key) finds its links.
    Empty input gives an empty result; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    table, _ = written(set_table(docs), "sets")
    one = F.min(F.struct("n_shingles", "k1", "k2", "spare")).alias("x")
    used = table.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(one).select("doc_id", "x.*")
    # sets that are equal are one class; its smallest id stands for it
    classes = used.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    copies, _ = written(used.join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "rep", "k1", "spare", F.col("n_shingles").alias("size")), "copies")
    reps = copies.where("doc_id = rep").select("doc_id", "k1", "size", "spare")
    found, found_path = written(candidate_pairs(_packed(speaking(docs, reps, reps), parts_for(docs), cold), cold), "pairs")
    hot = found.where(f"kind = {HOT}").groupBy(F.col("a").alias("doc_id")).agg(F.sum("n").alias("hot"))
    # a link shares at least its ends' spare buckets, less their hot ones, among the cold ones
    ends = reps.join(hot, "doc_id", "left").select("doc_id", "size", (F.col("spare") - F.coalesce("hot", F.lit(0))).alias("need"))
    left, right = (ends.select(F.col("doc_id").alias(c), F.col("size").alias(f"s{c}"), F.col("need").alias(f"n{c}")) for c in "ab")
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    summed = found.where(f"kind <> {HOT}").groupBy("a", "b").agg(count(COLD_PAIR).alias("n_cold"), F.sum("n").alias("n"))
    summed = summed.join(left, "a").join(right, "b").withColumn("lo", F.least("sa", "sb")).withColumn("hi", F.greatest("sa", "sb")).where(F.col("lo") * DEN >= F.col("hi") * NUM)
    due, likely = F.col("n_cold") >= F.greatest(F.lit(1), "na", "nb"), F.col("n") * 10 >= F.col("hi")
    pairs, pairs_path = written(summed.withColumns({"due": due, "likely": likely}).where("due or likely").select("a", "b", "n", "due", "likely"), "pairs")
    # first each set with its best partner: that makes most components
    best = pairs.where("likely").groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    edges, _ = written(verified(best, docs, reps), "edges")
    # then every due candidate whose ends are still apart
    comp, _ = written(components(edges), "components")

    def apart(p: DataFrame, comp: DataFrame) -> DataFrame:
        left, right = comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        p = p.join(left, "a", "left").join(right, "b", "left")
        return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest, _ = written(apart(pairs, comp), "rest")
    more, _ = written(verified(rest, docs, reps), "edges")
    edges = edges.union(more)
    # sets whose worth without their hot buckets does not exceed H
    heated, _ = written(ends.join(hot, "doc_id", "left_semi").where("need <= 0").select("doc_id"), "heated")
    if not heated.isEmpty():
        comp, _ = written(components(edges), "components")
        edges = edges.union(_completed(docs, heated, reps, comp))
    drop_path(docs.sparkSession, found_path, pairs_path)
    links = edges.union(copies.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comp = components(links)
    out = table.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _completed(docs: DataFrame, heated: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
    """Links among heated sets that are still in different components: both ends of such a link are heated."""
    sets, _ = written(_sets(speaking(docs, heated, reps)), "heated-sets")
    every = sets.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return family_links(every.select(F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("c"), "h"), NUM, DEN)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     s as materialized (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
           else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end) as g from w),
     n as materialized (select doc_id, count(*) as n from s group by doc_id),
     same as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
     links as materialized (select a, b from same join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
     reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, t.component_id
from documents d join (select a, min(b) as component_id from reach group by a) t on t.a = d.doc_id left join n on n.doc_id = d.doc_id
"""
