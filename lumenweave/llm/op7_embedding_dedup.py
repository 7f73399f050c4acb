"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors have cosine >= c exactly when their squared distance is at most 2 - 2c. A fixed random rotation splits the vectors
into blocks of a few dimensions, and the budget is shared over the blocks in proportion to the energy that the whole table
has in them. Two vectors within the whole budget are within their share in at least one block, so the union of the
blocks' range joins holds every link; its pairs are verified by their cosine in double precision.

Tiles of about ``TILE`` vectors are written once, and their pairs come from a Cartesian product of that table, whose tasks read its parts where they lie: no
tile is shuffled to its pairs, so that disk grows with the vectors and not with their square. The range joins run on one pair of tiles after the
other, in strips along the block's widest coordinate, so memory is bounded and no pair leaves a task: it returns each vector's number of links and a spanning forest of the pair's
links, at most one edge a vector. Components are then joined by distributed union-find. A group of copies, even of a third of
all vectors, is spread over many tiles like all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, drop_path, read_table, small_batches, written

TILE = 4096
STRIP = 512
BLOCK_DIMS = 16
MAX_DIMS = 1000
MAX_TASKS = 20_000
SLACK = 1e-4  # what single precision in the range joins may err


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, width: int = BLOCK_DIMS) -> list[slice]:
    return [slice(a, min(a + width, dim)) for a in range(0, dim, width)]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither tiny nor huge components lose the norm."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_vectors(x: np.ndarray) -> bytes:
    """Rows of doubles as they are; in single precision where that loses nothing, as for vectors that were so stored."""
    with np.errstate(over="ignore", under="ignore"):
        half = x.astype("<f4")
    return (half if (half.astype(np.float64) == x).all() else x.astype("<f8")).tobytes()


def unpacked_vectors(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * rows * dim else "<f8").reshape(rows, dim).astype(np.float64)


def range_join(left: np.ndarray, right: np.ndarray, budget: float):
    """Pairs (i, j) of rows whose squared distance is at most the budget, in bounded lots.

    Both sides are taken in order of their widest coordinate, and a strip of the one meets only those of the other within the budget's radius of it.
    """
    wide = int(np.argmax(left.var(0) + right.var(0)))
    at, to = np.argsort(left[:, wide], kind="stable"), np.argsort(right[:, wide], kind="stable")
    x, y = left[at], right[to]
    x2, y2, reach = (x**2).sum(1), (y**2).sum(1), (budget + SLACK) ** 0.5 + SLACK
    for a in range(0, len(x), STRIP):
        b = min(a + STRIP, len(x))
        lo = int(np.searchsorted(y[:, wide], x[a, wide] - reach, side="left"))
        hi = int(np.searchsorted(y[:, wide], x[b - 1, wide] + reach, side="right"))
        # |l - r|^2 <= budget  <=>  2 l.r - |r|^2 >= |l|^2 - budget
        i, j = np.nonzero((2 * x[a:b]) @ y[lo:hi].T - y2[lo:hi] >= (x2[a:b] - budget - SLACK)[:, None])
        yield at[i + a], to[j + lo]


def join_tiles(x: np.ndarray, y: np.ndarray | None, budgets: list[float], rot: np.ndarray, cosine: float):
    """Links of each row of x, of each row of y (or None: x with itself), and forest edges (i, j) over the rows of x, then y."""
    same = y is None
    y = x if same else y
    rx, ry = (x @ rot).astype(np.float32), (y @ rot).astype(np.float32)
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = Forest(len(x) if same else len(x) + len(y))
    # the union of the blocks' candidates, one bit a pair of the tiles
    near = np.zeros((len(x), len(y)), bool)
    for c, budget in zip(blocks(x.shape[1]), budgets):
        for i, j in range_join(rx[:, c], ry[:, c], budget):
            near[i, j] = True
    for a in range(0, len(x), STRIP):
        i, j = np.nonzero(near[a : a + STRIP])
        i += a
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
            p, q = p[ok], q[ok]
            nx += np.bincount(p, minlength=len(x))
            ny += np.bincount(q, minlength=len(y))
            forest.join(p, q if same else q + len(x))
    if same:
        nx, ny = nx + ny, ny
    inner = np.flatnonzero(forest.root != np.arange(len(forest.root)))
    return nx, None if same else ny, inner, forest.root[inner]


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least ``cosine``. Vectors that are null, zero or hold null or
    non-finite components, and rows with a null id, link with nothing; vectors of different lengths don't link. Ids
    are taken to tell vectors apart: rows that repeat an id are compared each, with one another too, and every one of them gets the sum of their links and
    their common component. Of rows with a null id the component is null, and they are kept.
    component_id is the smallest id reachable; kept says that it is the row's own. Empty input gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("x", lambda e: e != 0)
    good = v.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    small_batches(spark)
    sizes, _ = written(good.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")), "sizes")
    known = sizes.count()  # as a rule one dimension
    of_dim = lambda df: F.broadcast(df) if known <= MAX_DIMS else df

    def pack(batches):
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            part, col = batch.column(3).to_numpy(), batch.column(1)
            flat, off = col.flatten().to_numpy(), np.concatenate(([0], np.cumsum(dims)))
            order = np.lexsort((part, dims))
            group = np.flatnonzero(np.concatenate(([True], np.diff(dims[order]) != 0)) | np.concatenate(([True], np.diff(part[order]) != 0))) if len(order) else []
            out = []
            for g in np.split(order, group[1:]) if len(order) else []:
                d = int(dims[g[0]])
                x = np.stack([flat[off[i] : off[i] + d] for i in g])
                energy = ((units(x) @ rotation(d)) ** 2).sum(0)
                out.append({"dim": d, "tile": int(part[g[0]]), "ids": ids[g].astype("<i8").tobytes(), "x": packed_vectors(x), "energy": energy.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("energy", pa.list_(pa.float64()))]))

    tiles_of = F.greatest(F.lit(1), F.ceil(F.col("n") / tile))
    keyed = good.withColumn("dim", F.size("x")).join(of_dim(sizes), "dim")
    keyed = keyed.select("vec_id", "x", "dim", F.pmod(F.xxhash64("vec_id"), tiles_of).alias("tile"))
    packed = keyed.mapInArrow(pack, "dim int, tile bigint, ids binary, x binary, energy array<double>")
    # the parts of a tile meet as binary pieces; a tile is about ``tile`` vectors whatever the data
    spread = min(MAX_TASKS, int(sizes.agg(F.sum(tiles_of)).first()[0] or 1))
    whole, path = written(packed.repartition(spread, "dim", "tile").groupBy("dim", "tile").agg(F.collect_list(F.struct("ids", "x")).alias("parts"), F.collect_list("energy").alias("energies")), "tiles")
    energy = whole.select("dim", F.explode("energies").alias("e")).select("dim", F.posexplode("e").alias("k", "e")).groupBy("dim", "k").agg(F.sum("e").alias("e"))
    energy, _ = written(energy.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("energy")), "energy")
    left = whole.join(of_dim(energy.select("dim", F.col("energy.e").alias("energy"))), "dim").select("dim", F.col("tile").alias("p"), F.col("parts").alias("x"), "energy")
    right = whole.select(F.col("dim").alias("dim2"), F.col("tile").alias("q"), F.col("parts").alias("y"))
    # no equality that a shuffled join could be made of; which of the two comes first is dealt over the tasks, since tiles may lie in order
    first = F.when((F.col("p") + F.col("q")) % 2 == 0, F.col("p") <= F.col("q")).otherwise(F.col("p") > F.col("q"))
    pairs = left.join(right.hint("shuffle_replicate_nl"), (F.col("dim") - F.col("dim2") == 0) & first).select("dim", "energy", F.col("p") == F.col("q"), "x", "y")

    def load(parts, dim):
        ids = np.frombuffer(b"".join(s["ids"] for s in parts), "<i8")
        return ids, units(np.concatenate([unpacked_vectors(s["x"], len(s["ids"]) // 8, dim) for s in parts]))

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for k in range(batch.num_rows):
                dim, e, same, *sides = (batch.column(c)[k].as_py() for c in range(5))
                e = np.array(e)
                rot, cuts = rotation(dim), blocks(dim)
                share = np.array([e[c].sum() for c in cuts]) + 1e-9
                budgets = ((2 - 2 * cosine) * share / share.sum()).tolist()
                (ids, x), other = load(sides[0], dim), (np.zeros(0, np.int64), None) if same else load(sides[1], dim)
                nx, ny, i, j = join_tiles(x, other[1], budgets, rot, cosine)
                every = np.concatenate((ids, other[0]))
                n = np.concatenate((nx, np.zeros(0, np.int64) if ny is None else ny))
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(every[on]), pa.array(every[on]), pa.array(n[on])], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array(every[i]), pa.array(every[j]), pa.array(np.zeros(len(i), np.int64))], schema=schema)

    found, _ = written(pairs.mapInArrow(run, "a bigint, b bigint, n bigint"), "links")
    drop_path(spark, path)
    links = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n_links"))
    comp = components(found.where("a != b"))
    out = v.select("vec_id").join(links.withColumnRenamed("a", "vec_id"), "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    mine = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(mine == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings where embedding is not null and vec_id is not null
           and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
     links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on len(a.x) = len(b.x) and a.vec_id <> b.vec_id
           where list_cosine_similarity(a.x, b.x) >= 0.9),
     reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
     least as (select a, min(b) as component_id from reach group by a),
     n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, least.component_id, e.vec_id = least.component_id as kept
from embeddings e join least on e.vec_id = least.a left join n on n.a = e.vec_id
"""
