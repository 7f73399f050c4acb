"""Links between sets of which nearly all elements are shared by many: families about the threshold, template lines, common passages.

Given sets that belong to components, all links between different components are found, or enough of them to join the same
components. An element that occurs in one component only can't be in the intersection of such a pair, so a set of size s
counts only if a share t of it, the threshold, occurs in several components; dropping the others makes further elements private, and so on (``ROUNDS`` times: each is exact).
Sets equal on what is left are a class. Within it, a link depends on sizes alone, and whoever links with any member links with the smallest.

Classes meet in clusters: those connected by the rarest elements of each, of which linked classes share one. A cluster is dealt to tiles of
bounded size within bands of set sizes, and up to ``SQUARE`` tiles make a side: so few that there are pairs of sides for all tasks, so a small cluster's tiles are sides of their own.
A task gets two sides of equal or adjacent bands and compares their tiles pair by pair, so that a class travels once a side of its cluster; it returns no more than a spanning forest and, for each class, the largest size of a member that links
with another class. So rows out stay below rows in. The comparisons within a cluster grow with its square, as none of its sets can be told apart by any element
that it has, and what travels grows as that over a side's sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import few, restricted
from .common import Forest, components, partitions, written

ROUNDS = 2
TILE, TILE_ELEMENTS = 256, 100_000
SQUARE = 16
STRIPE = 4096


def shared_elements(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, c, size, g): in order, the elements that occur in several components, of the sets of which they are num/den or more.

    Sets stay whole where the elements that several components have are few enough for a broadcast; beyond it only (id, element) is shuffled.
    Rows that repeat a set are one.
    """
    rows = sets.select("id", "c", F.size("h").cast("long").alias("size"), F.col("h").alias("g"))
    for _ in range(ROUNDS):
        several = rows.select("c", F.explode("g").alias("t")).groupBy("t").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("t")
        several, _ = written(several, "several")
        left = restricted(rows.select("id", F.explode("g").alias("t")), several, "t").groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("g"))
        enough = rows.groupBy("id").agg(F.min("c").alias("c"), F.min("size").alias("size")).join(left, "id").where(F.size("g") * den >= F.col("size") * num)
        rows, _ = written(enough.select("id", "c", "size", "g"), "shared")
    return rows


def intersections(xs: list[np.ndarray], ys: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each of xs with each of ys (None: xs)."""
    same = ys is None
    ys = xs if same else ys
    fx, fy = np.concatenate(xs), np.concatenate(ys)
    rx, ry = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (xs, ys))
    if same:
        both, n = np.unique(fx, return_counts=True)
        both = both[n > 1]
    else:
        both = np.intersect1d(fx, fy)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(both):
        return out.astype(np.int64)
    at_x, at_y = np.searchsorted(both, fx), np.searchsorted(both, fy)
    ok_x, ok_y = both[np.minimum(at_x, len(both) - 1)] == fx, both[np.minimum(at_y, len(both) - 1)] == fy
    rx, at_x, ry, at_y = rx[ok_x], at_x[ok_x], ry[ok_y], at_y[ok_y]
    for a in range(0, len(both), STRIPE):
        m = min(STRIPE, len(both) - a)
        sides = []
        for r, at, k in ((rx, at_x, len(xs)), (ry, at_y, len(ys))):
            on = (at >= a) & (at < a + m)
            x = np.zeros((k, m), np.float32)
            x[r[on], at[on] - a] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T  # counts of at most 2**24 are exact
    return out.astype(np.int64)


def tile_links(x: tuple, y: tuple | None, num: int, den: int):
    """Rows (a, b, most) for two tiles, each (class ids, least sizes, element arrays), or for one tile with itself.

    Forest edges have ``most`` -1; other rows say that members of class a of up to ``most`` elements link with class b's smallest.
    """
    same = y is None
    ids_x, size_x, sets_x = x
    ids_y, size_y, sets_y = x if same else y
    n = intersections(sets_x, None if same else sets_y)
    # a link needs (num + den) * n >= num * (sizes' sum)
    room = (num + den) * n // num
    link = room >= size_x[:, None] + size_y[None, :]
    if same:
        np.fill_diagonal(link, False)
    i, j = np.nonzero(link)
    forest = Forest(len(ids_x) if same else len(ids_x) + len(ids_y))
    forest.join(i, j if same else j + len(ids_x))
    every = ids_x if same else np.concatenate((ids_x, ids_y))
    inner = np.flatnonzero(forest.root != np.arange(len(every)))
    out = [(every[inner], every[forest.root[inner]], np.full(len(inner), -1))]
    for ids, others, reach, linked in ((ids_x, ids_y, room - size_y[None, :], link), (ids_y, ids_x, (room - size_x[:, None]).T, link.T))[: 1 if same else 2]:
        best = np.where(linked, reach, -1)
        if best.shape[1]:
            at = best.argmax(1)
            most = best[np.arange(len(ids)), at]
            on = most > 0
            out.append((ids[on], others[at[on]], most[on]))
    return (np.concatenate(c) for c in zip(*out))


def _least_rows(rows: list[np.ndarray]) -> pa.Table:
    """Of many tiles' rows (a, b, most) one spanning forest, and each class's largest ``most``."""
    a, b, most = (np.asarray(c, np.int64) for c in rows)
    edge = most < 0
    every, at = np.unique(np.concatenate((a[edge], b[edge])), return_inverse=True)
    forest = Forest(len(every))
    forest.join(at[: edge.sum()], at[edge.sum() :])
    inner = np.flatnonzero(forest.root != np.arange(len(every)))
    order = np.lexsort((b[~edge], -most[~edge], a[~edge]))
    a, b, most = a[~edge][order], b[~edge][order], most[~edge][order]
    best = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    out = zip((every[inner], every[forest.root[inner]], np.full(len(inner), -1)), (a[best], b[best], most[best]))
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["a", "b", "most"])


def family_links(sets: DataFrame, num: int = 3, den: int = 4, tile: int = TILE, tile_elements: int = TILE_ELEMENTS, square: int = SQUARE) -> DataFrame:
    """Edges (a, b) that join the components of the sets (id, c, h) of distinct longs wherever two sets of different components have a Jaccard of num/den or more."""
    full = shared_elements(sets, num, den).withColumns({"k1": F.xxhash64("g"), "k2": F.xxhash64(F.lit(1), "g")})
    smallest = F.min(F.struct("size", "id")).alias("s")
    classes = full.groupBy("k1", "k2").agg(smallest).select("k1", "k2", F.col("s.id").alias("k"), F.col("s.size").alias("least"))
    members = full.select("id", "size", "k1", "k2", F.size("g").alias("n")).join(classes, ["k1", "k2"]).select("id", "size", "n", "k", "least")
    members, _ = written(members, "family-members")
    star = members.where("id <> k").where((num + den) * F.col("n") >= num * (F.col("size") + F.col("least"))).select(F.col("k").alias("a"), F.col("id").alias("b"))
    own = members.where("id = k").select("id").withColumnRenamed("id", "k")
    one = full.select(F.col("id").alias("k"), F.col("size").alias("least"), "g").join(own, "k", "left_semi")
    # the rarest elements of each class: linked classes share one of them
    elements = one.select("k", "least", F.size("g").alias("n"), F.explode("g").alias("t"))
    counts, _ = written(elements.groupBy("t").agg(F.count("*").alias("df")), "family-counts")
    first = elements.join(few(counts), "t").groupBy("k", "least", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    width = (F.col("n") - F.ceil(F.col("least") * num / F.lit(float(den)) - F.lit(1e-9)) + 1).cast("int")
    first, _ = written(first.select("k", F.explode(F.slice("ts", F.lit(1), F.greatest(width, F.lit(0)))).alias("x")).where("x.df > 1").select("k", F.col("x.t").alias("t")), "family-prefixes")
    head = first.groupBy("t").agg(F.min("k").alias("m"))
    clusters, _ = written(components(first.join(head, "t").where("k <> m").select("k", "m").distinct(), "k", "m"), "clusters")
    band = F.floor(F.log("least") / math.log(1.001 * den / num)).cast("int")
    dealt = one.join(clusters.select(F.col("node").alias("k"), F.col("component").alias("cluster")), "k").withColumns({"n": F.size("g"), "band": band})
    amount = dealt.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / tile_elements)).cast("int").alias("tiles"))
    amount, _ = written(amount, "family-tiles")
    tasks = partitions(sets.sparkSession)
    step = F.greatest(F.lit(1), F.least(F.lit(square), F.floor(F.col("tiles") / F.lit(math.sqrt(2 * tasks))))).cast("int")
    sides = F.ceil(F.col("tiles") / step).cast("int")
    beside = lambda name, by: amount.select("cluster", (F.col("band") + by).alias("band"), sides.alias(name))
    info = amount.withColumns({"sides": sides, "step": step}).join(beside("above", -1), ["cluster", "band"], "left").join(beside("below", 1), ["cluster", "band"], "left")
    dealt = dealt.join(info, ["cluster", "band"]).withColumn("tile", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")).withColumn("p", F.floor(F.col("tile") / F.col("step")).cast("int"))
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda b1, p1, b2, p2, side: F.struct(b1.alias("b1"), p1.alias("p1"), b2.alias("b2"), p2.alias("p2"), side.cast("int").alias("side"))
    p, b = F.col("p"), F.col("band")
    to = F.concat(
        F.transform(upto("sides"), lambda q: pair(b, F.least(p, q), b, F.greatest(p, q), p > q)),
        F.transform(upto("above"), lambda q: pair(b, p, b + 1, q, F.lit(0))),
        F.transform(upto("below"), lambda q: pair(b - 1, q, b, p, F.lit(1))),
    )
    dealt = dealt.select("cluster", F.explode(to).alias("to"), "tile", "k", "least", "g").select("cluster", "to.*", "tile", "k", "least", "g")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, tile_no, ids, least = (table.column(c).to_numpy() for c in ("side", "tile", "k", "least"))
        lists = table.column("g").combine_chunks()
        flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()

        def tiles(s: int) -> list[tuple]:
            out = []
            for t in np.unique(tile_no[side == s]):
                on = np.flatnonzero((side == s) & (tile_no == t))
                out.append((ids[on], least[on], [flat[off[i] : off[i + 1]] for i in on]))
            return out

        first, second = tiles(0), tiles(1)
        pairs: list[tuple] = []
        if table.column("b1")[0] == table.column("b2")[0] and table.column("p1")[0] == table.column("p2")[0]:
            # a side with itself
            pairs = [(x, None if i == j else first[j]) for i, x in enumerate(first) for j in range(i, len(first))]
        elif first and second:  # where bands differ, one side alone has nothing to meet
            pairs = [(x, y) for x in first for y in second]
        return _least_rows([np.concatenate(c) for c in zip(*(tuple(tile_links(x, y, num, den)) for x, y in pairs))] if pairs else [np.zeros(0, np.int64)] * 3)

    found, _ = written(dealt.groupBy("cluster", "b1", "p1", "b2", "p2").applyInArrow(run, "a bigint, b bigint, most bigint"), "family-links")
    reach = found.where("most > 0").groupBy(F.col("a").alias("k")).agg(F.max(F.struct("most", "b")).alias("r"))
    near = members.where("id <> k").join(reach, "k").where(F.col("size") <= F.col("r.most")).select(F.col("r.b").alias("a"), F.col("id").alias("b"))
    out, _ = written(found.where("most = -1").select("a", "b").union(star).union(near), "edges")
    return out
