"""What several operators share: the cluster's shared folder, written tables, text hashing, components.

Nothing here keeps state on a machine-local disk. Lineage is cut by Parquet tables under the folder named
in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20
BATCH_BYTES = "8m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the session names another size than Spark's own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is made for a local master, as in tests; a cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lumenweave-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@lru_cache(8)
def _session_dir(shared: str, app: str) -> str:
    """The application's own part of the shared folder, dropped when the driver ends."""
    path = f"{shared}/lw-{app}-{uuid.uuid4().hex[:8]}"

    def drop():
        if (spark := SparkSession.getActiveSession()) is not None:
            with contextlib.suppress(Exception):  # the session may be gone before the folder
                drop_path(spark, path)

    atexit.register(drop)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_session_dir(shared_dir(spark), spark.sparkContext.applicationId)}/{uuid.uuid4().hex}/{name}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is run meanwhile leaves no shuffle files behind; else they stay until the driver collects its garbage. Only for plans that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, so that a lost executor costs no lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of a bounded size, by whatever file system the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for a in range(0, len(data), 1 << 20):
        out.write(bytearray(data[a : a + (1 << 20)]))
    out.close()


def release_memory() -> None:
    """Gives back to the system what a bounded computation on the driver has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that to pure ASCII; the slower ``translate`` serves the rest."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, low))


# --- hashing of whole texts with numpy ---------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; wraps as unsigned 64-bit."""
    h = h.copy()
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_NEAR = 64


def _byte_hash(key: np.ndarray) -> np.ndarray:
    """A number for a byte at a place, key = place * 256 + byte."""
    return mix((key.astype(np.uint64) + U64(1)) * U64(_PRIME))


#: those of the first places
_BYTE_HASH = _byte_hash(np.arange(_NEAR << 8))


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Consecutive index ranges of about ``limit`` bytes; a longer text makes a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lower-cased texts, and each text's first word's index (one more at the end).

    A word's hash is the sum of numbers that its bytes have at their places, each mixed by itself; so no pattern of letters cancels out, as it does in
    sums of powers of one base.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~_SPACE[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.searchsorted(starts, offsets)
    size = ends - starts
    first = np.cumsum(size) - size
    key = (np.arange(size.sum(), dtype=np.int64) - np.repeat(first, size)) << 8
    far = np.flatnonzero(key >= _NEAR << 8)
    key |= _LOWER[buf[word]]
    value = _BYTE_HASH.take(key, mode="clip")
    value[far] = _byte_hash(key[far])
    h = np.add.reduceat(value, first)
    return mix(h + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], n: int = 5):
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence is one; without words none."""
    for a, b in chunks(texts):
        h, first = word_hashes(texts[a:b])
        s = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            s = s * U64(0xA0761D6478BD642F) + h[k : k + len(s)]
        s = mix(s)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                x = np.sort(s[lo : hi - n + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif hi > lo:
                v = int(hi - lo)
                for w in h[lo:hi].tolist():
                    v = (v * 0xE7037ED1A0B428DB + w) & 0xFFFFFFFFFFFFFFFF
                yield mix(np.array([v], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def as_bytes(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


# --- connected components ----------------------------------------------------------------------------------


class Forest:
    """Union-find on the rows of one task; batches of edges are joined by repeated minimum labels."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                return
            hi, lo = np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ]
            np.minimum.at(root, hi, lo)
            while (up := root[root]).tobytes() != root.tobytes():
                root[:] = up


#: minima of so many nodes are broadcast, which saves a round of components its two shuffled joins
BROADCAST_NODES = 100_000
#: and a task of a round takes so many rows or more
ROWS_A_TASK, LEAST_TASKS = 20_000, 8


def _in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more tasks than those need: a round of a small graph has little to do in any of hundreds."""
    return df.coalesce(max(LEAST_TASKS, rows // ROWS_A_TASK + 1))


def _not_stars(edges: DataFrame, rows: int) -> tuple[int, int]:
    """How many nodes keep the edges (u, v), u > v, from being stars about their smallest nodes: those with two such v, or with one and in the place of another's. And how many nodes there are."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
    return tuple(_in_tasks(nodes, rows).agg(F.count_if(F.expr("n > 1 or n > 0 and root > 0")), F.count("*")).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find over edges between long ids: rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps until all components are stars; each is a minimum per node, combined before the shuffle, and an
    equi-join back on the node, so no node's neighbours are gathered in one task; the minima of up to ``BROADCAST_NODES`` nodes are broadcast
    for that, beyond it both sides are shuffled. Each round is written to the shared folder. Null ids and loops are ignored; without edges the result is empty.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    cur, path = written(e, "edges")
    n = cur.count()
    while (left := _not_stars(cur, n))[0]:
        n = left[1]
        minima = (lambda df: F.broadcast(_in_tasks(df, n))) if n <= BROADCAST_NODES else lambda df: df
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(minima(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(minima(low2), "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        nxt, nxt_path = written(_in_tasks(small, n), "edges")
        drop_path(spark, path.rsplit("/", 1)[0])
        cur, path = nxt, nxt_path
    # every edge now points from a node to its component's smallest node
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(_in_tasks(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), n))
