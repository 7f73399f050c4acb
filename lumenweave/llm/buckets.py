"""Candidate pairs from signatures: rows that share a 64-bit signature meet, packed as binary blobs.

A task packs its signatures by ``part`` (a share of the signature space), so that the shuffle moves a few large rows in
place of one row for each signature. A part holds about ``PART_DOCS`` documents' worth of signatures whatever the input.

Within a bucket (the ids under one signature) of up to ``cold`` ids all pairs are candidates. A larger bucket is *hot*: each id pairs with
the bucket's smallest only, and every id is told how many hot buckets it is in. A task sends one id only for a signature
that is hot among its own rows, so a bucket never gathers more ids than there are tasks' flushes times ``cold``.
With ``members`` the hot buckets' own ids are told in place of those counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions

PART_DOCS = 2000
FLUSH = 1 << 19
BLOB = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
BLOB_DDL = "part bigint, kind int, keys binary, ids binary"
PAIR_DDL = "kind int, a bigint, b bigint, n bigint"
COLD_PAIR, STAR_PAIR, HOT = 0, 1, 2
MEMBER = 4  # a hot bucket and an id in it; 3 marks ids that stand for a task's hot buckets


def parts_for(docs: DataFrame) -> int:
    return max(partitions(docs.sparkSession), docs.count() // PART_DOCS + 1)


def _groups(keys: np.ndarray, ids: np.ndarray):
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    # only ids that share a key have an order of their own
    tie = np.zeros(len(keys) + 1, bool)
    tie[1:-1] = keys[1:] == keys[:-1]
    tied = np.flatnonzero(tie[1:] | tie[:-1])
    ids[tied] = ids[tied][np.lexsort((ids[tied], keys[tied]))]
    if len(keys):
        keep = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        keys, ids = keys[keep], ids[keep]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys, ids, start, np.diff(np.append(start, len(keys)))


def _counted(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if not len(a):
        return a, b, a
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.diff(np.append(first, len(a)))


def _star(ids: np.ndarray, start: np.ndarray, size: np.ndarray, hot: np.ndarray):
    """(smallest, other) pairs of hot buckets."""
    many = size[hot]
    rep = np.repeat(ids[start[hot]], many)
    every = ids[np.repeat(start[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    other = every != rep
    return rep[other], every[other], every


def pair_hash(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(keys * np.uint64(0x9E3779B97F4A7C15) + mix(ids.astype(np.uint64)))


class Packer:
    def __init__(self, parts: int, cold: int, members: bool = False):
        self.parts, self.cold, self.members, self.keys, self.ids, self.n = parts, cold, members, [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray):
        self.keys.append(keys)
        self.ids.append(ids)
        self.n += len(keys)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        keys, ids, start, size = _groups(np.concatenate(self.keys), np.concatenate(self.ids))
        self.keys, self.ids, self.n = [], [], 0
        rows = []
        hot = np.flatnonzero(size > self.cold)
        if len(hot):
            a, b, every = _star(ids, start, size, hot)
            a, b, n = _counted([a], [b])
            rows.append((int(keys[0] % np.uint64(self.parts)), STAR_PAIR, np.stack((a, b)).tobytes(), n.tobytes()))
            if self.members:
                rows.append((int(keys[0] % np.uint64(self.parts)), MEMBER, np.repeat(keys[start[hot]] >> np.uint64(24), size[hot]).tobytes(), every.tobytes()))
            else:
                who, n = np.unique(every, return_counts=True)
                rows.append((int(keys[0] % np.uint64(self.parts)), HOT, who.tobytes(), n.astype(np.int64).tobytes()))
            keep = np.ones(len(keys), bool)
            keep[np.repeat(start[hot], size[hot] - 1) + np.arange((size[hot] - 1).sum()) - np.repeat(np.cumsum(size[hot] - 1) - (size[hot] - 1), size[hot] - 1) + 1] = False
            mark = np.zeros(len(keys), bool)
            mark[start[hot]] = True
            keys, ids, mark = keys[keep], ids[keep], mark[keep]
        else:
            mark = np.zeros(len(keys), bool)
        part = (keys % np.uint64(self.parts)).astype(np.int64)
        for kind, on in ((COLD_PAIR, ~mark), (3, mark)):
            p, k, i = part[on], keys[on], ids[on]
            # stable sorts of 16 bits go by digits
            order = np.argsort(p.astype(np.uint16) if self.parts <= 1 << 16 else p, kind="stable")
            p, k, i = p[order], k[order], i[order]
            cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
            # 40 bits within a part tell signatures apart well enough: a clash only adds a candidate
            for a, b in zip(cut, [*cut[1:], len(p)]):
                rows.append((int(p[a]), kind, (k[a:b] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), i[a:b].astype("<i8").tobytes()))
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 256]), BLOB.types)], schema=BLOB)


def candidate_pairs(blobs: DataFrame, cold: int, members: bool = False) -> DataFrame:
    """From packed signatures: rows (kind, a, b, n): COLD_PAIR and STAR_PAIR (a < b share n buckets of this part), HOT (a is in n hot buckets).

    With ``members``, as in the Packer, in place of HOT: MEMBER (hot bucket a holds b), rows that may repeat. Buckets are named by 40 bits.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, ids, marks, out = [], [], [], []
        extra = []
        for kind, k, i in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "ids"))):
            if kind in (COLD_PAIR, 3):
                five = np.frombuffer(k, np.uint8).reshape(-1, 5)
                wide = np.zeros((len(five), 8), np.uint8)
                wide[:, :5] = five
                keys.append(wide.view("<u8").ravel().astype(np.uint64))
                ids.append(np.frombuffer(i, "<i8").astype(np.int64))
                marks.append(np.full(len(five), kind == 3))
            elif kind == STAR_PAIR:
                a, b = np.frombuffer(k, np.int64).reshape(2, -1)
                extra.append((STAR_PAIR, a, b, np.frombuffer(i, np.int64)))
            elif kind == MEMBER:
                who = np.frombuffer(i, np.int64)
                extra.append((MEMBER, np.frombuffer(k, np.int64), who, np.ones(len(who), np.int64)))
            else:
                who = np.frombuffer(k, np.int64)
                extra.append((HOT, who, np.zeros(len(who), np.int64), np.frombuffer(i, np.int64)))
        if keys:
            raw_k, raw_i, raw_m = np.concatenate(keys), np.concatenate(ids), np.concatenate(marks)
            del keys, ids, marks
            hot_keys = np.unique(raw_k[raw_m])
            k, i, start, size = _groups(raw_k, raw_i)
            # ids that a task has already told of their hot bucket are not told again
            is_hot = (size > cold) | np.isin(k[start], hot_keys)
            hot = np.flatnonzero(is_hot & (size > 1))
            if len(hot):
                a, b, every = _star(i, start, size, hot)
                a, b, n = _counted([a], [b])
                extra.append((STAR_PAIR, a, b, n))
            hot = np.flatnonzero(is_hot)
            if len(hot):
                _, _, every = _star(i, start, size, hot)
                every_key = np.repeat(k[start[hot]], size[hot])
                if members:
                    extra.append((MEMBER, every_key.astype(np.int64), every, np.ones(len(every), np.int64)))
                else:
                    if len(hot_keys):
                        told = pair_hash(raw_k[raw_m], raw_i[raw_m])
                        every = every[~np.isin(pair_hash(every_key, every), told)]
                    who, n = np.unique(every, return_counts=True)
                    extra.append((HOT, who, np.zeros(len(who), np.int64), n))
            left, right = [], []
            for s in range(2, cold + 1):
                at = start[(size == s) & ~is_hot]
                for x in range(s):
                    for y in range(x + 1, s):
                        left.append(i[at + x])
                        right.append(i[at + y])
            a, b, n = _counted(left, right)
            extra.append((COLD_PAIR, a, b, n))
        for kind, a, b, n in extra:
            out.append(pa.table([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.asarray(n, np.int64))], names=["kind", "a", "b", "n"]))
        empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["kind", "a", "b", "n"])
        return pa.concat_tables([empty, *out])

    return blobs.groupBy("part").applyInArrow(run, PAIR_DDL)


BROADCAST_IDS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast while its rows are few; it is counted for that, so it had better be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def restricted(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is among the distinct ids of ``ids``: by broadcast while those are few (8 MB), else by a shuffled semi join."""
    return df.join(few(ids.select(F.col(ids.columns[0]).alias(col)).distinct()), col, "left_semi")
