"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of
all vote patterns in the corpus (a bounded table, whatever the number of documents) estimates each labeller's accuracies
without any true label, and with them a posterior for each pattern. The posteriors label a bounded sample of documents
(``TRAIN_DOCS``, chosen by a hash of the id) that trains a logistic scorer on hashed features: byte trigrams and
bucketed statistics of the whole text. The scorer rates every document; it is rejected below ``THRESHOLD``.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, read_table, release_memory, small_batches, unused, word_hashes

TRAIN_DOCS = 6000
BITS = 16  # at most 16, as features are stored in two bytes
FIT_BLOCK = 500
THRESHOLD = 0.5
SHRINK = 200  # bytes of weight 0 added to each text, so that a short one is judged by its statistics
STATS = ("upper", "symbol", "digit", "unique", "stop", "pipe", "mean_word", "line_unique", "tail")
#: labellers that vote bad or abstain: statistic, bad if below, bad if above
DEFECTS = {
    "shouting": ("upper", None, 0.4),
    "symbols": ("symbol", None, 0.15),
    "digits": ("digit", None, 0.5),
    "repeats": ("unique", 0.35, None),
    "menus": ("pipe", None, 0.2),
    "word_length": ("mean_word", 2.0, 14.0),
    "repeated_lines": ("line_unique", 0.4, None),
    "decorated": ("tail", None, 0.3),
}
#: labellers that vote good if all their statistics lie in their ranges, bad if one is beyond twice the range, else abstain
MERITS = {
    "prose": {"upper": (0.0, 0.15), "symbol": (0.0, 0.05), "pipe": (0.0, 0.01), "tail": (0.0, 0.05), "mean_word": (2.5, 10.0)},
    "varied": {"unique": (0.55, 1.0), "line_unique": (0.6, 1.0), "symbol": (0.0, 0.06), "pipe": (0.0, 0.02)},
    "plain": {"upper": (0.0, 0.2), "unique": (0.5, 1.0), "tail": (0.0, 0.1), "pipe": (0.0, 0.05)},
}
LABELLERS = (*DEFECTS, *MERITS)

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 symbol, 0 space
_KIND[33:127] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 1, 2, 2


def statistics(texts: list[bytes]) -> np.ndarray:
    """[text, statistic] over whole texts; zeros for a text without words."""
    out = np.zeros((len(texts), len(STATS)))
    for a, b in chunks(texts):
        part = texts[a:b]
        size = np.fromiter(map(len, part), np.int64, b - a)
        joined = b"\n".join(part) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        kind = _KIND[buf]
        offset = np.concatenate(([0], np.cumsum(size + 1)))
        count = lambda on, of=offset: np.diff(np.concatenate(([0], np.cumsum(on)))[of])
        upper, lower, digit, symbol = (count(kind == k) for k in (1, 2, 3, 4))
        plain = np.isin(buf, np.frombuffer(b".,;:'\"!?-()", np.uint8))
        h, first = word_hashes(part)
        words = np.diff(first)
        letters, marks = upper + lower, symbol - count(plain & (buf != 33))
        full = np.maximum(upper + lower + digit + symbol, 1)
        # a word that ends in a repeated mark, such as !! or ***
        double = np.zeros(len(buf), bool)
        double[2:] = (kind[2:] == 0) & (kind[1:-1] == 4) & (buf[1:-1] == buf[:-2])
        out[a:b, 0] = upper / np.maximum(letters, 1)
        out[a:b, 1] = marks / full
        out[a:b, 2] = digit / full
        for i in range(b - a):
            n = words[i]
            if n:
                x = np.sort(h[first[i] : first[i + 1]])
                # distinct words against the number expected of so many words of prose (Heaps' law)
                out[a + i, 3] = min(1.0, (1 + np.count_nonzero(x[1:] != x[:-1])) / min(n, 6 * n**0.72))
                lines = [y for y in part[i].split(b"\n") if len(y) > 1]
                out[a + i, 7] = len(set(lines)) / len(lines) if lines else 1.0
        some = np.maximum(words, 1)
        out[a:b, 4] = words / full
        out[a:b, 5] = count(buf == 124) / some
        out[a:b, 6] = full * (words > 0) / some
        out[a:b, 8] = count(double) / some
    return out


def vote(stats: np.ndarray) -> np.ndarray:
    """[text, labeller]: 1 good, 0 bad, -1 abstains."""
    out = np.full((len(stats), len(LABELLERS)), -1, np.int8)
    of = lambda name: stats[:, STATS.index(name)]
    for k, (name, low, high) in enumerate(DEFECTS.values()):
        out[((of(name) < low) if low is not None else False) | ((of(name) > high) if high is not None else False), k] = 0
    for k, ranges in enumerate(MERITS.values(), len(DEFECTS)):
        out[np.all([(of(n) >= a) & (of(n) <= b) for n, (a, b) in ranges.items()], axis=0), k] = 1
        out[np.any([(of(n) < a / 2) | (of(n) > 2 * b) for n, (a, b) in ranges.items()], axis=0), k] = 0
    out[stats[:, 6] == 0] = 0  # no words: every labeller says bad
    return out


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """EM for independent labellers given the class. ``patterns`` [pattern, labeller] of 1, 0, -1.

    Returns the posterior of good per pattern, and per labeller P(vote | class) [labeller, class, vote bad/good/abstain],
    started from labellers that are right more often than not, with one pseudo-count.
    """
    k = patterns.shape[1]
    hot = np.stack([patterns == 0, patterns == 1, patterns == -1], 2).astype(float)
    theta = np.tile(np.array([[0.5, 0.15, 0.35], [0.05, 0.7, 0.25]]), (k, 1, 1))
    for _ in range(rounds):
        like = np.einsum("pkv,kcv->pc", hot, np.log(theta)) + np.log([1 - prior, prior])
        post = np.exp(like - like.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * counts[:, None]
        theta = np.einsum("pc,pkv->kcv", mass, hot) + np.array([[0.5, 0.15, 0.35], [0.05, 0.7, 0.25]])
        theta /= theta.sum(2, keepdims=True)
        prior = (mass[:, 1].sum() + 9) / (mass.sum() + 10)
    return post[:, 1], theta


def buckets(stats: np.ndarray) -> np.ndarray:
    """Hashed features of each text's statistics: one bucket of 12 for each."""
    edges = {"mean_word": np.linspace(1, 16, 11)}
    cols = [np.searchsorted(edges.get(n, np.linspace(0.02, 0.98, 11)), stats[:, i]) + 12 * i for i, n in enumerate(STATS)]
    return np.stack(cols, 1)


def trigram_sums(texts: list[bytes], weights: np.ndarray | None, bits: int = BITS):
    """For each text the mean weight of its hashed byte trigrams, shrunk for short texts; without weights, (features, counts) of each."""
    mask = (1 << bits) - 1
    for a, b in chunks(texts, 1 << 19):
        size = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        buf = np.frombuffer(b" ".join(texts[a:b]) + b"   ", np.uint8).astype(np.uint32)
        f = ((buf[:-2] * np.uint32(0x9E3779B1) ^ buf[1:-1] * np.uint32(0x85EBCA77) ^ buf[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) & np.uint32(mask)
        start = np.cumsum(size + 1) - size - 1
        if weights is None:
            for s, n in zip(start.tolist(), size.tolist()):
                x, c = np.unique(f[s : s + n], return_counts=True)
                yield x, c / (n + SHRINK)
        else:
            total = np.concatenate(([0.0], np.cumsum(weights[f], dtype=np.float64)))
            yield from (total[start + size] - total[start]) / (size + SHRINK)


class Scorer:
    """Logistic regression on hashed features, trained on soft labels by full-batch gradient steps with momentum."""

    def __init__(self, bits: int = BITS):
        self.w, self.s, self.b = np.zeros(1 << bits), np.zeros(12 * len(STATS)), 0.0

    def fit(self, texts: list[bytes], stats: np.ndarray, labels: np.ndarray, steps: int = 60, rate: float = 2.0, decay: float = 1e-4) -> Scorer:
        if not len(texts):
            self.b = 1.0
            return self
        # 6 bytes a feature; the steps go over blocks of texts, so that they hold no more than a block's products
        cols, vals, n = [], [], []
        for x, c in trigram_sums(texts, None):
            cols.append(x.astype(np.uint16))
            vals.append((10 * c).astype(np.float32))
            n.append(len(x))
        blocks = []
        for a in range(0, len(n), FIT_BLOCK):
            b = min(a + FIT_BLOCK, len(n))
            blocks.append((a, b, np.repeat(np.arange(b - a, dtype=np.int16), n[a:b]), np.concatenate(cols[a:b]), np.concatenate(vals[a:b])))
            cols[a:b] = vals[a:b] = [None] * (b - a)
        cell = buckets(stats)
        share = max(1e-3, min(1 - 1e-3, float(labels.mean())))
        weight = np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share)).clip(0, 50)
        weight /= weight.sum()
        vw, vs, vb = np.zeros_like(self.w), np.zeros_like(self.s), 0.0
        for _ in range(steps):
            z = self.s[cell].sum(1) + self.b
            slope = np.zeros_like(self.w)
            g = np.zeros(len(texts))
            for a, b, row, col, val in blocks:
                z[a:b] += np.bincount(row, val * self.w[col], b - a)
                g[a:b] = (1 / (1 + np.exp(-z[a:b])) - labels[a:b]) * weight[a:b]
                slope += np.bincount(col, val * g[a:b][row], len(self.w))
            vw = 0.9 * vw + slope + decay * self.w
            vs = 0.9 * vs + np.bincount(cell.ravel(), np.repeat(g, cell.shape[1]), len(self.s)) + decay * self.s
            vb = 0.9 * vb + g.sum()
            self.w -= rate * vw
            self.s -= rate * vs
            self.b -= rate * vb
        return self

    def score(self, texts: list[bytes], stats: np.ndarray) -> np.ndarray:
        z = 10 * np.fromiter(trigram_sums(texts, self.w), np.float64, len(texts)) + self.s[buckets(stats)].sum(1) + self.b
        p = 1 / (1 + np.exp(-z))
        p[stats[:, 6] == 0] = 0.0
        return p


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, n) over all documents; a pattern packs one digit of base 3 for each labeller."""

    def rows(batches):
        for batch in batches:
            v = vote(statistics(as_bytes(batch.column(0).to_pylist())))
            code, n = np.unique((v + 1).astype(np.int64) @ 3 ** np.arange(v.shape[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    return docs.select("text").mapInArrow(rows, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = TRAIN_DOCS) -> tuple[dict[int, float], Scorer]:
    """Posteriors by pattern, from all documents, and the scorer, from a bounded sample."""
    k = len(LABELLERS)
    got = vote_patterns(docs).orderBy("pattern").collect()  # at most 3 ** k patterns
    codes = np.array([r.pattern for r in got], np.int64)
    votes = (codes[:, None] // 3 ** np.arange(k) % 3 - 1).astype(np.int8).reshape(len(codes), k)
    counts = np.array([r.n for r in got], float)
    post, _ = fit_label_model(votes, counts) if len(got) else (np.zeros(0), None)
    by = dict(zip(codes.tolist(), post.tolist(), strict=True))
    total = counts.sum()
    dice = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    few = docs.where(dice * float(total) < sample).select("doc_id", "text").orderBy("doc_id", "text").limit(2 * sample).toArrow()
    texts = as_bytes(few.column("text").to_pylist())
    del few
    stats = statistics(texts)
    codes = (vote(stats) + 1).astype(np.int64) @ 3 ** np.arange(k)
    labels = np.array([by.get(c, 0.5) for c in codes.tolist()])
    scorer = Scorer().fit(texts, stats, labels)
    del texts, stats, labels
    release_memory()
    return by, scorer


def score_documents(docs: DataFrame, model: tuple[dict[int, float], Scorer] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with good_votes, bad_votes (int), weak_label (posterior of good), quality_score and quality_kept.

    Null text counts as empty; a text without words scores 0 and is rejected. Repeated rows get equal scores. Empty
    input gives an empty result. Columns of the new names are replaced, all others are left as they are.
    """
    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

    kinds = {"good_votes": IntegerType(), "bad_votes": IntegerType(), "weak_label": DoubleType(), "quality_score": DoubleType(), "quality_kept": BooleanType()}
    small_batches(docs.sparkSession)
    model = model or train(docs)
    b = docs.sparkSession.sparkContext.broadcast(model)  # 3 ** labellers posteriors and 2 ** BITS weights at most
    keep = [c for c in docs.columns if c not in kinds]

    def rows(batches):
        by, scorer = b.value
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1).to_pylist())
            stats = statistics(texts)
            v = vote(stats)
            code = (v + 1).astype(np.int64) @ 3 ** np.arange(v.shape[1])
            p = scorer.score(texts, stats)
            new = [pa.array((v == 1).sum(1), pa.int32()), pa.array((v == 0).sum(1), pa.int32()), pa.array([by.get(c, 0.5) for c in code.tolist()], pa.float64()), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, *kinds])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, t) for c, t in kinds.items())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(unused(docs, "text_"))).mapInArrow(rows, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).drop("text")
