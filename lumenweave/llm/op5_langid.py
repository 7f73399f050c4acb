"""Language identification by prediction by partial matching (PPM) over bytes.

For every language a variable-order context tree counts which byte follows the last 0 to 3 bytes. Its frozen statistics give
each byte a code length: a context that has seen a byte c times of n, with q distinct bytes, gives it c / (n + q); it
escapes with q / (n + q) to the next shorter context, whose distribution is renormalised over the bytes not yet seen
(exclusion), down to a uniform one over all bytes. A text's language is the one whose tree gives the whole text the
shortest code.

The trees are compiled to hash tables that hold the code lengths of every gram that some language has seen and the cost of every context's escape; no
context is left out. Scoring a byte is a look-up, or for a gram that no language has seen a few, done with numpy for a chunk of texts at once.

Training uses at most about ``TRAIN_DOCS`` documents of each language, chosen by a hash of the id among the labelled
ones of the training fold; the tables grow with their distinct grams only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, read_table, small_batches

TRAIN_DOCS = 2000
MAX_LANGS = 10_000
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the categories Lu, Ll, Lt, Lm or Lo is there; other numerals than digits, which regular expressions take for letters, are none."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of about ``per_language`` documents of each language, outside the held-out fold."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    sizes = d.groupBy("lang").agg(F.count("*").alias("n"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # a few rows, one a language; texts are not shuffled
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_LANGS else sizes
    return d.join(sizes, "lang").where(dice * F.col("n") < per_language).select("lang", "text")


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): gram packs a byte and the three before it, zeros before the text's first."""

    def grams(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = as_bytes(batch.column(1).to_pylist())
            for lang in dict.fromkeys(langs):
                mine = [t for t, x in zip(texts, langs) if x == lang]
                for a, b in chunks(mine, 1 << 22):
                    buf = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(mine[a:b]), np.uint8).astype(np.uint32)
                    if len(buf) < 4:
                        continue
                    g = buf[:-3] << 24 | buf[1:-2] << 16 | buf[2:-1] << 8 | buf[3:]
                    g, n = np.unique(g[buf[3:] > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return rows.mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Grams:
    """Rows of numbers by positive 32-bit key: open addressing, looked up for a whole array of keys at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows, self.mask = rows, (1 << max(4, int(4 * len(keys)).bit_length())) - 1
        self.key, self.row = np.zeros(self.mask + 1, np.uint32), np.zeros(self.mask + 1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.key[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.row[at[won]] = keys[todo[won]], todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(7)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for one that is not there."""
        at = self._slot(keys)
        there = self.key[at]
        out = np.where((there == keys) & (keys != 0), self.row[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            there = self.key[at]
            hit = there == keys[left]
            out[left[hit]] = self.row[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], at[go]
        return out


class Model:
    """Frozen statistics: code lengths in bits of every gram that some language has seen, and of every context's escape.

    ``one`` holds those of all pairs of a byte and the one before it. A gram of a higher order that no language has seen costs its context's escape
    plus what its suffix costs.
    """

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, k = langs, max(1, len(langs))
        grams = [(g.astype(np.uint32), n.astype(np.float64)) for g, n in grams]
        p1 = np.full((k, 65536), 1 / 256)
        for i, (g, n) in enumerate(grams):
            p0 = self._mix(np.bincount(g & 255, n, 256)[None], np.full((1, 256), 1 / 256))
            p1[i] = self._mix(np.bincount(g & 65535, n, 65536).reshape(256, 256), np.tile(p0, (256, 1))).ravel()
        self.one = -np.log2(p1.T).astype(np.float32)
        self.tables = []
        lower = lambda i, keys: p1[i][keys & 65535]
        for order in (2, 3):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            every = np.unique(np.concatenate([g & mask for g, _ in grams] or [np.zeros(0, np.uint32)]))
            ctx, of = np.unique(every >> np.uint32(8), return_inverse=True)
            p, escape = np.ones((k, len(every))), np.ones((k, len(ctx)))
            for i, (g, n) in enumerate(grams):
                count = np.bincount(np.searchsorted(every, g & mask), n, len(every))
                seen = count > 0
                total, kinds = np.bincount(of, count, len(ctx)), np.bincount(of, seen, len(ctx))
                below = lower(i, every)
                # what the shorter context leaves to the bytes not seen here; none if all have been
                mass = np.where(kinds == 256, 0, np.maximum(1 - np.bincount(of, below * seen, len(ctx)), 1e-12))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out = np.where(mass > 0, kinds / (total + kinds) / mass, 1.0)
                    hit = count / (total + np.where(mass > 0, kinds, 0))[of]
                escape[i] = np.where(total > 0, out, 1.0)
                p[i] = np.where(seen, hit, escape[i][of] * below)
            found = Grams(every, -np.log2(p.T).astype(np.float32))
            # contexts begin with the empty bytes before a text, so their keys are raised by one
            self.tables.append((mask, found, Grams(ctx + np.uint32(1), -np.log2(escape.T).astype(np.float32))))
            lower = lambda i, keys, p=p, found=found, mask=mask: p[i][found.find(keys & mask)]

    @staticmethod
    def _mix(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """One PPM step on dense rows: counts over the escape to ``lower``, which keeps the unseen bytes only."""
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        rest = np.where(count > 0, 0, lower)
        mass = rest.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(mass > 0, count / (total + kinds), count / total) + np.where(mass > 0, kinds / (total + kinds) * rest / mass, 0)
        return np.where(total > 0, p, lower)

    @property
    def size(self) -> int:
        """Bytes of the tables."""
        return self.one.nbytes + sum(x.nbytes for _, *pair in self.tables for t in pair for x in (t.key, t.row, t.rows))

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths [gram, language] of the last byte of each gram after its first three."""
        out = np.empty((len(grams), self.one.shape[1]), np.float32)
        todo, due = np.arange(len(grams)), None  # due: what has been paid for escapes so far
        for mask, found, escapes in reversed(self.tables):
            g = grams[todo] & mask
            row = found.find(g)
            hit = row >= 0
            out[todo[hit]] = found.rows[row[hit]] if due is None else found.rows[row[hit]] + due[hit]
            miss = ~hit
            todo, g = todo[miss], g[miss]
            row = escapes.find((g >> np.uint32(8)) + np.uint32(1))
            paid = np.where((row >= 0)[:, None], escapes.rows[row] if len(escapes.rows) else 0, 0)
            due = paid if due is None else due[miss] + paid
        out[todo] = self.one[grams[todo] & 65535] + due
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits [text, language]."""
        out = np.zeros((len(texts), self.one.shape[1]))
        for a, b in chunks(texts, 1 << 18):
            size = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            buf = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(texts[a:b]) + b"\0", np.uint8).astype(np.uint32)
            total, start = np.zeros(out.shape[1]), np.cumsum(size + 3) - size - 3
            if b - a == 1:  # a text of any length, part by part
                for s in range(0, int(size[0]), 1 << 18):
                    total += self._bits(self._grams(buf[s : s + (1 << 18) + 3 if s + (1 << 18) < size[0] else size[0] + 3])).sum(0, dtype=np.float64)
                out[a] = total
                continue
            bits = self._bits(self._grams(buf))
            full = np.flatnonzero(size)
            if len(full):
                ends = np.stack((start[full], start[full] + size[full]), 1).ravel()
                out[a + full] = np.add.reduceat(bits, ends, axis=0, dtype=np.float64)[::2]
        return out

    @staticmethod
    def _grams(buf: np.ndarray) -> np.ndarray:
        return buf[:-3] << np.uint32(24) | buf[1:-2] << np.uint32(16) | buf[2:-1] << np.uint32(8) | buf[3:]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score, the posterior of equal priors; und with 0 for no text, no letter or no language learned. Ties: the first language."""
        known = [bool(self.langs) and t is not None and has_letter(t) for t in texts]
        bits = self.lengths([x if k else b"" for x, k in zip(as_bytes(texts), known)])
        best = bits.argmin(1)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        return [self.langs[i] if k else "und" for i, k in zip(best, known)], np.where(known, score, 0.0).tolist()


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """The counts that reach the driver are those of a bounded number of documents."""
    got = count_grams(training_rows(docs, per_language)).toArrow()
    lang = np.array(got.column("lang").to_pylist(), object)
    gram, n = np.asarray(got.column("gram"), np.int64), np.asarray(got.column("n"), np.int64)
    langs = sorted(set(lang.tolist()))
    return Model(langs, [(gram[lang == x], n[lang == x]) for x in langs])


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is an input.

    Null text, or text without a letter, is ``und`` with score 0; a null doc_id is not held out. Empty input gives an
    empty result; extra columns are ignored; repeated rows are predicted each.
    """
    small_batches(docs.sparkSession)
    b = docs.sparkSession.sparkContext.broadcast(model)  # grows with the distinct grams of the bounded training sample

    def rows(batches):
        for batch in batches:
            lang, score = b.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(rows, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict_languages(docs, train(docs))
