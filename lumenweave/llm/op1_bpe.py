"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words, counted over the whole corpus, are compiled with their id sequences into a minimal acyclic automaton with shared
suffixes. Numbers on its arcs sum to a word's rank, which points into one array of ids: the transducer's output. The
automaton lies in a double array (base, check, target, output) in one file that Spark ships to the executors, and
workers memory-map it. All words of a chunk walk it at once, one byte per step, with numpy. Words that it does not hold
are merged exactly by rank, all of a chunk at once, one merge per word and step.

The cutting of a text into words (the public byte-level BPE's pattern) is done on code point classes with numpy as well.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import unicodedata
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop_path, mix, new_path, read_table, release_memory, small_batches, unused, write_bytes, written

LEXICON_WORDS = 1 << 16
CHUNK = 1 << 19
LONG_WORD = 256


_NONE = np.int32(1 << 30)
_HASH = 0x9E3779B97F4A7C15


def _slot_of(pair: int, bits: int) -> int:
    return (pair * _HASH & (1 << 64) - 1) >> (64 - bits)


def _spread(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges offset[i] .. offset[i] + length[i]."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(offset - (total - length), length)


# --- the vocabulary ----------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        data, letter = json.loads(Path(path).read_text(encoding="utf-8")), byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        vocab = {k: i for k, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: raw(k) for k, i in vocab.items()} | {i: k.encode() for k, i in self.special.items()}
        self.byte_id = [0] * 256
        for k, i in vocab.items():
            if len(k) == 1:
                self.byte_id[letter[k]] = i
        self.merges = {}
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def merge(self, word: bytes) -> list[int]:
        """Joins the pair of least rank, the leftmost first, until none is left."""
        ids, merges = [self.byte_id[b] for b in word], self.merges
        if len(ids) > 48:
            return self._merge_long(ids)
        none = (1 << 30, 0)
        ranks = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], best[1]), none)
            if i < len(ranks):
                ranks[i] = merges.get((best[1], ids[i + 1]), none)
        return ids

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, ranks and results of the merges as an open hash table."""
        bits = max(4, (4 * len(self.merges)).bit_length())
        key, rank, new = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        for (a, b), (r, c) in self.merges.items():
            at = _slot_of(a << 32 | b, bits)
            while key[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            key[at], rank[at], new[at] = a << 32 | b, r, c
        return key, rank, new

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs (a, b) in the table, or of a free place; -1 in either counts as no pair."""
        key = self.table[0]
        want = a.astype(np.int64) << 32 | b.astype(np.int64)
        bits = len(key).bit_length() - 1
        at = ((want.astype(np.uint64) * np.uint64(_HASH)) >> np.uint64(64 - bits)).astype(np.int64)
        go = np.flatnonzero((key[at] != want) & (key[at] >= 0))
        while len(go):
            at[go] = (at[go] + 1) & (len(key) - 1)
            go = go[(key[at[go]] != want[go]) & (key[at[go]] >= 0)]
        return at

    def merge_many(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of the words buf[starts:ends], one merge per word in each step: all ids in a row and each word's number of ids."""
        if not hasattr(self, "table"):
            self.table = self._pairs()
        _, rank_of, new_of = self.table
        length = ends - starts
        ids = np.asarray(self.byte_id, np.int32)[buf[_spread(starts, length)]]
        lens = length.copy()
        who = np.arange(len(starts))
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # rank[i]: that of the pair that begins at i; a word's last id begins none
        first = np.cumsum(lens) - lens
        slot = self._lookup(ids, np.append(ids[1:], 0))
        slot[first + lens - 1] = -1
        rank = np.where(slot >= 0, rank_of[slot], _NONE)
        while len(who):
            low = np.minimum.reduceat(rank, first)
            over = low == _NONE
            if over.any():
                keep = np.repeat(~over, lens)
                results.append((who[over], lens[over], ids[~keep]))
                ids, rank, slot, who, lens, low = ids[keep], rank[keep], slot[keep], who[~over], lens[~over], low[~over]
                first = np.cumsum(lens) - lens
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            word = np.searchsorted(first, hit, "right") - 1
            at = hit[np.concatenate(([True], word[1:] != word[:-1]))]  # the leftmost of each word
            ids[at] = new_of[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            last = at + 2 == first + lens
            ids, rank, slot = ids[keep], rank[keep], slot[keep]
            at -= np.arange(len(at))
            lens = lens - 1
            first = np.cumsum(lens) - lens
            nxt = self._lookup(ids[at], ids[np.minimum(at + 1, len(ids) - 1)])
            slot[at] = np.where(last, -1, nxt)
            rank[at] = np.where(last, _NONE, rank_of[nxt])
            left = at[at > first] - 1
            prev = self._lookup(ids[left], ids[left + 1])
            slot[left], rank[left] = prev, rank_of[prev]
        out_len = np.zeros(len(starts), np.int64)
        for w, n, _ in results:
            out_len[w] = n
        out = np.zeros(int(out_len.sum()), np.int32)
        begin = np.cumsum(out_len) - out_len
        for w, n, x in results:
            out[_spread(begin[w], n)] = x
        return out, out_len

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = merges[p][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (q := (ids[a], ids[b])) in merges:
                    heapq.heappush(heap, (merges[q][0], a, q))
        return [x for x in ids if x >= 0]


# --- the automaton -----------------------------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs and final flags of the minimal acyclic automaton of sorted distinct words, and its start state."""
    arcs, final, register = [{}], [False], {}
    path, last = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            s = path.pop()
            key = (final[s], tuple(arcs[s].items()))
            arcs[path[-1]][last[len(path) - 1]] = register.setdefault(key, s)

    for w in words:
        common = len(os.path.commonprefix([last, w]))
        settle(common)
        last = w
        for b in w[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
    settle(0)
    return arcs, final, 0


class Lexicon:
    """Words with id sequences in one memory-mapped file. ``index`` gives each word's rank or -1."""

    NAMES = ("base", "final", "check", "target", "output", "offsets", "ids")

    def __init__(self, path: str):
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = json.loads(view[: view.find(b"\n")])
        for name in self.NAMES:
            at, n = head[name]
            setattr(self, name, np.frombuffer(view, np.int32, n, at))

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        order = sorted(words)
        arcs, final, _ = minimal_automaton(order)
        live, seen = [0], {0}
        for s in live:
            for t in arcs[s].values():
                if t not in seen:
                    seen.add(t)
                    live.append(t)
        number = {s: i for i, s in enumerate(live)}
        count = [0] * len(live)
        for s in cls._post_order(arcs):
            count[number[s]] = final[s] + sum(count[number[t]] for t in arcs[s].values())
        size = 2 * sum(len(arcs[s]) for s in live) + 1024
        check, target, output = (np.full(size, v, np.int32) for v in (-1, 0, 0))
        base, used, low, top = np.zeros(len(live), np.int32), bytearray(size), 256, 0
        for s in sorted(live, key=lambda s: -len(arcs[s])):
            if not arcs[s]:
                continue
            labels = sorted(arcs[s])
            while used[low]:
                low += 1
            at = max(low, top - 48) if len(labels) > 1 else low  # single arcs fill the holes
            while at < labels[0] or any(used[at - labels[0] + b] for b in labels):
                at += 1
                if at + 512 > len(used):
                    used.extend(bytes(len(used)))
                    check, target, output = (np.concatenate((x, np.full(len(x), v, np.int32))) for x, v in ((check, -1), (target, 0), (output, 0)))
            n, out = number[s], int(final[s])
            base[n] = at - labels[0]
            for b in labels:
                slot, t = base[n] + b, number[arcs[s][b]]
                used[slot], check[slot], target[slot], output[slot] = 1, n, t, out
                top = max(top, slot)
                out += count[t]
        flat = [words[w] for w in order]
        parts = dict(zip(cls.NAMES, (base, np.array([final[s] for s in live]), check, target, output, np.cumsum([0, *map(len, flat)]), [i for x in flat for i in x]), strict=True))
        parts = {k: np.asarray(v, np.int32).tobytes() for k, v in parts.items()}
        at, head = 4096, {}
        for k, v in parts.items():
            head[k] = (at, len(v) // 4)
            at += len(v)
        return (json.dumps(head) + "\n").encode().ljust(4096) + b"".join(parts.values())

    @staticmethod
    def _post_order(arcs: list[dict[int, int]]) -> list[int]:
        out, done, stack = [], set(), [(0, False)]
        while stack:
            s, left = stack.pop()
            if left:
                out.append(s)
            elif s not in done:
                done.add(s)
                stack.append((s, True))
                stack += [(t, False) for t in arcs[s].values() if t not in done]
        return out

    def index(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ranks of the words buf[starts:ends]; all take a step at once."""
        out = np.full(len(starts), -1, np.int32)
        who, at, stop = np.arange(len(starts)), starts.copy(), ends
        state, rank = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        while len(who):
            slot = self.base[state] + buf[at]
            ok = self.check[np.minimum(slot, len(self.check) - 1)] == state
            if not ok.all():
                who, at, stop, slot, rank = who[ok], at[ok], stop[ok], slot[ok], rank[ok]
            state, rank, at = self.target[slot], rank + self.output[slot], at + 1
            over = at == stop
            if over.any():
                good = over & (self.final[state] > 0)
                out[who[good]] = rank[good]
                go = ~over
                who, at, stop, state, rank = who[go], at[go], stop[go], state[go], rank[go]
        return out


# --- cutting texts into words ------------------------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)
#: fixed values: the code points that \s stands for in the public pattern
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[_SPACES] = _SPACE
    return t


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, words' starts and ends in them, and each text's first word's index (one more at the end).

    The pattern: 's 't 're 've 'm 'll 'd | ?letters | ?numbers | ?others | spaces not before a non-space | spaces.
    """
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.cumsum(sizes + 1) - 1
    kind = _classes()[code]
    kind[breaks] = _BREAK
    n = len(code)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[breaks] = start[breaks + 1] = True
    space = kind == _SPACE
    # the last of a run of spaces before a word goes with the word if it is U+0020, and stands alone otherwise
    run = np.flatnonzero(start[1:n] & space[:-1] & (kind[1:] != _BREAK)) + 1
    start[run - 1] = True
    start[run[code[run - 1] == 32]] = False
    quote = np.flatnonzero((code[:-2] == 39) & (kind[1:-1] == _LETTER) & start[:-3]) if n > 2 else np.zeros(0, np.int64)
    if len(quote):
        one, two = code[quote + 1], code[np.minimum(quote + 2, n - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        end = quote + 1 + size
        start[end[kind[end] == _LETTER]] = True
    where = np.flatnonzero(start[:n])
    width = np.ones(n, np.uint8)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        width += code > limit
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    first = np.searchsorted(where, breaks)  # a break is a word of its own so far
    word = np.ones(len(where), bool)
    word[first] = False
    bounds = offset[np.append(where, n)]
    index = np.concatenate(([0], first - np.arange(len(first))))
    return np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8), bounds[:-1][word], bounds[1:][word], index


class Codec:
    """Encodes and decodes; the words that the lexicon lacks are merged by rank, a chunk's at once."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lex = vocabulary, lexicon
        n = max(vocabulary.token) + 1
        tokens = [vocabulary.token.get(i, b"") for i in range(n)]
        self.t_len = np.fromiter(map(len, tokens), np.int64, n)
        self.t_off = np.cumsum(self.t_len) - self.t_len
        self.t_buf = np.frombuffer(b"".join(tokens), np.uint8)
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and, per text, where its ids end."""
        buf, starts, ends, index = cut(texts)
        rank = self.lex.index(buf, starts, ends)
        offs, ids = self.lex.offsets.astype(np.int64), self.lex.ids
        miss = np.flatnonzero(rank < 0)
        length = offs[rank + 1] - offs[rank] if len(offs) > 1 else np.zeros(len(rank), np.int64)
        offset = offs[np.maximum(rank, 0)]
        if len(miss):
            wide = ends[miss] - starts[miss] > LONG_WORD
            short, long = miss[~wide], miss[wide]
            new, n = self.v.merge_many(buf, starts[short], ends[short])
            offset[short], length[short] = len(ids) + np.cumsum(n) - n, n
            flat = [self.v.merge(buf[a:b].tobytes()) for a, b in zip(starts[long], ends[long])]
            n_long = np.array([len(x) for x in flat], np.int64)
            offset[long], length[long] = len(ids) + len(new) + np.cumsum(n_long) - n_long, n_long
            ids = np.concatenate((ids, new, np.array([i for x in flat for i in x], np.int32)))
        total = np.concatenate(([0], np.cumsum(length)))
        return ids[_spread(offset, length)], total[index]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in chunks(texts, CHUNK):
            pieces, found, first = [], [], []
            for t in texts[a:b]:
                first.append(len(pieces))
                more, special = self._split(t)
                pieces += more
                found += [*special, None]
            ids, ends = self._plain(pieces)
            parts = [ids[ends[i] : ends[i + 1]] for i in range(len(pieces))]
            for i, j in zip(first, [*first[1:], len(pieces)]):
                if j == i + 1:
                    out.append(parts[i])
                else:
                    out.append(np.concatenate([x for k in range(i, j) for x in (parts[k], np.array([] if found[k] is None else [found[k]], np.int32))]))
        return out

    def _split(self, text: str) -> tuple[list[str], list[int]]:
        """Plain pieces of a text and the ids of the special tokens between them."""
        pieces, found, at = [], [], 0
        for hit in self.special.finditer(text) if self.special else ():
            pieces.append(text[at : hit.start()])
            found.append(self.v.special[hit.group()])
            at = hit.end()
        return [*pieces, text[at:]], found

    def decode(self, ids: np.ndarray) -> str:
        return self.t_buf[_spread(self.t_off[ids], self.t_len[ids])].tobytes().decode("utf-8", "replace")

    def decode_many(self, many: list[np.ndarray]) -> list[str]:
        ids = np.concatenate([*many, np.zeros(0, np.int32)]).astype(np.int64)
        length = self.t_len[ids]
        raw = self.t_buf[_spread(self.t_off[ids], length)].tobytes()
        total = np.concatenate(([0], np.cumsum(length)))
        ends = total[np.concatenate(([0], np.cumsum([len(x) for x in many]))).astype(np.int64)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


# --- on tables ---------------------------------------------------------------------------------------------


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts of the single column; a task adds up its words before they are shuffled."""

    def rows(batches):
        counts: dict[bytes, int] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            part = _texts(batch.column(0))
            for a, b in chunks(part, CHUNK):
                buf, starts, ends, _ = cut(part[a:b])
                if not len(starts):
                    continue
                width = ends - starts
                h = np.zeros(len(starts), np.uint64)
                # words of a chunk are told apart by a hash here: this only counts, the lexicon holds the words themselves
                for k in range(min(24, int(width.max()))):
                    on = np.flatnonzero(width > k)
                    h[on] = h[on] * np.uint64(0x100000001B3) + buf[starts[on] + k] + np.uint64(1)
                _, at, n = np.unique(mix(h[width <= 24]), return_index=True, return_counts=True)
                short, raw = np.flatnonzero(width <= 24)[at], buf.tobytes()
                for i, j, c in zip(starts[short].tolist(), ends[short].tolist(), n.tolist()):
                    w = raw[i:j]
                    counts[w] = counts.get(w, 0) + c
                if len(counts) > 150_000:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(rows, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, size: int) -> list:
    """Rows (word, n) of the most frequent words: at most ``size``, whole classes of frequency.

    A histogram of a bounded number of classes finds the cut, so that only the words above it reach the driver.
    """
    counts, path = written(word_counts(texts).where("n > 1"), "words")
    counts = counts.withColumn("class", F.floor(F.log2("n") * 32))
    cut, total = None, 0
    for r in counts.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():  # at most 32 * 63 rows
        total += r.words
        if total > size:
            break
        cut = r["class"]
    top = counts.where(F.col("class") >= cut).select("word", "n").collect() if cut is not None else []
    drop_path(texts.sparkSession, path)
    return top


def build_lexicon(texts: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> str:
    """Compiles up to ``size`` of the most frequent words of all texts and ships the file to the executors; its name for SparkFiles."""
    v = Vocabulary(vocabulary)
    top = frequent_words(texts, size)
    spark, raw = texts.sparkSession, Lexicon.compile({bytes(r.word): v.merge(bytes(r.word)) for r in top})
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:24]}-{uuid.uuid4().hex[:8]}"
    path = new_path(spark, name)
    write_bytes(spark, path, raw)
    # Spark hands this file to every executor, also to one that replaces a lost one
    spark.sparkContext.addFile(path)
    del top, raw, v
    release_memory()
    return name


@lru_cache(2)
def _codec(vocabulary: str, name: str) -> Codec:
    return Codec(Vocabulary(vocabulary), Lexicon(SparkFiles.get(name)))


def _vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, lexicon: str | None = None, words: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """``docs`` with column ``ids`` (array of int), the text's tokens; with ``digests`` n_tokens, ids_sha256 and decoded_sha256 instead.

    ``vocabulary`` is the path of a byte-level BPE file, the same on all machines. Null text counts as empty and has no ids;
    the file's special tokens in a text become their ids. A text of any length is processed whole. Rows, order of columns and
    other columns are left as they are, except that columns of the new names are replaced. Empty input gives an empty result.
    """
    path = _vocabulary_path(vocabulary)
    small_batches(docs.sparkSession)
    name = lexicon or build_lexicon(docs.select(text_col), path, words)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
    keep = [c for c in docs.columns if c not in new]
    carried = keep if not digests else [c for c in keep if c != text_col]
    src = docs.select(*[F.col(f"`{c}`").alias(c) for c in carried], F.col(f"`{text_col}`").alias(unused(docs, "text_")))

    def rows(batches):
        codec = _codec(path, name)
        for batch in batches:
            texts = _texts(batch.column(batch.num_columns - 1))
            for a, b in chunks(texts, CHUNK):
                ids = codec.encode(texts[a:b])
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                if digests:
                    cols.append(pa.array([len(x) for x in ids], pa.int64()))
                    cols.append(pa.array([hashlib.sha256(np.ascontiguousarray(x, "<u4")).hexdigest() for x in ids], pa.string()))
                    cols.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in codec.decode_many(ids)], pa.string()))
                else:
                    cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [*carried, *new])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    kinds = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType(), "ids": ArrayType(IntegerType())}
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in carried), *(StructField(c, kinds[c]) for c in new)])
    return src.mapInArrow(rows, schema)


def decode_ids(tokens: DataFrame, ids_col: str = "ids", out_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``tokens`` with ``out_col``, the text of ``ids_col``. Null ids give null; ids outside the vocabulary fail; broken UTF-8 becomes U+FFFD."""
    path = _vocabulary_path(vocabulary)

    def rows(batches):
        v = Vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else b"".join(v.token[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], out_col])

    from pyspark.sql.types import StringType, StructField, StructType

    keep = [c for c in tokens.columns if c != out_col]
    schema = StructType([*(StructField(c, tokens.schema[c].dataType) for c in keep), StructField(out_col, StringType())])
    return tokens.select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col(f"`{ids_col}`").alias(unused(tokens, "ids_"))).mapInArrow(rows, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
