"""Media columns: progressive JPEG streams into full-resolution RGB tensors.

The decoder reads Huffman-coded progressive frames of 8 bits: spectral selection, successive approximation, end-of-band runs, restart intervals, any
sampling factors. The scans of a batch of streams are accumulated into coefficient arrays together: every restart segment of every stream is a lane, and a
step of numpy decodes one symbol of each lane. Where a symbol says which coefficients get correction bits, the bits are noted and
applied at the end of the scan. Then come the inverse transform (in numbers with whole values, so that results don't depend on how a product is
summed), upsampling of chroma by repetition, and RGB.

``store`` writes such streams. Its payload is kept losslessly in the format's unit, the quantised coefficient: 64 bytes are a block, six blocks a unit of a
4:2:0 picture (four of luma, two of chroma), and each byte is a coefficient from -127 to 128, frequent bytes small. The scans are: DC without its last bit, the first
five luma AC coefficients without theirs, the others and chroma whole, then the missing bits of DC and of the five. A comment segment holds the
payload's length.
"""

from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, read_table, small_batches, written

UNIT = 576
BATCH = 2 << 20
INTERVAL = 8  # units or blocks between restart markers
STEP = 8  # of quantisation
BAD = 1 << 20
_MARK = re.compile(rb"\xff+[\xd0-\xd7]")
_SCAN_END = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
#: Fixed values, from the format: row and column of each coefficient in zigzag order
ZIGZAG = np.array([r * 8 + c for d in range(15) for r, c in (lambda x: x if d % 2 else x[::-1])([(i, d - i) for i in range(max(0, d - 7), min(d, 7) + 1)])])
#: padding first, then what texts hold most, then all other bytes
_FIRST = b"\xff etaoinsrhldcu\xc3mfpgwyb.,vkzqxj\n\xa9ETAOINS\xb3\xa8\xb1\xbc\xb6\xa4!0123456789"
_ORDER = np.array([*_FIRST, *(b for b in range(256) if b not in _FIRST)], np.int64)
_VALUE = np.array([(i + 1) // 2 * (1 if i % 2 else -1) for i in range(256)], np.int64)  # 0, 1, -1, 2, -2, ... 128
_COEFFICIENT = np.empty(256, np.int64)
_COEFFICIENT[_ORDER] = _VALUE
_BYTE = np.zeros(512, np.uint8)
_BYTE[_VALUE + 256] = _ORDER
_SIZE = np.array([int(v).bit_length() for v in range(4096)])


# --- Huffman tables ----------------------------------------------------------------------------------------


def huffman_table(weights: dict[int, int]) -> tuple[bytes, bytes]:
    """(counts of codes by length 1 to 16, symbols) for positive weights; no code is all ones, so one leaf is held free."""
    nodes = sorted((w, [s]) for s, w in weights.items()) + []
    nodes.insert(0, (0, [-1]))
    length = Counter()
    while len(nodes) > 1:
        (a, x), (b, y) = nodes[:2]
        for s in x + y:
            length[s] += 1
        nodes = sorted([*nodes[2:], (a + b, x + y)], key=lambda n: n[0])
    free = max(length.values())  # the free leaf is among the longest
    counts = [0] * (max(free, 16) + 1)
    for s, n in length.items():
        counts[n] += 1
    for n in range(len(counts) - 1, 16, -1):  # no code longer than 16 bits
        while counts[n]:
            shorter = next(k for k in range(n - 2, 0, -1) if counts[k])
            counts[n] -= 2
            counts[n - 1] += 1
            counts[shorter] -= 1
            counts[shorter + 1] += 2
    last = max(n for n, c in enumerate(counts) if c)
    counts[last] -= 1
    symbols = sorted((s for s in length if s >= 0), key=lambda s: (length[s], s))
    return bytes(counts[1:17]), bytes(symbols)


def codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol; length 0 for those without."""
    code, k = 0, 0
    value, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n, c in enumerate(counts, 1):
        for s in symbols[k : k + c]:
            value[s], length[s] = code, n
            code += 1
        k += c
        code <<= 1
    return value, length


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits: symbol << 5 | length of the code that they begin with; where there is none, an end of band that is marked as ``BAD``."""
    out = np.full(1 << 16, BAD | 1, np.int32)
    value, length = codes(counts, symbols)
    for s in symbols:
        n = int(length[s])
        a = int(value[s]) << 16 - n
        out[a : a + (1 << 16 - n)] = s << 5 | n
    return out


# --- reading -----------------------------------------------------------------------------------------------


@lru_cache(512)
def _scan_order(across: int, down: int, *comps: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order, which of its components each belongs to, and blocks a unit; comps: (start, h, v, own columns, own rows). One component alone has no units, and only blocks that hold samples."""
    if len(comps) == 1:
        start, h, _, wide, high = comps[0]
        order = (start + np.arange(high)[:, None] * across * h + np.arange(wide)).ravel()
        return order, np.zeros(len(order), np.int64), 1
    each = []
    for start, h, v, _, _ in comps:
        rows = np.arange(down)[:, None, None, None] * v + np.arange(v)[:, None]
        cols = np.arange(across)[None, :, None, None] * h + np.arange(h)
        each.append((start + rows * across * h + cols).reshape(down * across, -1))
    of = np.concatenate([np.full(x.shape[1], i) for i, x in enumerate(each)])
    return np.concatenate(each, 1).ravel(), np.tile(of, down * across), len(of)


class Broken(ValueError):
    """A stream that is no whole progressive frame of the kind that is read here."""


class Frame:
    """Headers and scans of one stream. Blocks of a component lie row by row; ``start`` of a component is its first block's number in the stream."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise Broken("no start of image")
        at, self.tables, self.quant, self.scans, self.comment = 2, {}, {}, [], b""
        self.width = interval = 0
        while True:
            while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
                at += 1
            if at + 4 > len(data):
                if data[at : at + 2] == b"\xff\xd9":
                    break
                raise Broken("the stream ends early")
            if data[at] != 0xFF:
                raise Broken("no marker where one should be")
            kind = data[at + 1]
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    self.quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xC2:
                self._frame(body)
            elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
                raise Broken("not a progressive frame with Huffman codes")
            elif kind == 0xDD:
                interval = int.from_bytes(body, "big")
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                at = self._scan(data, at, body, interval)
        if not self.width:
            raise Broken("no frame")

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.comps = {}
        if bits != 8 or n not in (1, 3) or not self.width or not self.height:
            raise Broken("not 8 bits in one or three components")
        rows = [(c, hv >> 4, hv & 15, q) for c, hv, q in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
        self.h, self.v = max(r[1] for r in rows), max(r[2] for r in rows)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        start = 0
        for c, h, v, q in rows:
            own = (-(-self.width * h // (8 * self.h)), -(-self.height * v // (8 * self.v)))  # blocks that hold samples
            self.comps[c] = {"h": h, "v": v, "q": q, "start": start, "wide": self.across * h, "high": self.down * v, "own": own}
            start += self.across * h * self.down * v
        self.blocks = start

    def _scan(self, data: bytes, at: int, body: bytes, interval: int) -> int:
        if not self.width:
            raise Broken("a scan before its frame")
        n = body[0]
        chosen = [(self.comps[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
        end = _SCAN_END.search(data, at)
        end = end.start() if end else len(data)
        parts = [p.replace(b"\xff\x00", b"\xff") for p in _MARK.split(data[at:end])]
        order, of, per = _scan_order(self.across, self.down, *((c["start"], c["h"], c["v"], *c["own"]) for c, _ in chosen))
        step = interval * per if interval else len(order)
        if len(parts) != -(-len(order) // step):
            raise Broken("restart markers are missing")
        self.scans.append({"lo": lo, "hi": hi, "high": bits >> 4, "low": bits & 15, "order": order, "of": of, "step": step, "parts": parts, "comps": {c["start"] for c, _ in chosen}, "dc": [self.tables.get(t >> 4) for _, t in chosen], "ac": self.tables.get(16 | chosen[0][1] & 15)})
        return end


class _Lanes:
    """The restart segments of one scan each of several streams, their bits in one buffer."""

    def __init__(self, scans: list[tuple[dict, int]]):
        """scans: each with the number of its stream's first block."""
        n, step, base = (np.array(x, np.int64) for x in zip(*((len(s["order"]), s["step"], b) for s, b in scans)))
        parts = [p for s, _ in scans for p in s["parts"]]
        own = -(-n // step)  # lanes of each scan
        self.scan = np.repeat(np.arange(len(scans)), own)
        nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        done = np.cumsum(n) - n
        self.first = done[self.scan] + nth * step[self.scan]
        self.last = np.minimum(self.first + step[self.scan], (done + n)[self.scan])
        self.order = np.concatenate([s["order"] for s, _ in scans]) + np.repeat(base, n)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 4
        self.bit = (np.cumsum(size) - size) * 8
        data = b"\0\0\0\0".join(parts) + bytes(24)
        self.word = np.empty(len(data) // 8 * 8 - 8, np.uint64)  # the 64 bits that begin at each byte
        for i in range(8):
            self.word[i::8] = np.frombuffer(data, ">u8", len(self.word) // 8, i)

    def peek(self, p: np.ndarray) -> np.ndarray:
        """The 57 bits at each position, on the left of 64."""
        return self.word.take(p >> 3, mode="clip") << (p & 7).view(np.uint64)

    def bit_at(self, p: np.ndarray) -> np.ndarray:
        return (self.peek(p) >> _U(63)).view(np.int64)


_U = np.uint64


def _next(lanes: _Lanes, p: np.ndarray, table: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol entries at each position, the positions behind their codes, and the bits there, on the left."""
    x = lanes.peek(p)
    got = table.take((x >> _U(48)).view(np.int64) + base)
    size = got & 31
    return got, p + size, x << size.astype(np.uint64)


def _left(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits, 0 to 16, of what stands on the left."""
    return (x >> _U(1) >> (63 - n).astype(np.uint64)).view(np.int64)


def _tables(which: list) -> tuple[np.ndarray, np.ndarray]:
    """All tables behind one another, and where each begins."""
    known = {t: i for i, t in enumerate(dict.fromkeys(which))}
    if None in known:
        raise Broken("a table is missing")
    return np.concatenate([lookup(*t) for t in known]), np.array([known[t] << 16 for t in which], np.int64)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return bits - np.where(bits >> np.maximum(size - 1, 0) == 0, (1 << size) - 1, 0)


def _dc_first(lanes: _Lanes, scans: list[dict], coef: np.ndarray) -> None:
    of, low = np.concatenate([s["of"] for s in scans]), np.array([s["low"] for s in scans])
    table, base = _tables([t for s in scans for t in s["dc"]])
    skip = np.cumsum([0] + [len(s["dc"]) for s in scans])
    p, b, end, skip, bad = lanes.bit.copy(), lanes.first.copy(), lanes.last, skip[lanes.scan], False
    diff = np.zeros(len(lanes.order), np.int64)
    while len(p):
        got, p, x = _next(lanes, p, table, base[skip + of[b]])
        bad |= bool((got >= BAD).any())
        n = (got >> 5).astype(np.int64) & 15
        diff[b] = _signed(_left(x, n), n)
        p, b = p + n, b + 1
        on = b < end
        if not on.all():
            p, b, end, skip = (y[on] for y in (p, b, end, skip))
    if bad:
        raise Broken("no such code")
    # sums of differences by lane and component
    key = np.repeat(np.arange(len(lanes.bit)), lanes.last - lanes.first) * 4 + of
    by = np.argsort(key, kind="stable")
    total = np.cumsum(diff[by])
    start = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
    before = np.concatenate(([0], total))[start]
    total -= np.repeat(before, np.diff(np.append(start, len(by))))
    value = np.empty_like(total)
    value[by] = total
    coef[lanes.order, 0] = value << np.repeat(low[lanes.scan], lanes.last - lanes.first)


def _dc_refine(lanes: _Lanes, scans: list[dict], coef: np.ndarray) -> None:
    n = lanes.last - lanes.first
    low = np.array([s["low"] for s in scans])[lanes.scan]
    at = np.repeat(lanes.bit - lanes.first, n) + np.arange(n.sum())
    coef[lanes.order, 0] |= lanes.bit_at(at) << np.repeat(low, n)


def _ac_first(lanes: _Lanes, scans: list[dict], coef: np.ndarray) -> None:
    table, base = _tables([s["ac"] for s in scans])
    lo, hi, low = (np.array([s[k] for s in scans], np.int64)[lanes.scan] for k in ("lo", "hi", "low"))
    base, flat, events, bad = base[lanes.scan], coef.reshape(-1), [], False
    p, b, k, end = lanes.bit.copy(), lanes.first.copy(), lo.copy(), lanes.last
    order = lanes.order * 64
    while len(p):
        live = b < end
        if (n_live := np.count_nonzero(live)) < 0.85 * len(live):
            if not n_live:
                break
            p, b, k, end, lo, hi, low, base = (y[live] for y in (p, b, k, end, lo, hi, low, base))
            live = np.ones(n_live, bool)
        got, p, x = _next(lanes, p, table, base)
        symbol = (got >> 5).astype(np.int64)
        run, n = symbol >> 4, symbol & 15
        hit = np.flatnonzero((n > 0) & live)
        k += run & 15
        bits = _left(x[hit], n[hit])
        events.append((order[b[hit]] + k[hit], _signed(bits, n[hit]) << low[hit]))
        bad = bad or bool((k[hit] > hi[hit]).any())
        p += n
        k += 1
        ends = np.flatnonzero((n == 0) & (run != 15) & live)
        if len(ends):  # the end of a band, of this block and maybe of others behind it
            bad = bad or bool((got[ends] >= BAD).any())
            r = run[ends] & 15
            b[ends] += (1 << r) - 1 + _left(x[ends], r)
            p[ends] += r
            k[ends] = 64
        done = k > hi
        b += done
        k = np.where(done, lo, k)
    if bad:
        raise Broken("no such code, or a run that leaves its band")
    for at, value in events:
        flat[at] = value


def _ac_refine(lanes: _Lanes, scans: list[dict], coef: np.ndarray) -> None:
    table, base = _tables([s["ac"] for s in scans])
    lo, hi, low = (np.array([s[k] for s in scans], np.int64)[lanes.scan] for k in ("lo", "hi", "low"))
    base, bad = base[lanes.scan], False
    # of each block: how many zeros stand before a coefficient, and where the zeros and the others are
    known = coef[lanes.order] != 0
    zeros = np.zeros((len(known), 65), np.int8)
    np.cumsum(~known, axis=1, out=zeros[:, 1:], dtype=np.int8)
    place = np.full((len(known), 128), 64, np.int8)
    rank = np.where(known, 64 + np.arange(64, dtype=np.int8) - zeros[:, :64], zeros[:, :64])
    place[np.arange(len(known))[:, None], rank] = np.arange(64, dtype=np.int8)
    # of each block: how many of its coefficients in the band are known, for runs of blocks that have correction bits only
    each = np.repeat(np.arange(len(lanes.bit)), lanes.last - lanes.first)
    start = lo[each] - zeros[np.arange(len(known)), lo[each]]
    own = hi[each] + 1 - zeros[np.arange(len(known)), hi[each] + 1] - start
    upto = np.concatenate(([0], np.cumsum(own)))
    flat, fresh, due = coef.reshape(-1), [], []
    p, b, k, end = lanes.bit.copy(), lanes.first.copy(), lo.copy(), lanes.last
    while len(p):
        got, p, x = _next(lanes, p, table, base)
        bad = bad or bool((got >= BAD).any())
        symbol = (got >> 5).astype(np.int64)
        run, n = symbol >> 4 & 15, symbol & 15
        bad = bad or bool((n > 1).any())
        over = (n == 0) & (run < 15)
        more = np.where(over, run, n)
        value = _left(x, more)
        p = p + more
        before = zeros[b, k].astype(np.int64)
        target = np.where(over, hi + 1, place[b, np.minimum(before + run, 63)])
        target = np.where(~over & (before + run >= zeros[b, 64]), hi + 2, target)
        bad = bad or bool((target > hi + over).any())
        target = np.minimum(target, hi + 1)
        count = target - k - (zeros[b, target] - before)
        due.append((p, b, k - before, count))
        p = p + count
        hit = np.flatnonzero(n)
        fresh.append((lanes.order[b[hit]] * 64 + target[hit], np.where(value[hit] > 0, 1, -1) << low[hit]))
        k = target + 1
        done = over | (k > hi)
        b = b + done
        far = np.flatnonzero(over & ((run > 0) | (value > 0)))
        if len(far):  # the blocks behind this one that the end of band holds for as well
            blocks = (1 << run[far]) - 1 + value[far]
            if (b[far] + blocks > end[far]).any():
                raise Broken("an end of band leaves its scan")
            nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            at = np.repeat(b[far], blocks) + nth
            due.append((np.repeat(p[far] - upto[b[far]], blocks) + upto[at], at, start[at], own[at]))
            p[far] += upto[b[far] + blocks] - upto[b[far]]
            b[far] += blocks
        k = np.where(done, lo, k)
        on = b < end
        if not on.all():
            p, b, k, end, lo, hi, low, base = (y[on] for y in (p, b, k, end, lo, hi, low, base))
    if bad:
        raise Broken("no such code, or a run that leaves its band")
    at, block, rank, count = (np.concatenate(c) for c in zip(*due))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bit = lanes.bit_at(np.repeat(at, count) + nth)
    block, rank = np.repeat(block, count), np.repeat(rank, count) + nth
    where = (lanes.order[block] * 64 + place[block, 64 + rank])[bit > 0]
    lows = np.repeat(np.array([s["low"] for s in scans])[lanes.scan], lanes.last - lanes.first)
    flat[where] += np.sign(flat[where]) << lows[block[bit > 0]]
    for at, value in fresh:
        flat[at] = value


def _rounds(scans: list[dict]):
    """Consecutive scans of one kind that concern different components don't touch each other's coefficients and can be read together."""
    out: list[tuple] = []
    for s in scans:
        kind = (s["lo"] > 0, s["high"] > 0)
        if out and out[-1][0] == kind and not out[-1][2] & s["comps"]:
            out[-1][1].append(s)
            out[-1][2].update(s["comps"])
        else:
            out.append((kind, [s], set(s["comps"])))
    return out


def coefficients(frames: list[Frame]) -> list[np.ndarray]:
    """Of each frame its coefficients [block, 64] in zigzag order; the n-th rounds of scans of all frames are read together, by kind."""
    starts = np.cumsum([0] + [f.blocks for f in frames])
    coef = np.zeros((starts[-1], 64), np.int32)
    rounds = [_rounds(f.scans) for f in frames]
    for i in range(max(map(len, rounds), default=0)):
        kinds = defaultdict(list)
        for r, base in zip(rounds, starts):
            if i < len(r):
                kinds[r[i][0]] += [(s, base) for s in r[i][1]]
        for (ac, refine), scans in kinds.items():
            run = (_ac_refine if refine else _ac_first) if ac else (_dc_refine if refine else _dc_first)
            run(_Lanes(scans), [s for s, _ in scans], coef)
    return [coef[a:b] for a, b in zip(starts, starts[1:])]


# --- samples -----------------------------------------------------------------------------------------------

_COS = np.array([[np.round((1 << 12) * np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5)) for x in range(8)] for u in range(8)])


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Samples [block, 8, 8] from dequantised coefficients [block, 64] in zigzag order. All sums are whole numbers below 2**53."""
    x = np.zeros((len(blocks), 64))
    x[:, ZIGZAG] = blocks
    x = (x.reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
    x = (x @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor((x + (1 << 23)) / (1 << 24)) + 128, 0, 255).astype(np.uint8)


def tensor(frame: Frame, samples: np.ndarray) -> np.ndarray:
    """RGB [height, width, 3] of a frame from its blocks' samples."""

    def spread(x: np.ndarray, c: dict) -> np.ndarray:
        for axis, (n, own, most) in enumerate(((frame.height, c["v"], frame.v), (frame.width, c["h"], frame.h))):
            x = np.repeat(x, most // own, axis) if most % own == 0 else x.take(np.arange(n) * own // most, axis)
        return x[: frame.height, : frame.width]

    comps = list(frame.comps.values())
    planes = [samples[c["start"] : c["start"] + c["wide"] * c["high"]].reshape(c["high"], c["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(c["high"] * 8, -1) for c in comps]
    y = spread(planes[0], comps[0])
    if len(comps) == 1:
        return np.repeat(y[:, :, None], 3, 2)
    half = 1 << 15
    blue, red = (x.astype(np.int32) - 128 for x in planes[1:])
    alike = comps[1]["h"] == comps[2]["h"] and comps[1]["v"] == comps[2]["v"]
    if not alike:
        blue, red = spread(blue, comps[1]), spread(red, comps[2])
    add = [91881 * red + half >> 16, -(22554 * blue + 46802 * red + half >> 16), 116130 * blue + half >> 16]
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    for i, x in enumerate(add):
        x = x.astype(np.int16)
        out[:, :, i] = np.clip(y + (spread(x, comps[1]) if alike else x), 0, 255)
    return out


def payload(frame: Frame, coef: np.ndarray) -> bytes | None:
    """What ``store`` put into a stream; None for others."""
    if not frame.comment.startswith(b"payload "):
        return None
    order = _units(frame.across, frame.down)
    return _BYTE[coef[order].ravel() + 256].tobytes()[: int(frame.comment[8:])]


def read(streams: list[bytes]) -> list[tuple[Frame, np.ndarray, np.ndarray] | None]:
    """(frame, coefficients, RGB tensor) of each stream, None for one that is no whole progressive frame."""
    frames: list[Frame | None] = []
    for data in streams:
        try:
            frames.append(Frame(data))
        except (Broken, IndexError, KeyError, ValueError, struct.error):
            frames.append(None)
    good = [f for f in frames if f is not None]
    try:
        coefs = coefficients(good)
    except (Broken, IndexError):
        if len(good) == 1:
            return [None] * len(streams)
        return [read([s])[0] for s in streams]  # find the one that is broken
    out, at = [], 0
    quant = [np.concatenate([np.broadcast_to(f.quant.get(c["q"], np.ones(64, np.int64)), (c["wide"] * c["high"], 64)) for c in f.comps.values()]) for f in good]
    samples = inverse(np.concatenate(coefs) * np.concatenate(quant)) if good else np.zeros((0, 8, 8))
    for f, c in zip(good, coefs):
        out.append((f, c, tensor(f, samples[at : at + f.blocks])))
        at += f.blocks
    found = iter(out)
    return [None if f is None else next(found) for f in frames]


# --- writing -----------------------------------------------------------------------------------------------


@lru_cache(256)
def _units(across: int, down: int) -> np.ndarray:
    """The blocks of a 4:2:0 frame in order of its units: four of luma, two of chroma."""
    n = across * down
    y = (np.arange(down)[:, None, None, None] * 2 + np.arange(2)[:, None]) * (2 * across) + np.arange(across)[None, :, None, None] * 2 + np.arange(2)
    chroma = 4 * n + np.arange(n)[:, None]
    return np.concatenate((y.reshape(n, 4), chroma, chroma + n), 1).ravel()


# shares of coefficients by size, 1 first; any run and size may come, and long runs have long codes; the code of
# sixteen zeros is short, so that three of them and a value fit into 57 bits
_SHARE = (27, 22, 30, 12, 3, 5, 2, 1)
_DC = huffman_table({0: 25} | {n: max(1, 40 >> abs(n - 2)) for n in range(1, 12)})
_AC = huffman_table({run << 4 | n: max(1, (_SHARE[n - 1] << 14) >> 5 * run) for run in range(16) for n in range(1, 9)} | {0: 4096, 0xF0: 4096})
_LOW = huffman_table({run << 4 | n: max(1, (_SHARE[n] << 14) >> 2 * run) for run in range(16) for n in range(1, 8)} | {0: 16 << 14, 0xF0: 1})
_REFINE = huffman_table({run << 4 | 1: max(1, 4096 >> 5 * run) for run in range(16)} | {0: 3000, 0xF0: 1})


def _pack(code: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of up to 57 bits behind one another, each lane filled up with ones to whole bytes: the bytes, and the first byte of each lane and the end."""
    on = length > 0
    code, length, lane = code[on], length[on], lane[on]
    ends = np.cumsum(length)
    upto = np.searchsorted(lane, np.arange(lanes + 1))  # lanes come in order
    before = np.concatenate(([0], ends))[upto]
    total = np.diff(before)
    fill = -total % 8
    first = np.concatenate(([0], np.cumsum(total + fill))) >> 3
    at = ends - length + np.repeat(first[:-1] * 8 - before[:-1], np.diff(upto))
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    size = length.astype(np.uint64)
    top = code << (np.uint64(64) - size)
    out = np.zeros((int(first[-1]) >> 3) + 2, np.uint64)
    spill = np.where(shift > 0, top << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    for index, bits in ((word, top >> shift), (word + 1, spill)):
        if len(index):
            start = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
            out[index[start]] |= np.bitwise_or.reduceat(bits, start)
    data = out.byteswap().view(np.uint8)[: int(first[-1])].copy()
    filled = np.flatnonzero(fill)
    data[first[filled + 1] - 1] |= ((1 << fill[filled]) - 1).astype(np.uint8)
    return data, first


def _with_bits(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a size: the value, or for a negative one its complement."""
    return (np.where(value < 0, value + (1 << size) - 1, value)).astype(np.uint64)


@lru_cache(8)
def _value_codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of the values -128 to 128 behind no zeros."""
    code, length = codes(counts, symbols)
    value = np.arange(-128, 129)
    size = _SIZE[np.abs(value)]
    return code[size] << size.astype(np.uint64) | _with_bits(value, size), length[size] + size


def _first_codes(band: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Codes [block, width + 1] of an AC scan's values [block, width]; the last is the end of the block."""
    code, length = codes(*table)
    n, m = band.shape
    hit = band != 0
    full = hit.all(1)
    if full.any():  # no runs: each value has one code
        value, bits = _value_codes(*table)
        out, out_size = np.zeros((n, m + 1), np.uint64), np.zeros((n, m + 1), np.int64)
        own = band[full] + 128
        out[full, :m], out_size[full, :m] = value[own], bits[own]
        if not full.all():
            out[~full], out_size[~full] = _first_codes(band[~full], table)
        return out, out_size
    at = np.where(hit, np.arange(1, m + 1), 0)
    before = np.zeros((n, m), np.int64)
    np.maximum.accumulate(at[:, :-1], axis=1, out=before[:, 1:])
    run = np.arange(m) - before
    size = _SIZE[np.abs(band)]
    symbol = (run & 15) << 4 | size
    out, out_size = np.zeros((n, m + 1), np.uint64), np.zeros((n, m + 1), np.int64)
    value = code[symbol] << size.astype(np.uint64) | _with_bits(band, size)
    out[:, :m] = np.where(hit, value, 0)
    out_size[:, :m] = np.where(hit, length[symbol] + size, 0)
    # sixteen zeros at a time come before the value's own code; three of them at most
    for i, j in zip(*np.nonzero(hit & (run > 15))):
        zrl = 0
        for _ in range(int(run[i, j]) >> 4):
            zrl = zrl << int(length[0xF0]) | int(code[0xF0])
        out[i, j] |= np.uint64(zrl << int(out_size[i, j]))
        out_size[i, j] += int(length[0xF0]) * (int(run[i, j]) >> 4)
    end = ~hit[:, -1]
    out[end, m], out_size[end, m] = code[0], length[0]
    return out, out_size


def _refine_codes(size: np.ndarray, positive: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Codes [block, width * 2] of a scan that adds the last bit; size: absolute values [block, width]. A symbol stands where its group begins, correction bits at their coefficients."""
    code, length = codes(*table)
    n, m = size.shape
    zero, new = size == 0, size == 1
    place = np.arange(m)
    last = np.where(new.any(1), m - 1 - new[:, ::-1].argmax(1), -1)
    zeros = np.cumsum(zero, axis=1)
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    at_new = np.zeros((n, m), np.int64)
    at_new[:, 1:] = since[:, :-1]
    at_new[:, 0] = 0  # zeros since the last new one, before each coefficient
    full = zero & (since % 16 == 0) & (place < last[:, None])
    ends = new | full
    begin = np.zeros((n, m), np.int64)
    begin[:, 1:] = np.maximum.accumulate(np.where(ends, place + 1, 0), axis=1)[:, :-1]
    out, out_size = np.zeros((n, m, 2), np.uint64), np.zeros((n, m, 2), np.int64)
    i, j = np.nonzero(new)
    symbol = (at_new[i, j] & 15) << 4 | 1
    out[i, begin[i, j], 0] = code[symbol] << np.uint64(1) | positive[i, j].astype(np.uint64)
    out_size[i, begin[i, j], 0] = length[symbol] + 1
    i, j = np.nonzero(full)
    out[i, begin[i, j], 0], out_size[i, begin[i, j], 0] = code[0xF0], length[0xF0]
    open_end = np.flatnonzero(last < m - 1)
    start = np.maximum(last[open_end] + 1, 0)
    out[open_end, start, 0], out_size[open_end, start, 0] = code[0], length[0]
    known = size > 1
    out[:, :, 1], out_size[:, :, 1] = np.where(known, size & 1, 0), known
    return out.reshape(n, -1), out_size.reshape(n, -1)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


def _sos(comps: list[int], table: int, lo: int, hi: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c, table)), lo, hi, high << 4 | low]))


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([STEP] * 64)) + _segment(0xC4, b"".join(bytes([i]) + t[0] + t[1] for i, t in ((0, _DC), (16, _AC), (17, _LOW), (18, _REFINE)))) + _segment(0xDD, struct.pack(">H", INTERVAL))


def store(payloads: list[bytes]) -> list[bytes]:
    """Progressive 4:2:0 streams of payloads of a positive multiple of 64 bytes."""
    shapes = []
    for x in payloads:
        units = -(-len(x) // 384)
        across = max(min(units, 16), -(-units // 4000))
        shapes.append((across, -(-units // across)))
    blocks = np.array([6 * a * d for a, d in shapes], np.int64)
    starts = np.concatenate(([0], np.cumsum(blocks)))
    coef = np.zeros((starts[-1], 64), np.int64)
    for x, shape, at in zip(payloads, shapes, starts):
        order = _units(*shape)[: len(x) // 64]
        coef[at + order] = _COEFFICIENT[np.frombuffer(x, np.uint8)].reshape(-1, 64)
    value, length = codes(*_DC)
    scans = []
    mcu = np.concatenate([at + _units(*s) for s, at in zip(shapes, starts)])
    units = blocks // 6

    def lanes(per_stream: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The lane of each item, and each stream's first lane."""
        n = -(-per_stream // step)
        first = np.concatenate(([0], np.cumsum(n)))
        inside = np.arange(per_stream.sum()) - np.repeat(np.cumsum(per_stream) - per_stream, per_stream)
        return np.repeat(first[:-1], per_stream) + inside // step, first, int(first[-1])

    # DC, without and then with its last bit
    lane, first, n = lanes(blocks, 6 * INTERVAL)
    dc = coef[mcu, 0]
    comp = np.tile([0, 0, 0, 0, 1, 2], int(units.sum()))
    high = dc >> 1
    by = np.argsort(lane * 4 + comp, kind="stable")
    ordered, key = high[by], (lane * 4 + comp)[by]
    diff = np.diff(ordered, prepend=0)
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    diff[fresh] = ordered[fresh]
    delta = np.empty_like(diff)
    delta[by] = diff
    size = _SIZE[np.abs(delta)]
    scans.append((_sos([1, 2, 3], 0, 0, 0, 0, 1), _pack(value[size] << size.astype(np.uint64) | _with_bits(delta, size), length[size] + size, lane, n), first))
    dc_low = (_sos([1, 2, 3], 0, 0, 0, 1, 0), _pack((dc & 1).astype(np.uint64), np.ones(len(dc), np.int64), lane, n), first)
    for c, (a, b), lo, hi, kind in ((1, (0, 4), 1, 5, 1), (1, (0, 4), 6, 63, 0), (2, (4, 5), 1, 63, 0), (3, (5, 6), 1, 63, 0), (1, (0, 4), 1, 5, 2)):
        if kind == 2:
            scans.append(dc_low)
        per = units * (b - a)
        rows = np.repeat(starts[:-1] + a * units - np.cumsum(per) + per, per) + np.arange(per.sum())
        lane, first, n = lanes(per, INTERVAL)
        own = coef[rows, lo : hi + 1]
        if kind == 2:
            code, size = _refine_codes(np.abs(own), own > 0, _REFINE)
        else:
            code, size = _first_codes(np.sign(own) * (np.abs(own) >> 1), _LOW) if kind else _first_codes(own, _AC)
        scans.append((_sos([c], kind, lo, hi, int(kind == 2), int(kind == 1)), _pack(code.ravel(), size.ravel(), np.repeat(lane, code.shape[1]), n), first))
    parts = []
    for head, (data, at), first in scans:
        raw = data.tobytes()
        parts.append((head, raw, at, first))
    out = []
    for i, (x, (across, down)) in enumerate(zip(payloads, shapes)):
        frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        pieces = [_HEAD, _segment(0xFE, b"payload %d" % len(x)), _segment(0xC2, frame)]
        for head, raw, at, first in parts:
            pieces.append(head)
            for k, j in enumerate(range(first[i], first[i + 1])):
                if k:
                    pieces.append(bytes((0xFF, 0xD0 + (k - 1) % 8)))
                pieces.append(raw[at[j] : at[j + 1]].replace(b"\xff", b"\xff\x00"))
        out.append(b"".join([*pieces, b"\xff\xd9"]))
    return out


# --- columns -----------------------------------------------------------------------------------------------


def _groups(sizes: list[int], limit: int = BATCH):
    a, n = 0, 0
    for i, s in enumerate(sizes):
        if n and n + s > limit:
            yield a, i
            a, n = i, 0
        n += s
    if a < len(sizes):
        yield a, len(sizes)


def padded(text: bytes) -> bytes:
    """A text with bytes 255 behind it, up to a positive multiple of UNIT."""
    return text + b"\xff" * (UNIT - len(text) if not text else -len(text) % UNIT)


def encode_media(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): each row's text as a progressive JPEG stream. Null text counts as empty; ids may be null or repeat; extra columns are ignored."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1).to_pylist())
            for a, b in _groups([len(t) + UNIT for t in texts]):
                media = store([padded(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n_bytes bigint, media binary")


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with width, height, rgb (height * width * 3 bytes, row by row) and payload (what ``store`` put in, else null).

    A null stream, or one that is no whole progressive frame of 8 bits and one or three components, gets nulls. New columns take the place of others of their names.
    """
    small_batches(rows.sparkSession)
    names = [c for c in rows.columns if c not in ("width", "height", "rgb", "payload")]
    at = names.index(media_col)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields), "width int, height int, rgb binary, payload binary"])

    def run(batches):
        for batch in batches:
            media = batch.column(at).to_pylist()
            for a, b in _groups([len(m or b"") for m in media], BATCH // 2):
                got = read([m or b"" for m in media[a:b]])
                new = [(None, None, None, None) if g is None else (g[0].width, g[0].height, g[2].tobytes(), payload(g[0], g[1])) for g in got]
                cols = [pa.array([x[c] for x in new], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *cols], [*names, "width", "height", "rgb", "payload"])

    return rows.select(*names).mapInArrow(run, ddl)


def hexed(c: str | Column) -> Column:
    return F.sha2(c, 256)


def op12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written as a stream to a table, read back and decoded; feature is the picture's size and its tensor's checksum."""
    made = encode_media(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    path = written(made, "media", compression="zstd")[0]
    got = decode_media(path)
    size = F.octet_length("payload").cast("bigint")
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", size.alias("payload_bytes"), hexed("payload").alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        hexed("media").alias("media_sha256"), F.concat_ws(":", F.concat_ws("x", "width", "height"), F.crc32("rgb")).alias("feature"),
    )
