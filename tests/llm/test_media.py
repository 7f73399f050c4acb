"""op12: the decoder against streams of a plain encoder, samples and colours against formulas, and round trips of payloads."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from lumenweave.llm import op12_media as m

TABLE = (bytes([0] * 7 + [127, 129] + [0] * 7), bytes(range(256)))
CODE, LENGTH = m.codes(*TABLE)


class Bits:
    """A scan's bits, one by one, with stuffing."""

    def __init__(self):
        self.out, self.bits = bytearray(), ""

    def put(self, value, n):
        if n:
            self.bits += format(value, f"0{n}b")

    def symbol(self, s):
        self.put(int(CODE[s]), int(LENGTH[s]))

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        data = bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8)).replace(b"\xff", b"\xff\x00")
        self.bits = ""
        return data


def size(v):
    return abs(v).bit_length()


def value_bits(v):
    return v if v >= 0 else v + (1 << size(v)) - 1


def shift(v, low):
    return int(math.copysign(abs(v) >> low, v))


def eobs(bits, run, corrections):
    """An end of band for ``run`` blocks, with the correction bits that are due."""
    while run:
        n = min(run, 0x7FFF)
        k = n.bit_length() - 1
        bits.symbol(k << 4)
        bits.put(n - (1 << k), k)
        run -= n
    for c in corrections:
        bits.put(c, 1)


def ac_first(blocks, lo, hi, low, bits):
    run = 0
    for b in blocks:
        r = 0
        for k in range(lo, hi + 1):
            v = shift(b[k], low)
            if not v:
                r += 1
                continue
            eobs(bits, run, ())
            run = 0
            while r > 15:
                bits.symbol(0xF0)
                r -= 16
            bits.symbol(r << 4 | size(v))
            bits.put(value_bits(v), size(v))
            r = 0
        run += r > 0
    eobs(bits, run, ())


def ac_refine(blocks, lo, hi, low, bits):
    run, due = 0, []
    for b in blocks:
        mags = [abs(v) >> low for v in b]
        last = max((k for k in range(lo, hi + 1) if mags[k] == 1), default=-1)
        r, own = 0, []
        for k in range(lo, hi + 1):
            if not mags[k]:
                r += 1
                continue
            while r > 15 and k <= last:
                eobs(bits, run, due)
                run, due = 0, []
                bits.symbol(0xF0)
                for c in own:
                    bits.put(c, 1)
                own, r = [], r - 16
            if mags[k] > 1:
                own.append(mags[k] & 1)
                continue
            eobs(bits, run, due)
            run, due = 0, []
            bits.symbol(r << 4 | 1)
            bits.put(b[k] > 0, 1)
            for c in own:
                bits.put(c, 1)
            own, r = [], 0
        if r or own:
            run, due = run + 1, due + own
            if len(due) > 900 or run == 0x7FFF:
                eobs(bits, run, due)
                run, due = 0, []
    eobs(bits, run, due)


def plain_stream(width, height, sampling, coefs, script, interval=0, quant=1):
    """coefs: for each component [rows of blocks][blocks][64] in zigzag order, padded to whole units; script: (components, lo, hi, high, low)."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = b"\xff\xd8" + m._segment(0xE0, b"JFIF\0") + m._segment(0xDB, bytes([0]) + bytes([quant]) * 64)
    out += m._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([7 + i, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    out += m._segment(0xC4, bytes([0]) + TABLE[0] + TABLE[1]) + m._segment(0xC4, bytes([16]) + TABLE[0] + TABLE[1])
    if interval:
        out += m._segment(0xDD, struct.pack(">H", interval))
    for comps, lo, hi, high, low in script:
        if len(comps) == 1:
            h, v = sampling[comps[0]]
            w, n = -(-width * h // (8 * hm)), -(-height * v // (8 * vm))
            units = [[(comps[0], coefs[comps[0]][y][x])] for y in range(n) for x in range(w)]
        else:
            units = [[(c, coefs[c][y * sampling[c][1] + j][x * sampling[c][0] + i]) for c in comps for j in range(sampling[c][1]) for i in range(sampling[c][0])] for y in range(down) for x in range(across)]
        step, parts = interval or len(units), []
        for a in range(0, len(units), step):
            bits, before = Bits(), dict.fromkeys(comps, 0)
            part = units[a : a + step]
            if lo:
                (ac_refine if high else ac_first)([b for u in part for _, b in u], lo, hi, low, bits)
            else:
                for u in part:
                    for c, b in u:
                        if high:
                            bits.put(b[0] >> low & 1, 1)
                        else:
                            d = (b[0] >> low) - before[c]
                            before[c] = b[0] >> low
                            bits.symbol(size(d))
                            bits.put(value_bits(d), size(d))
            parts.append(bits.flush())
        head = m._segment(0xDA, bytes([len(comps), *(x for c in comps for x in (7 + c, 0)), lo, hi, high << 4 | low]))
        out += head + b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    return out + b"\xff\xd9"


def random_coefs(rng, width, height, sampling, density, top):
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = []
    for h, v in sampling:
        x = np.where(rng.random((down * v, across * h, 64)) < density, rng.integers(-top, top + 1, (down * v, across * h, 64)), 0)
        # what lies outside the picture is in scans of all components only, so its AC are zero
        w, n = -(-width * h // (8 * hm)), -(-height * v // (8 * vm))
        first = int(len(sampling) > 1)
        x[n:, :, first:], x[:, w:, first:] = 0, 0
        out.append(x.tolist())
    return out


FULL = [([0, 1, 2], 0, 0, 0, 1), ([0], 1, 5, 0, 2), ([2], 1, 63, 0, 1), ([1], 1, 63, 0, 1), ([0], 6, 63, 0, 2), ([0], 1, 63, 2, 1), ([0, 1, 2], 0, 0, 1, 0), ([2], 1, 63, 1, 0), ([1], 1, 63, 1, 0), ([0], 1, 63, 1, 0)]
GREY = [([0], 0, 0, 0, 2), ([0], 1, 63, 0, 3), ([0], 0, 0, 2, 1), ([0], 1, 63, 3, 2), ([0], 1, 20, 2, 1), ([0], 21, 63, 2, 1), ([0], 0, 0, 1, 0), ([0], 1, 63, 1, 0)]
CASES = [(40, 33, [(2, 2), (1, 1), (1, 1)], FULL), (17, 50, [(2, 1), (1, 1), (1, 1)], FULL), (9, 9, [(1, 1)] * 3, FULL), (70, 8, [(4, 1), (1, 1), (2, 1)], FULL), (33, 31, [(1, 1)], GREY), (1, 1, [(2, 2)], GREY)]


@pytest.mark.parametrize("interval", [0, 1, 5])
@pytest.mark.parametrize("density", [0.0, 0.02, 0.3, 1.0])
def test_coefficients_of_plain_streams(interval, density):
    rng = np.random.default_rng(int(density * 100) + interval)
    streams, want = [], []
    for width, height, sampling, script in CASES:
        c = random_coefs(rng, width, height, sampling, density, int(rng.choice([1, 3, 40, 500])))
        streams.append(plain_stream(width, height, sampling, c, script, interval))
        want.append(np.concatenate([np.array(x).reshape(-1, 64) for x in c]))
    for got in (m.read(streams), [m.read([s])[0] for s in streams]):
        for g, w, (width, height, _, _) in zip(got, want, CASES):
            assert (g[1] == w).all() and g[2].shape == (height, width, 3) and m.payload(g[0], g[1]) is None


def test_a_run_over_very_many_blocks():
    c = np.zeros((190, 190, 64), np.int64)
    c[0, 0, 5], c[100, 7, 9], c[-1, -1, 63], c[:, :, 0] = 3, -13, -1, np.arange(190)
    g = m.read([plain_stream(1520, 1520, [(1, 1)], [c.tolist()], [GREY[0], *GREY[2:3], ([0], 0, 0, 1, 0), ([0], 1, 63, 0, 1), ([0], 1, 63, 1, 0)])])[0]
    assert (g[1] == c.reshape(-1, 64)).all()


def test_samples_and_colours():
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 61, (30, 64)) * (rng.random((30, 64)) < 0.2)
    x[:, 0] = rng.integers(-1000, 1000, 30)
    plain = np.zeros((30, 8, 8))
    for k in range(64):
        v, u = divmod(int(m.ZIGZAG[k]), 8)
        basis = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * (math.sqrt(0.125) if v == 0 else 0.5) * math.cos((2 * j + 1) * u * math.pi / 16) * math.cos((2 * i + 1) * v * math.pi / 16) for j in range(8)] for i in range(8)])
        plain += x[:, k, None, None] * basis
    got = m.inverse(x).astype(int)
    assert np.abs(got - np.clip(np.round(plain) + 128, 0, 255)).max() <= 1
    assert sorted(m.ZIGZAG.tolist()) == list(range(64)) and m.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and m.ZIGZAG[-2:].tolist() == [62, 63]
    for width, height, sampling, script in CASES[:4]:
        c = random_coefs(rng, width, height, sampling, 0.05, 60)
        frame, coef, rgb = m.read([plain_stream(width, height, sampling, c, script, quant=3)])[0]
        samples = m.inverse(coef * 3)
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        for yy in range(0, height, 5):
            for xx in range(0, width, 3):
                ycc = []
                for comp in frame.comps.values():
                    py, px = yy * comp["v"] // vm, xx * comp["h"] // hm
                    ycc.append(int(samples[comp["start"] + (py // 8) * comp["wide"] + px // 8][py % 8, px % 8]))
                y, cb, cr = ycc[0], ycc[1] - 128, ycc[2] - 128
                want = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
                assert all(abs(int(a) - min(255, max(0, b))) <= 1 for a, b in zip(rgb[yy, xx], want))


def payloads():
    rng = np.random.default_rng(2)
    out = [m.padded(b""), m.padded(b"x"), m.padded(b"y" * 576), m.padded(bytes(range(256)) * 9), m.padded("Ünï tëxt. ".encode() * 700)]
    out += [bytes(rng.integers(0, 256, 576 * 7, dtype=np.uint8)), bytes(rng.choice([255] * 40 + [32, 101, 65], 576 * 40).astype(np.uint8)), b"\xff" * 576 * 3, b"\x00" * 576, bytes(rng.choice([255] * 300 + [0], 576 * 60).astype(np.uint8))]
    return out


def test_payloads_come_back(spark):
    p = payloads()
    together = m.store(p)
    assert [m.payload(g[0], g[1]) for g in m.read(together)] == p
    assert [m.store([x])[0] for x in p] == together  # a stream does not depend on the others of its batch
    tensors = [g[2].tobytes() for g in m.read(together)]
    assert [m.read([x])[0][2].tobytes() for x in together] == tensors
    assert len(m.padded(b"a" * 576)) == 576 and len(m.padded(b"a" * 577)) == 1152


def test_a_payload_of_many_rows():
    x = bytes(np.random.default_rng(3).integers(97, 123, 64 * 9 * 4000, dtype=np.uint8))
    g = m.read(m.store([x]))[0]
    assert m.payload(g[0], g[1]) == x and g[0].width == 256


def test_what_is_no_stream_gives_none(spark):
    good = m.store([m.padded(b"a text")])[0]
    torn = [b"", b"\xff\xd8", good[:-1], good[:200], good.replace(b"\xff\xc2", b"\xff\xc0"), good[:400] + b"\x00\x01\xff" * 30 + good[430:], b"no picture", None]
    got = m.read([x or b"" for x in torn[:-1]] + [good])
    assert got[-1] is not None and [g is None for g in got[:5]] == [True] * 5 and got[6] is None
    df = spark.createDataFrame([(i, x, "w") for i, x in enumerate([*torn, good])], "n int, media binary, width string")
    rows = {r.n: r for r in m.decode_media(df).collect()}
    assert rows[8].payload == m.padded(b"a text") and rows[8].width == 32 and len(rows[8].rgb) == 32 * 16 * 3
    assert rows[0].width is None and rows[7].rgb is None and rows[1].payload is None


def test_query(spark, tmp_path):
    texts = [None, "", "a", "b" * 575, "c" * 576, "é" * 300, "A b\tc\n\x00\x7f", "long " * 60_000, "a", "\U0001f600" * 10]
    rows = [(i % 9 if i != 4 else None, t, "m", 3) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, media string, payload int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op12_media(spark, str(tmp_path)).collect()
    want = []
    for i, t, _, _ in rows:
        b = (t or "").encode()
        p = m.padded(b)
        media = m.store([p])[0]
        f = m.read([media])[0]
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{f[0].width}x{f[0].height}:{zlib.crc32(f[2].tobytes())}"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert m.op12_media(spark, f"{tmp_path}/none").count() == 0
