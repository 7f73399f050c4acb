"""op11: repairs against an exhaustive search, conversations in pieces of any size, and odd tables."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from lumenweave.llm import op11_conversations as m

DDL = "conv_id long, turn long, role string, text string"


def good(initials):
    """Whether role initials read (s?(ua)+)?."""
    x = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(x) > 0 and len(x) % 2 == 0 and x == "ua" * (len(x) // 2))


def cheapest(rows):
    """(cost, audit, lines) by best-first search over whole edit strings; rows: (role, text, must, cut)."""
    heap, seen, n = [(0, "", 0, ())], set(), 0
    limit = 2 * len(rows) + 4
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        initials = "".join(x[0] for x in lines)
        if i == len(rows) and good(initials):
            return cost, audit, lines
        if (audit, i, initials) in seen or len(audit) > limit:
            continue
        seen.add((audit, i, initials))
        n += 1
        # only beginnings that can still become right are worth going on with
        if not any(good(initials + t) for t in ("", "a", "ua", "uaua")):
            continue
        if i < len(rows):
            role, text, must, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, lines))
            if not must:
                if role[:1] and role[0] in "sua":
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, (*lines, f"{role}:{text}")))
                for made in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, (*lines, f"{made}:{text}")))
        for made in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*lines, f"{made}:")))


def plain(rows):
    """What the query says of damaged rows (turn, role, text, copies) of one conversation."""
    rows = [r for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for _ in range(r[3])]
    seen, judged, blank, dup, trunc = set(), [], 0, 0, 0
    for _, role, text, _ in rows:
        bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        b = not bare
        d = not b and (role, text) in seen
        t = not b and not d and bare[-1] not in ".!?"
        seen.add((role, text))
        judged.append((role, text, b or d, int(t)))
        blank, dup, trunc = blank + b, dup + d, trunc + t
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    cost, audit, lines = cheapest(judged)
    return gaps, blank, dup, trunc, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_every_short_sequence():
    """All sequences of up to three rows of every kind."""
    kinds = [(r, cut, must) for r in ("system", "user", "assistant", "tool") for cut in (0, 1) for must in (0, 1)]
    for n in range(4):
        for seq in itertools.product(kinds if n < 3 else kinds[::2] + kinds[1:2], repeat=n):
            rows = [(r, f"t{i}", bool(must), cut) for i, (r, cut, must) in enumerate(seq)]
            got = m.solve(m.Rows([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [bool(r[3]) for r in rows], [1] * n))
            cost, audit, lines = cheapest(rows)
            assert (got[0], got[1], tuple(got[2])) == (cost, audit, lines), seq


def random_rows(rng, convs, longest):
    roles, texts = ["system", "user", "assistant", "tool", "", "s", "umpire"], ["Yes.", "No!", "why?", "and", " ", "", "\t\n", "a.\n ", "é", "x" * 300]
    out = []
    for c in convs:
        for _ in range(rng.randrange(1, longest + 1)):
            out.append((c, rng.choice([None, *range(longest)]), rng.choice(roles), rng.choice(texts), rng.choice([1, 1, 2])))
    return out


@pytest.mark.parametrize(("piece_rows", "piece_bytes", "parts"), [(4096, 1 << 20, 3), (1, 1 << 20, 2), (2, 1 << 20, 7), (4096, 1, 5)])
def test_conversations_in_pieces(spark, piece_rows, piece_bytes, parts):
    rng = random.Random(piece_rows + parts)
    rows = random_rows(rng, [None, *range(25)], 5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.conv_id: tuple(r[c] for c in COLS) for r in m.repair(df, piece_rows, piece_bytes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    merged = {}
    for c, turn, role, text, n in rows:
        merged.setdefault(c, {}).setdefault((turn, role, text), 0)
        merged[c][turn, role, text] += n
    want = {c: plain([(*k, n) for k, n in x.items()]) for c, x in merged.items()}
    assert got == want


def test_one_long_conversation(spark):
    """A conversation in many pieces gives what it gives as a whole."""
    rng = random.Random(1)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["ok.", f"text {i}", f"text {i}."]), 1) for i in range(3000)] + [(8, 0, "user", "hi.", 1), (7, 1, "user", "same.", 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    got = {r.conv_id: r for r in m.repair(df, 50).collect()}
    table = m.faults(df).where("conv_id = 7").orderBy("turn", "role", "tie").collect()
    whole = m.Rows([r.role for r in table], [r.text for r in table], [r.blank or r.seen for r in table], [r.cut for r in table], [r.n for r in table])
    cost, audit, lines = m.solve(whole)
    assert (got[7].cost, got[7].audit, got[7].repaired_sha256, got[7].illegal) == (cost, audit, m.sha("\n".join(lines)), whole.illegal)
    assert (got[8].cost, got[8].audit) == (2, "KI") and got[7].duplicate >= 1999
    pieces = m.repaired(m.faults(df), 50).where("conv_id = 7").orderBy("seq").collect()
    assert len(pieces) > 20 and not any(p.whole for p in pieces)
    assert "\n".join(p.repaired for p in pieces if p.lines) == "\n".join(lines) and "".join(p.audit for p in pieces) == audit and sum(p.cost for p in pieces) == cost


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a.", "b", None, ""])) for c in [None, *range(60)] for t in [None, *range(4)]]
    rows += rows[:9]
    table = [(*r, "x", 1) for r in rows]
    spark.createDataFrame(table, DDL + ", audit string, gaps int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLS) for r in m.op11_conversations(spark, str(tmp_path)).collect()}
    hurt = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " " if role is None else role, " " if text is None else text
        if code:
            hurt[c].append((turn, "user" if code == 4 else role, "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text, 2 if code == 3 else 1))
    merged = {}
    for c, rs in hurt.items():
        for turn, role, text, n in rs:
            merged.setdefault(c, {}).setdefault((turn, role, text), 0)
            merged[c][turn, role, text] += n
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: plain([(*k, n) for k, n in merged[c].items()]) if c in merged else empty for c in hurt}
    assert got == want
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert m.op11_conversations(spark, f"{tmp_path}/none").count() == 0
    gone = [(c, t) for c in range(2000) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    spark.createDataFrame([(c, t, "user", "x") for c, t in gone], DDL).write.parquet(f"{tmp_path}/gone/conversations.parquet")
    assert {tuple(r)[1:] for r in m.op11_conversations(spark, f"{tmp_path}/gone").collect()} == {empty}
