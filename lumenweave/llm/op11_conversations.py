"""Repair of the role structure of conversations by shortest paths with small integer costs.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its rows are the layers of a graph whose nodes are (row, state of
that expression's automaton); edits are arcs: Keep costs 0, Rerole 2, Delete 3, Insert 2 (it stays in the layer), and a truncated
row that is not deleted adds 1. Dial's bucket queue settles the nodes by distance to the goal, from the last row backwards; then
a walk from the first row takes, of the arcs that are tight, the least in ASCII order of their initials. Blank and repeated
rows must go: they are deleted in place and are no layers.

Rows are dealt by range of (conversation, turn), so a conversation of any length is spread over tasks. A conversation that lies
within a task's rows is solved there. One that reaches a task's edge, or is longer than ``PIECE_ROWS`` or ``PIECE_BYTES``, becomes
pieces: each gives the distances between its four entry and exit states, these are combined from the last piece to
the first, which tells each piece the distances behind it, and from the first to the last, which tells its entry state. Only one small row a
piece meets in a task. The repaired text of a conversation is one digest, a chain by nature, so its pieces stream through one task
in order, without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read_table, small_batches, written

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
NEXT = (2, 2, 3, 2)  # the state after an inserted or reroled row
MADE = ("user", "user", "assistant", "user")  # and that row's role, by the state before it
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = "sua"
FAR = 1 << 40
GOAL = (0, 2 * INSERT, INSERT, 0)  # what each state still costs behind the last row
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
PIECE = "conv_id bigint, seq bigint, illegal bigint, first string, last string, cost bigint, audit string, lines bigint, repaired string, costs array<bigint>, deleted bigint, roles array<string>, texts array<string>, must array<boolean>, cut array<boolean>, n array<bigint>"


# --- one conversation --------------------------------------------------------------------------------------


def symbol(role: str, cut: bool) -> int:
    """What the graph needs to know of a row: which initial its role has, and whether its text is truncated."""
    return (ROLES.find(role[0]) if role and role[0] in ROLES else 3) + 4 * cut


@lru_cache(1 << 15)
def distances(symbols: bytes, goal: tuple = GOAL) -> tuple:
    """Distance of every (layer, state) to the goal, by a bucket queue; ``goal`` is what the states behind the last row cost."""
    m = len(symbols)
    out = [[FAR] * 4 for _ in range(m + 1)]
    base = min(goal)
    width = max(DELETE, REROLE + CUT, *(g - base for g in goal if g < FAR)) + 1
    buckets: list[list] = [[] for _ in range(width)]
    waiting = 0
    for q, g in enumerate(goal):
        if g < FAR:
            out[m][q] = g
            buckets[(g - base) % width].append((m, q))
            waiting += 1
    d = base
    while waiting:
        bucket = buckets[(d - base) % width]
        while bucket:
            i, q = bucket.pop()
            waiting -= 1
            if out[i][q] != d:
                continue
            before = []
            if i < m:
                before += [(i, p, INSERT) for p in range(4) if NEXT[p] == q]
            if i:
                c, cut = symbols[i - 1] & 3, CUT * (symbols[i - 1] >> 2)
                before.append((i - 1, q, DELETE))
                before += [(i - 1, p, REROLE + cut) for p in range(4) if NEXT[p] == q]
                if c < 3:
                    before += [(i - 1, p, cut) for p in range(4) if KEPT[p].get(ROLES[c]) == q]
            for j, p, cost in before:
                if d + cost < out[j][p]:
                    out[j][p] = d + cost
                    buckets[(d + cost - base) % width].append((j, p))
                    waiting += 1
        d += 1
    return tuple(map(tuple, out))


@lru_cache(1 << 15)
def walk(symbols: bytes, goal: tuple = GOAL, state: int = 0) -> tuple[tuple[str, ...], int]:
    """The cheapest edits, least in ASCII order, as the letters spent on each row, and the state behind the last row."""
    dist, q, out = distances(symbols, goal), state, []
    for i, s in enumerate(symbols):
        c, cut, said = s & 3, CUT * (s >> 2), ""
        while True:
            here = dist[i][q]
            kept = KEPT[q].get(ROLES[c]) if c < 3 else None
            if here == DELETE + dist[i + 1][q]:
                said += "D"
            elif here == INSERT + dist[i][NEXT[q]]:
                said, q = said + "I", NEXT[q]
                continue
            elif kept is not None and here == cut + dist[i + 1][kept]:
                said, q = said + "K", kept
            else:
                said, q = said + "R", NEXT[q]
            break
        out.append(said)
    return tuple(out), q


def between(symbols: bytes) -> list[int]:
    """The 16 distances from each entry state to each exit state."""
    to = [distances(symbols, tuple(0 if q == e else FAR for q in range(4)))[0] for e in range(4)]
    return [to[e][q] for q in range(4) for e in range(4)]


class Rows:
    """Consecutive rows of one conversation; ``n`` equal rows count as one with n - 1 that must go."""

    def __init__(self, roles: list[str], texts: list[str], must: list[bool], cut: list[bool], n: list[int]):
        self.roles, self.texts, self.must, self.cut, self.n = roles, texts, must, cut, n

    @property
    def symbols(self) -> bytes:
        return bytes(symbol(r, c) for r, c, m in zip(self.roles, self.cut, self.must) if not m)

    @property
    def deleted(self) -> int:
        return sum(k - 1 + m for k, m in zip(self.n, self.must))

    @property
    def illegal(self) -> int:
        first = [r[:1] for r in self.roles]
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])) + sum(self.n) - len(self.n)

    def repaired(self, edits: Iterable[str], state: int) -> tuple[str, list[str]]:
        """All letters, those of the rows that must go included, and the lines that are left."""
        edits, letters, lines, q = iter(edits), [], [], state
        for role, text, must, n in zip(self.roles, self.texts, self.must, self.n):
            for x in "" if must else next(edits):
                if x == "K":
                    lines.append(f"{role}:{text}")
                    q = KEPT[q][role[0]]
                elif x != "D":
                    lines.append(f"{MADE[q]}:{text if x == 'R' else ''}")
                    q = NEXT[q]
                letters.append(x)
            letters.append("D" * (n - 1 + must))
        return "".join(letters), lines


def tail(state: int) -> list[str]:
    """The lines that must be inserted behind the last row."""
    lines = []
    while GOAL[state]:
        lines.append(f"{MADE[state]}:")
        state = NEXT[state]
    return lines


def solve(rows: Rows) -> tuple[int, str, list[str]]:
    """Cost, audit and repaired lines of a whole conversation."""
    edits, q = walk(rows.symbols)
    audit, lines = rows.repaired(edits, 0)
    return distances(rows.symbols)[0][0] + DELETE * rows.deleted, audit + "I" * len(tail(q)), lines + tail(q)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- tables ------------------------------------------------------------------------------------------------


def has_letter(text: Column) -> Column:
    """Whether something but white space is there."""
    return F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", "")) > 0


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, n, tie) with blank, seen (a row of an earlier turn has this role and text) and cut (truncated).

    ``rows`` has (conv_id, turn, role, text, copies); equal rows are summed before anything is dealt by conversation.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    tie = F.sha2("text", 256)
    one, _ = written(one.withColumns({"tie": tie, "same": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)}), "distinct-rows")
    again = one.groupBy("conv_id", "same").agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("conv_id_"), F.col("same").alias("same_"), F.col("least.turn").alias("turn_"), F.lit(True).alias("known"))
    out = one.join(again, F.col("same").eqNullSafe(F.col("same_")) & F.col("conv_id").eqNullSafe(F.col("conv_id_")), "left")
    blank = ~has_letter(F.col("text"))
    seen = F.coalesce(F.col("known"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("turn_"))
    end = F.right(F.rtrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d")), F.lit(1))
    return out.select("conv_id", "turn", "role", "text", "n", "tie", blank.alias("blank"), (seen & ~blank).alias("seen"), (~blank & ~seen & ~end.isin(".", "!", "?")).alias("cut"))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_LONG, _TEXT = pa.int64(), pa.string()
_PIECE = pa.schema([("conv_id", _LONG), ("seq", _LONG), ("illegal", _LONG), ("first", _TEXT), ("last", _TEXT), ("cost", _LONG), ("audit", _TEXT), ("lines", _LONG), ("repaired", _TEXT), ("costs", pa.list_(_LONG)), ("deleted", _LONG), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT)), ("must", pa.list_(pa.bool_())), ("cut", pa.list_(pa.bool_())), ("n", pa.list_(_LONG))])
_EMPTY = dict.fromkeys(("cost", "audit", "lines", "repaired", "costs", "deleted", "roles", "texts", "must", "cut", "n"))


def _pieces(batches: Iterator[pa.RecordBatch], piece_rows: int, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Solved conversations and pieces of others, from a task's rows in order."""
    part, count, out, out_bytes = TaskContext.get().partitionId(), 0, [], 0
    cols: list[list] = [[] for _ in range(5)]
    conv, size, whole = None, 0, False  # whole: the conversation began within this task's rows, and nothing of it has left yet

    def close(open_end: bool) -> None:
        nonlocal count, cols, size, out_bytes
        if not cols[0]:
            return
        rows = Rows(*cols)
        row = _EMPTY | {"conv_id": conv, "seq": part << 32 | count, "illegal": rows.illegal, "first": rows.roles[0][:1], "last": rows.roles[-1][:1]}
        if whole and not open_end:
            cost, audit, lines = solve(rows)
            row |= {"cost": cost, "audit": audit, "lines": len(lines), "repaired": "\n".join(lines)}
        else:
            row |= {"costs": between(rows.symbols), "deleted": rows.deleted, "roles": rows.roles, "texts": rows.texts, "must": rows.must, "cut": rows.cut, "n": rows.n}
        out_bytes += size
        out.append(row)
        count, cols, size = count + 1, [[] for _ in range(5)], 0

    begun = False
    for batch in batches:
        ids, roles, texts, must, cut, n = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "must", "cut", "n"))
        for i, x in enumerate(ids):
            if not begun or x != conv:
                close(False)
                whole, conv, begun = begun, x, True
            elif len(cols[0]) >= piece_rows or size >= piece_bytes:
                close(True)
                whole = False
            for c, v in zip(cols, (roles[i], texts[i], must[i], cut[i], n[i])):
                c.append(v)
            size += len(texts[i])
            if len(out) >= 2000 or out_bytes >= piece_bytes:
                yield _batch(out, _PIECE)
                out, out_bytes = [], 0
    close(True)
    if out:
        yield _batch(out, _PIECE)


def _rows(r: dict) -> Rows:
    return Rows(r["roles"], r["texts"], r["must"], r["cut"], r["n"])


def _ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Each conversation's rows in one task, in order; a task streams them."""
    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _behind(batches):
    """From each conversation's last piece to its first: the distances that the states behind a piece have, and whether it is the last."""
    begun, conv, goal = False, None, GOAL
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            end = not begun or r["conv_id"] != conv
            if end:
                begun, conv, goal = True, r["conv_id"], GOAL
            out.append({"seq": r["seq"], "goal": list(goal), "ends": end})
            goal = tuple(min(r["costs"][4 * q + e] + goal[e] for e in range(4)) for q in range(4))
        yield _batch(out, pa.schema([("seq", _LONG), ("goal", pa.list_(_LONG)), ("ends", pa.bool_())]))


def _goal(g: list[int]) -> tuple:
    return tuple(x if x < FAR else FAR for x in g)


def _exits(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            symbols = Rows(r["roles"], [], r["must"], r["cut"], r["n"]).symbols
            out.append({"conv_id": r["conv_id"], "seq": r["seq"], "exits": [walk(symbols, _goal(r["goal"]), q)[1] for q in range(4)]})
        yield _batch(out, pa.schema([("conv_id", _LONG), ("seq", _LONG), ("exits", pa.list_(_LONG))]))


def _entries(batches):
    """From each conversation's first piece to its last: the state in which a piece is entered."""
    begun, conv, q = False, None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                begun, conv, q = True, r["conv_id"], 0
            out.append({"seq": r["seq"], "entry": q})
            q = r["exits"][q]
        yield _batch(out, pa.schema([("seq", _LONG), ("entry", _LONG)]))


_REPAIRED = pa.schema([("conv_id", _LONG), ("seq", _LONG), ("illegal", _LONG), ("first", _TEXT), ("last", _TEXT), ("cost", _LONG), ("audit", _TEXT), ("lines", _LONG), ("repaired", _TEXT)])
REPAIRED = "conv_id bigint, seq bigint, illegal bigint, first string, last string, cost bigint, audit string, lines bigint, repaired string"


def _repair(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows, goal = _rows(r), _goal(r["goal"])
            edits, leaves = walk(rows.symbols, goal, r["entry"])
            audit, lines = rows.repaired(edits, r["entry"])
            cost = distances(rows.symbols, goal)[0][r["entry"]] - goal[leaves] + DELETE * rows.deleted
            if r["ends"]:
                more = tail(leaves)
                audit, lines, cost = audit + "I" * len(more), lines + more, cost + GOAL[leaves]
            out.append({k: r[k] for k in ("conv_id", "seq", "illegal", "first", "last")} | {"cost": cost, "audit": audit, "lines": len(lines), "repaired": "\n".join(lines)})
        yield _batch(out, _REPAIRED)


_SOLVED = pa.schema([("conv_id", _LONG), ("illegal", _LONG), ("cost", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)])


def _joined(batches):
    """One row a conversation from its pieces in order; texts pass through the digest and are not kept."""
    begun, conv = False, None
    digest, audit, cost, illegal, last, lines = hashlib.sha256(), [], 0, 0, None, 0

    def row():
        return {"conv_id": conv, "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                out += [row()] if begun else []
                digest, audit, cost, illegal, last, lines = hashlib.sha256(), [], 0, 0, None, 0
                begun, conv = True, r["conv_id"]
            illegal += r["illegal"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
            if r["lines"]:
                digest.update(("\n" * bool(lines) + r["repaired"]).encode("utf-8", "surrogatepass"))
            audit.append(r["audit"])
            cost, last, lines = cost + r["cost"], r["last"], lines + r["lines"]
        if out:
            yield _batch(out, _SOLVED)
    if begun:
        yield _batch([row()], _SOLVED)


def repaired(table: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The repaired conversations of ``faults``' rows: REPAIRED and ``whole``. Most are one row; a long one, or one at a task's edge, comes in pieces in order of ``seq``, of which ``whole`` is false.

    cost, audit and repaired (``role:text`` of ``lines`` many lines) of a conversation are its pieces' together; illegal counts within a piece, and
    first and last are its rows' initials at either end.
    """
    spark = table.sparkSession
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("tie").asc()]
    dealt = table.withColumn("must", F.col("blank") | F.col("seen")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    pieces, _ = written(dealt.select("conv_id", "role", "text", "must", "cut", "n").mapInArrow(lambda batches: _pieces(batches, piece_rows, piece_bytes), PIECE), "conversations")
    open_ends = pieces.where("costs is not null")
    goals = _ordered(open_ends.select("conv_id", "seq", "costs"), F.col("seq").desc()).mapInArrow(_behind, "seq bigint, goal array<bigint>, ends boolean")
    goals, _ = written(goals, "goals")
    exits = open_ends.select("conv_id", "seq", "roles", "must", "cut", "n").join(goals, "seq").mapInArrow(_exits, "conv_id bigint, seq bigint, exits array<bigint>")
    entries = _ordered(exits, "seq").mapInArrow(_entries, "seq bigint, entry bigint")
    long = open_ends.join(goals, "seq").join(entries, "seq").mapInArrow(_repair, REPAIRED)
    names = _REPAIRED.names
    return pieces.where("costs is null").select(*names, F.lit(True).alias("whole")).union(long.select(*names, F.lit(False).alias("whole")))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation that has rows.

    ``rows`` has (conv_id bigint, turn bigint, role, text, copies): texts and roles not null; a null turn comes first, a null conv_id is one
    conversation. Rows of one turn come in order of role and of their text's SHA-256. Equal rows are
    told apart by nothing, so the first is judged and the others repeat it. An empty table gives none.
    """
    spark = rows.sparkSession
    small_batches(spark)
    table, _ = written(faults(rows), "faults")
    n, own = F.col("n"), F.when(F.col("blank"), 0)
    counts = table.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"), F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(own.otherwise(n - F.when(F.col("seen"), 0).otherwise(1))).alias("duplicate"), F.count_if("cut").cast("bigint").alias("truncated"),
    )
    made, _ = written(repaired(table, piece_rows, piece_bytes), "repaired")
    done = made.where("whole").select("conv_id", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    solved = "conv_id bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    found = done.union(_ordered(made.where("not whole"), "seq").mapInArrow(_joined, solved))
    found = found.withColumnRenamed("conv_id", "conv_id_")
    return counts.join(found, F.col("conv_id").eqNullSafe(F.col("conv_id_"))).drop("conv_id_")


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) damaged by their key's checksum; nulls count as one space, but a null conv_id or turn stays null beside it."""
    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("r"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text_of("role").alias("r"), text_of("text").alias("t"), code.alias("code"))
    return rows.where("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, its cheapest repair and the digest of what is left; one that lost all its rows has zeros, an empty audit and the digest of nothing."""
    table = read_table(spark, sf_dir, "conversations")
    every = table.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found = repair(damaged(table)).withColumnRenamed("conv_id", "conv_id_")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv_id_")), "left")
    number = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha(""))).alias("repaired_sha256"))


#: the last row of a conversation first; states 1 to 4 of the automaton are the four entries of ``f``, each (cost, edits, repaired lines)
SQL = r"""
with recursive
crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
raw as (select conv_id, turn, coalesce(role, ' ') as r, coalesce(text, ' ') as t,
               list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)) as k from conversations),
coded as (select conv_id, turn, r, t, xor(list_reduce(list_concat([4294967295], k), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as code from raw, crc),
hurt as (select conv_id, turn, case when code = 4 then 'user' else r end as role, case code when 1 then '' when 2 then translate(t, '.!?', '') else t end as text, unnest(range(case when code = 3 then 2 else 1 end)) as copy from coded where code <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, count(*) over (partition by conv_id) as m,
                  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
                  right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as final from hurt),
judged as materialized (select conv_id, turn, role, text, i, m, left(role, 1) as c, final = '' as blank, final <> '' and nth > 1 as dup, final <> '' and nth = 1 and final not in ('.', '!', '?') as cut,
                  lag(left(role, 1)) over (partition by conv_id order by i) as prev from placed),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated,
                  count(*) filter (i > 1 and prev || c not in ('su', 'ua', 'au')) as illegal, max(m) as m from judged group by conv_id),
f as (select conv_id, m as i, [{'d': 0, 's': '', 'o': []::varchar[]}, {'d': 4, 's': 'II', 'o': ['user:', 'assistant:']}, {'d': 2, 's': 'I', 'o': ['assistant:']}, {'d': 0, 's': '', 'o': []::varchar[]}] as f from counts
      union all
      select conv_id, i - 1, [g[1], g[2], g[3], g[4]] from (
        select conv_id, i, list_transform(range(1, 5), lambda q: list_sort(list_concat(
                 [h[q]],
                 [{'d': 2 + h[case q when 3 then 4 else 3 end].d, 's': 'I' || h[case q when 3 then 4 else 3 end].s, 'o': list_concat([case q when 3 then 'assistant:' else 'user:' end], h[case q when 3 then 4 else 3 end].o)}],
                 [{'d': 4 + h[case q when 3 then 3 else 4 end].d, 's': 'II' || h[case q when 3 then 3 else 4 end].s, 'o': list_concat(case q when 3 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end, h[case q when 3 then 3 else 4 end].o)}]))[1]) as g
        from (select f.conv_id, f.i, list_transform(range(1, 5), lambda q: case when blank or dup then {'d': 3 + f.f[q].d, 's': 'D' || f.f[q].s, 'o': f.f[q].o} else list_sort(list_concat(
                 [{'d': 3 + f.f[q].d, 's': 'D' || f.f[q].s, 'o': f.f[q].o}],
                 [{'d': 2 + cast(cut as int) + f.f[case q when 3 then 4 else 3 end].d, 's': 'R' || f.f[case q when 3 then 4 else 3 end].s, 'o': list_concat([case q when 3 then 'assistant:' else 'user:' end || text], f.f[case q when 3 then 4 else 3 end].o)}],
                 case when (q = 1 and c in ('s', 'u')) or (q in (2, 4) and c = 'u') or (q = 3 and c = 'a') then [{'d': cast(cut as int) + f.f[case c when 's' then 2 when 'u' then 3 else 4 end].d, 's': 'K' || f.f[case c when 's' then 2 when 'u' then 3 else 4 end].s, 'o': list_concat([role || ':' || text], f.f[case c when 's' then 2 when 'u' then 3 else 4 end].o)}] else [] end))[1] end) as h
              from f join judged j on j.conv_id is not distinct from f.conv_id and j.i = f.i))),
solved as (select conv_id, f[1] as x from f where i = 0)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(coalesce(x.d, 0) as bigint) as cost, coalesce(x.s, '') as audit, sha256(coalesce(array_to_string(x.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join counts c on c.conv_id is not distinct from e.conv_id left join solved s on s.conv_id is not distinct from e.conv_id
"""
