"""Joins and dedups against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest

from lumenweave.llm import op4_line_dedup as op4
from lumenweave.llm import op10_ngram_join as op10
from lumenweave.llm.common import components, shingle_sets, written
from lumenweave.llm.families import family_links
from lumenweave.llm.op6_exact_dedup import exact_dedup
from lumenweave.llm.op7_embedding_dedup import near_duplicate_vectors


def labels(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    want = labels(341, edges)
    got = {x.node: x.component for x in components(df).collect()}
    assert all(got.get(i, i) == want[i] for i in range(341))
    assert components(df.limit(0)).count() == 0


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=3, n=260, hot=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    some = lambda k: [r.choice(words) for _ in range(k)]
    passage = some(60)
    texts = [None, "", "  \t\n", "one", "One", "one two", "a b c d", "a b c d e", "a b c d e f", "A b c d e"]
    for _ in range(n):
        texts.append(" ".join(some(r.choice([5, 6, 7, 8, 9, 12, 20, 40, 90, 200, 700]))))
    for _ in range(n):
        t = r.choice(texts[10:]).split()
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.5:
            t += some(r.randrange(1, 2 + len(t) // 4))
        texts.append(" ".join(t))
    for _ in range(hot):  # one passage in many documents, some hardly more than that
        a = some(r.choice([0, 1, 3, 5, 10, 20, 60, 300]))
        texts.append(" ".join([*a, *passage, *some(r.choice([0, 1, 2, 4, 8]))]))
    base = some(150)
    for _ in range(hot):  # a large group of near copies
        t = list(base)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    texts += [texts[30]] * 25
    return texts


def test_shingle_sets_sizes():
    texts = corpus()
    for t, h in zip(texts, shingle_sets([(t or "").encode() for t in texts])):
        assert len(h) == len(shingle_set(t))


@pytest.mark.parametrize("cold", [2, 16])
def test_ngram_join(spark, cold):
    texts = corpus()
    sets = [shingle_set(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = labels(len(texts), edges)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(7)
    got = {x.doc_id: x for x in op10.ngram_components(df, cold).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_ngram_join_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (7, "A B C D E F")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.component_id) for x in op10.ngram_components(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 2), ("7", 1), ("None", None)]
    assert op10.ngram_components(df.limit(0)).count() == 0


def test_allocation_never_misses():
    r = np.random.default_rng(1)
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 30, 64, 130, 400]:
        for _ in range(40):
            a = np.unique(r.integers(0, 1 << 64, size, dtype=np.uint64))
            most = len(a) // 7 if len(a) > 6 else 1
            drop = r.integers(0, most + 1)
            b = np.unique(np.concatenate((np.delete(a, r.choice(len(a), min(drop, len(a) - 1), replace=False)), r.integers(0, 1 << 64, r.integers(0, most + 1), dtype=np.uint64))))
            same = len(np.intersect1d(a, b))
            if 4 * same < 3 * (len(a) + len(b) - same):
                continue
            (s, x), (t, y) = op10.signatures(a), op10.signatures(b)
            found = len(np.intersect1d(s, t)) > 0
            assert found or (x <= 0 and y <= 0 and len(np.intersect1d(op10.singles(a), op10.singles(b))))


def test_exact_dedup(spark):
    texts = ["A b", "a B", None, "", "É", "é", "x" * 200000, "X" * 200000] + ["hot"] * 50
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(57, "hot", "z"), (None, "solo", "z"), (None, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t, _ in rows:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i is not None and i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    got = [tuple(x) for x in exact_dedup(df, runs=5, fan_in=2).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup(df.limit(0)).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = [r.standard_normal(24) for _ in range(300)]
    x += [x[r.integers(0, 300)] + r.standard_normal(24) * r.choice([0.05, 0.2, 0.33, 0.45]) for _ in range(250)]
    hot = r.standard_normal(24)
    x += [hot * r.uniform(0.1, 9) + r.standard_normal(24) * 0.1 for _ in range(120)] + [x[0], x[0] * 1e-200, x[0] * 1e200]
    rows = [(i, [float(v) for v in y], 0) for i, y in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0] * 5]
    rows += [(n + i, y, 0) for i, y in enumerate(odd)]
    u = np.array([y / np.abs(y).max() for y in x])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    want = labels(n, list(zip(*np.nonzero(s))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, tile int").repartition(3)
    got = {r.vec_id: r for r in near_duplicate_vectors(df, tile=100).collect()}
    assert [got[i].n_links for i in range(n)] == s.sum(1).tolist()
    assert [got[i].component_id for i in range(n)] == want
    assert all(got[n + i].component_id == n + i and got[n + i].n_links == 0 and got[n + i].kept for i in range(len(odd)))
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_line_dedup(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    base = [" ".join(word() for _ in range(r.choice([1, 2, 8, 20, 60]))) for _ in range(150)]
    docs = [(0, None, 1), (1, "", 1), (2, " \n\t\n", 1)]
    for i in range(3, 120):
        lines = []
        for _ in range(r.randrange(1, 8)):
            x = list(r.choice(base))
            if r.random() < 0.6 and len(x) > 30:
                x[r.randrange(len(x))] = "z"
            lines.append(("  " if r.random() < 0.2 else "") + "".join(x).replace("a", "A", 1) + ("\r" if r.random() < 0.2 else ""))
        docs.append((i, "\n".join([*lines, "the hot line of them all"]), 1))
    docs.append(docs[5])
    df = spark.createDataFrame(docs, "doc_id long, text string, line int").repartition(4)
    place = {}
    for i, t, _ in dict.fromkeys(docs):
        for k, x in enumerate((t or "").split("\n")):
            x = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\r"))
            if x:
                place.setdefault(x, []).append((i, k))
    lines = list(place)
    sure = [(a, b) for a in range(len(lines)) for b in range(a) if op4.jaccard(lines[a], lines[b]) >= op4.THRESHOLD]
    want = labels(len(lines), sure)
    # recall of the banding on pairs, then the result, which a missed pair need not change
    got = {x.key: x.component for x in op4.line_components(df).collect()}
    keys = [op4.line_key(x) for x in lines]
    linked = [got.get(keys[a], keys[a]) == got.get(keys[b], keys[b]) for a, b in sure]
    assert sum(linked) >= 0.98 * len(linked)
    assert all(want[a] == want[b] for a in range(len(lines)) for b in range(a) if got.get(keys[a], keys[a]) == got.get(keys[b], keys[b]))
    out = {x.doc_id: x for x in op4.per_document(df).collect()}
    assert len(out) == 120 and out[0].n_lines == out[1].n_lines == out[2].n_lines == 0
    assert sum(x.n_kept for x in out.values()) == len({got.get(k, k) for k in keys})
    assert sum("the hot line" in (x.text or "") for x in op4.clean_documents(df).distinct().collect()) == 1
    assert op4.per_document(df.limit(0)).count() == 0


def template_lines(n=60, seed=6):
    """Lines under one boilerplate, mutually below the threshold, each with a near copy."""
    r = random.Random(seed)
    some = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    head, lines = some(160), []
    for _ in range(n):
        tail = some(36)
        lines += [head + tail, head + tail[:-6] + some(6)]
    return lines


def test_line_dedup_completes_hot_buckets(spark):
    lines = template_lines()
    sure = [(a, b) for a in range(len(lines)) for b in range(a) if op4.jaccard(lines[a], lines[b]) >= op4.THRESHOLD]
    assert len(sure) == len(lines) // 2  # each with its own copy only
    want = labels(len(lines), sure)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(5)
    got = {x.key: x.component for x in op4.line_components(df).collect()}
    keys = [op4.line_key(x) for x in lines]
    assert len({got.get(k, k) for k in keys}) == len(set(want))
    assert all(got.get(keys[a], keys[a]) == got.get(keys[b], keys[b]) for a, b in sure)


def test_more_edges_go_through_joined_components_only(spark, monkeypatch):
    r = random.Random(6)
    first = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    more = [(r.randrange(240), r.randrange(240)) for _ in range(25)] + [(310, 320), (305, 410), (420, 410), (7, 7)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    nodes = []

    def counted(edges):
        out = components(edges)
        nodes.append(out.count())
        return out

    comp = components(frame(first))
    monkeypatch.setattr(op4, "components", counted)
    rows = op4.joined_components(comp, frame(more)).collect()
    got, want = {x.node: x.component for x in rows}, labels(421, first + more)
    assert len(rows) == len(got) and all(got.get(i, i) == want[i] for i in range(421))
    assert len(nodes) == 1 and nodes[0] <= 2 * len(more)
    none = {x.node: x.component for x in op4.joined_components(comp, frame(more[:0])).collect()}
    assert none == {x.node: x.component for x in comp.collect()}


def test_line_dedup_goes_through_stars_once(spark, monkeypatch):
    """What hot buckets add does not send the components that there are through the rounds again."""
    lines, given = template_lines(), []

    def counted(edges):
        given.append(edges.count())
        return components(edges)

    monkeypatch.setattr(op4, "components", counted)
    own = [f"line of its own, number {i // 2}, {hashlib.sha256(str(i // 2).encode()).hexdigest()}{'.' * (i % 2)}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate([*lines, *own])), "doc_id long, text string").repartition(4)
    assert len({x.component for x in op4.line_components(df).collect()}) >= 300
    assert len(given) == 2 and given[1] < 600


def test_line_dedup_writes_places_after_the_signatures_have_gone(spark, monkeypatch):
    names, dropped = [], []

    def noted(df, name, *args):
        names.append(name)
        return written(df, name, *args)

    monkeypatch.setattr(op4, "written", noted)
    monkeypatch.setattr(op4, "drop_path", lambda spark, *paths: dropped.append((len(names), [p.rsplit("/", 1)[1] for p in paths])), raising=False)
    df = spark.createDataFrame(list(enumerate(template_lines(12))), "doc_id long, text string")
    assert op4.per_document(df).count() == 24
    assert names.index("lines") > names.index("linked") > names.index("texts")
    assert dropped == [(names.index("lines"), ["pairs", "pairs", "texts"])]


def test_hot_lines_are_joined_exactly(spark):
    r = random.Random(8)
    lines = template_lines(20) + ["short", "shorter line", "shorter lines"]
    for _ in range(150):
        x = list(r.choice(lines))
        for _ in range(r.randrange(0, 4)):
            x[r.randrange(len(x))] = r.choice("xyz")
        lines.append("".join(x[r.randrange(0, 3) : len(x) - r.randrange(0, 9)]) or "x")
    lines = list(dict.fromkeys(lines))
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "key long, c long, line string")
    got = [(x.a, x.b) for x in family_links(op4._sets(df), 3, 4, tile=16).collect()]
    sure = [(a, b) for a in range(len(lines)) for b in range(a) if op4.jaccard(lines[a], lines[b]) >= op4.THRESHOLD]
    assert sure and labels(len(lines), got) == labels(len(lines), sure)


@pytest.mark.parametrize("n", [190, 600])
def test_line_dedup_finds_families_of_mutants(spark, n):
    r = random.Random(n)
    lines = ["".join(r.choice("abcdefghij klmnopq") for _ in range(80)).strip()]
    while len(lines) < n:  # a random tree of mutants, each at 0.75 or more from its parent
        x = list(r.choice(lines))
        x[r.randrange(len(x))] = r.choice("rstuvwxyz")
        if len(x := "".join(x)) and x not in lines:
            lines.append(x)
    sure = [(a, b) for a in range(n) for b in range(a) if op4.jaccard(lines[a], lines[b]) >= op4.THRESHOLD]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {x.key: x.component for x in op4.line_components(df).collect()}
    keys = [op4.line_key(x) for x in lines]
    linked = [got.get(keys[a], keys[a]) == got.get(keys[b], keys[b]) for a, b in sure]
    assert sum(linked) >= 0.98 * len(linked)


def test_line_dedup_odd_rows(spark):
    long = "Ab c" * 60_000
    rows = [(None, "the line of a row without an id", 0), (3, long, 0), (4, f"x\n{long.lower()}", 0), (5, "É É É É É É É É", 0), (6, "é é é é é é é é", 0), (7, "twice\nTWICE", 0), (7, "another text", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = sorted((str(x.doc_id), x.n_lines, x.kept_lines) for x in op4.per_document(df).collect())
    assert got == [("3", 1, "0"), ("4", 2, "0"), ("5", 1, "0"), ("6", 1, "0"), ("7", 1, "0"), ("7", 2, "0"), ("None", 1, "0")]


def test_line_dedup_links_short_lines(spark):
    r = random.Random(10)
    some = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    pairs = []
    for k in (1, 2, 3, 4):  # 7 * k shingles each, of which all but k are shared: Jaccard 0.75
        for _ in range(100):
            x = some(7 * k)
            tail = some(7 - k)
            pairs.append((x + tail + "1" * k, x + tail + "2" * k))
    for _ in range(50):  # a short line and one over SHORT shingles, and one that repeats few shingles often
        x = some(38)
        pairs.append((x, x + some(8)))
        y = some(12)
        pairs.append((y * 9, y * 7 + some(3)))
    assert all(op4.jaccard(a, b) >= op4.THRESHOLD for a, b in pairs)
    lines = [x for p in pairs for x in p]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {x.key: x.component for x in op4.line_components(df).collect()}
    missed = [len(a) for a, b in pairs if got.get(op4.line_key(a), 0) != got.get(op4.line_key(b), 1)]
    assert not missed


def alternating(n, a, b):
    """The word of n letters in which a letter is b if its place has an odd number of ones."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_words_that_mirror_each_other_are_apart(spark, n):
    """Sums of powers of one base modulo 2**64 give such words one hash, whatever the base."""
    from lumenweave.llm.common import word_hashes

    one, two = alternating(n, "a", "b"), alternating(n, "b", "a")
    h, first = word_hashes([one.encode(), two.encode(), one.upper().encode(), f" {one}\t{two}\n".encode(), b"", b" \t"])
    assert h[0] != h[1] and h[0] == h[2] == h[3] and h[1] == h[4] and first.tolist() == [0, 1, 2, 3, 5, 5, 5]
    if n == 1024:
        rows = [(1, one), (2, two), (3, one.upper()), (4, f"x {one} y z u v"), (5, f"x {two} y z u v"), (6, f"X {one} y z u V")]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (2, 4), 5: (2, 5), 6: (2, 4)}


def test_word_hashes_do_not_depend_on_the_place():
    from lumenweave.llm.common import word_hashes

    r = random.Random(9)
    words = ["".join(r.choice("abcé漢x") for _ in range(r.choice([1, 3, 63, 64, 65, 300]))) for _ in range(200)]
    alone = [int(word_hashes([w.encode()])[0][0]) for w in words]
    together = word_hashes([" ".join(words[:77]).encode(), "\n".join(words[77:]).encode()])
    assert together[0].tolist() == alone and together[1].tolist() == [0, 77, 200] and len(set(alone)) == len(set(words))


def test_vectors_with_null_and_repeated_ids(spark):
    one, near, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 5.0]
    rows = [(None, one), (None, near), (4, one), (4, far), (7, near), (9, far), (9, far), (11, [-1.0, 0.0, 0.0]), (12, None)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=2).collect())
    # 4 links with 7 once and with both of 9; each of 9 with the other and with 4
    assert got == sorted([("None", 0, "None", True)] * 2 + [("4", 3, "4", True)] * 2 + [("7", 1, "4", False)] + [("9", 4, "4", False)] * 2 + [("11", 0, "11", True), ("12", 0, "12", True)])


def test_vector_tiles_are_not_shuffled_to_their_pairs(spark, monkeypatch):
    """What is shuffled grows with the vectors, not with their tiles; the vectors' links stay those of all pairs. Failed while each tile was sent to each other one."""
    from lumenweave.llm import op7_embedding_dedup as op7

    rng = np.random.default_rng(3)
    x = rng.standard_normal((240, 16))
    x[120:] = x[:120] + 0.1 * rng.standard_normal((120, 16))
    x[:200] = x[:200].astype(np.float32)  # tiles of either precision
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = ((u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)).sum(1)
    plans, made = [], op7.written
    monkeypatch.setattr(op7, "written", lambda df, name, *a: (name == "links" and plans.append(df._jdf.queryExecution().executedPlan().toString()), made(df, name, *a))[1])
    got = op7.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), tile=16)
    assert {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(links.tolist()))
    assert len(plans) == 1 and "CartesianProduct" in plans[0] and "hashpartitioning" not in plans[0]


def test_packed_vectors_keep_every_bit():
    from lumenweave.llm.op7_embedding_dedup import packed_vectors, unpacked_vectors

    for x, size in ((np.array([[0.5, -3.0], [1e-3, 0.1]], np.float32).astype(np.float64), 4), (np.array([[0.1, 1.0]]), 8), (np.array([[1e300, 1e-300]]), 8)):
        data = packed_vectors(x)
        assert len(data) == size * x.size and (unpacked_vectors(data, *x.shape) == x).all()


def test_rounds_of_small_graphs_take_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint"))
        assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(21)}
        assert got.rdd.getNumPartitions() < 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from lumenweave.llm.common import written

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    df, _ = written(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    end = time.time() + 5
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and df.count() == 7 and spark.conf.get(key, None) == was
