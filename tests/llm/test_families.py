"""Links within hot families against brute force."""

import contextlib
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError

from lumenweave.llm import buckets
from lumenweave.llm import op10_ngram_join as op10
from lumenweave.llm.families import family_links, intersections
from tests.llm.test_pairs import labels, shingle_set


def family(r, n, size, changes, base):
    """Sets that are a base with some elements changed, mutually about the threshold."""
    fresh = iter(range(base + 10_000, base + 10_000_000))
    core = list(range(base, base + size))
    out = []
    for _ in range(n):
        x = set(core)
        for t in r.sample(core, r.choice(changes)):
            x.discard(t)
            x.add(r.choice([next(fresh), base + 5000 + r.randrange(40)]))
        out.append(frozenset(x))
    return out


@pytest.mark.parametrize(("tile", "square"), [(7, 2), (7, 16), (256, 16)])
def test_family_links_join_what_brute_force_joins(spark, tile, square):
    r = random.Random(tile)
    sets = family(r, 120, 60, [2, 4, 6, 8, 9, 10], 0) + family(r, 60, 35, [0, 1, 3, 5, 6], 10**8)
    passage = list(range(2 * 10**8, 2 * 10**8 + 80))
    sets += [frozenset([*passage, *(3 * 10**8 + 1000 * i + k for k in range(r.randrange(0, 30)))]) for i in range(80)]  # one passage and words of its own
    sets += [frozenset(range(4 * 10**8, 4 * 10**8 + k)) for k in range(1, 40)]
    start = [r.choice([i, i, i, i - i % 3]) for i in range(len(sets))]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    given = [(i, c) for i, c in enumerate(start) if i != c]
    comp = labels(len(sets), given)
    df = spark.createDataFrame([(i, comp[i], sorted(s)) for i, s in enumerate(sets)], "id long, c long, h array<long>").repartition(5)
    got = [(x.a, x.b) for x in family_links(df, tile=tile, square=square).collect()]
    assert labels(len(sets), given + got) == labels(len(sets), given + edges)
    assert family_links(df.limit(0)).count() == 0


def shuffled_records(spark, run):
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    out = run()
    sc.listenerBus().waitUntilEmpty(10_000)
    n = 0
    for stage in range(first, sc.dagScheduler().nextStageId()):
        with contextlib.suppress(Py4JJavaError):  # a stage that was skipped
            n += sc.statusStore().lastStageAttempt(stage).shuffleWriteRecords()
    return n, out


@pytest.mark.parametrize(("broadcast", "most"), [(1_000_000, 0.5), (0, 2.5)])
def test_families_do_not_shuffle_each_element_again_and_again(spark, monkeypatch, broadcast, most):
    monkeypatch.setattr(buckets, "BROADCAST_IDS", broadcast)
    sets = family(random.Random(5), 200, 300, [0, 20, 40, 41, 45], 0)
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    # the first set's row comes twice
    df = spark.createDataFrame([(i, i, sorted(s)) for i, s in [(0, sets[0]), *enumerate(sets)]], "id long, c long, h array<long>").coalesce(4)
    n, got = shuffled_records(spark, lambda: [(x.a, x.b) for x in family_links(df).collect()])
    assert labels(len(sets), got) == labels(len(sets), edges)
    assert n < most * sum(map(len, sets))


def test_intersections():
    r = np.random.default_rng(1)
    xs = [np.unique(r.integers(0, 300, n)) for n in (1, 5, 80, 200)]
    ys = [np.unique(r.integers(100, 400, n)) for n in (3, 150)]
    want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert intersections(xs, ys).tolist() == want
    own = intersections(xs, None)
    assert all(own[i, j] == len(np.intersect1d(xs[i], xs[j])) for i in range(4) for j in range(4) if i != j)


def test_ngram_join_near_copies_below_the_threshold(spark):
    r = random.Random(12)
    base = [f"w{r.randrange(5000)}" for _ in range(90)]
    texts = []
    for _ in range(1200):
        t = list(base)
        for _ in range(r.choice([1, 2, 2, 3, 3, 3])):
            t[r.randrange(len(t))] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(t))
    sets = [shingle_set(t) for t in texts]
    names = {}
    rows = [np.array(sorted(names.setdefault(s, len(names)) for s in one)) for one in sets]
    n = intersections(rows, None)
    size = np.array([len(s) for s in rows])
    link = 7 * n >= 3 * (size[:, None] + size[None, :])
    want = labels(len(texts), list(zip(*np.nonzero(np.triu(link, 1)))))
    assert len(set(want)) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: x.component_id for x in op10.ngram_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
