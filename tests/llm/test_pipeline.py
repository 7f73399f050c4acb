"""The pipeline's stages against plain Python on a small fixture."""

import hashlib
import random
import re

import numpy as np

import corpus_pipeline as cp


def test_pipeline(spark, tmp_path):
    r = random.Random(7)
    syllables = ["an", "the", "er", "ti", "on", "re", "st", "sh"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = [prose(r.choice([30, 80, 200])) for _ in range(150)]
    junk = [" ".join(f"{word().upper()}!!" for _ in range(80)) for _ in range(20)] + [" | ".join(word() for _ in range(90)) for _ in range(20)] + [None, ""]
    exact = [t.upper() if i % 2 else t for i, t in enumerate(texts[:20])]
    near = [t[: len(t) - 6] + " change" for t in texts[20:40] if len(t) > 500]
    every = [t for t in [*texts, *junk, *[e for e in exact if not e.isupper()], *near]]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(every)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == cp.COLUMNS
    kept = {x.doc_id for x in seen["quality"]}
    assert kept >= set(range(150)) and not kept & set(range(150, 150 + len(junk)))
    best = {}
    for x in seen["quality"]:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), x.text)
        best[key] = max(best.get(key, -1), x.doc_id)
    assert {x.doc_id for x in seen["exact_dedup"]} == set(best.values())
    sets = {x.doc_id: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})(x.text.lower().split()) for x in seen["exact_dedup"]}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {x.doc_id for x in seen["near_dedup"]} == {i for i in ids if find(i) == i}
    times = {}
    for x in seen["mixing"]:
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    assert set(times) <= {x.doc_id for x in seen["near_dedup"]} and set(times.values()) <= {1, 2}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {x.doc_id: x.text for x in seen["mixing"]}
    assert len(seen["bpe"]) == len(seen["mixing"])
    for x in seen["bpe"]:
        e = t.encode(text[x.doc_id], add_special_tokens=False).ids
        assert x.n_tokens == len(e) and x.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
    assert {x.doc_id for x in cp.run(spark, str(tmp_path)).collect()} == set(times)


def test_pipeline_stages_tell_rows_apart(spark, tmp_path):
    """Null and repeated ids, ties, nulls in every column and an empty table."""
    r = random.Random(3)
    prose = lambda: " ".join("".join(r.choice(["an", "the", "er", "ti"]) for _ in range(r.randrange(1, 4))) for _ in range(60)).capitalize() + "."
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a), (5, b), (5, a.upper()), (9, a), (9, a), (9, a.lower()), (None, c), (None, c), (None, a), (None, d), (7, e), (7, d)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(x.doc_id), x.text) for x in cp.exact(spark, df, "").collect())
    assert got == sorted([("9", min(a, a.lower())), ("5", b), ("None", c), ("7", d), ("7", e)])
    one = spark.createDataFrame([(None, a), (None, b), (3, c), (3, d), (4, c)], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "1L n_chars")
    assert sorted((str(x.doc_id), x.text) for x in cp.near(spark, one, "").collect() if x.doc_id is None) == sorted([("None", a), ("None", b)])
    kept = {x.doc_id for x in cp.near(spark, one, "").collect()}
    assert kept >= {None, 3}
    mixed = cp.mix(spark, one, "").collect()
    assert {x.text for x in mixed} == {a, b, c, d} and {x.doc_id for x in mixed} == {None, 3, 4}
    assert len(cp.tokens(spark, one, "").collect()) == 5
    for name, stage in cp.STAGES:
        assert stage(spark, one.limit(0), "").count() == 0, name
