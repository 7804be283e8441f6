"""Near copies against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from rankwell.llm import common, components, nearcopies


def near(seed=3, groups=8, copies=14):
    """Copies of a few texts at similarities around 0.8, as fractions of changed words."""
    rng, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(600)]
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(60 + 30 * g)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


def brute(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    return comp


def test_equals_brute_force(spark):
    texts = dict(enumerate(near(), 10)) | {1: None, 2: "", 3: "One two", 4: "one TWO", 5: "one two three"}
    want = brute(texts)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got == want and want[2] == 1 and want[4] == 3 and want[5] == 5
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in left} == set(want.values()) and len(left) == len(set(want.values()))


def test_mixed_buckets_in_blocks(spark, monkeypatch):
    """Groups around 0.8 whose nodes stars leave in several components, with buckets compared whole and in blocks."""
    rng = random.Random(11)
    texts, vocab = {}, [f"v{i}" for i in range(900)]
    for g in range(3):
        base = [rng.choice(vocab) for _ in range(120)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[1000 - 30 * g - k] = " ".join(w)
    want, docs = brute(texts), spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert 3 < len(set(want.values())) < len(texts)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want


def test_repeated_and_null_ids(spark):
    a, b = near(groups=1, copies=1)[0], "quite another text of some more words than a shingle has"
    rows = [(1, a), (7, a), (7, b), (9, b), (None, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == {1: 1, 7: 1, 9: 1, None: None}
    assert sorted(str(r.doc_id) for r in nearcopies.keep_one(docs).collect()) == ["1", "None", "None"]


def test_more_ids_than_can_be_sent(spark, monkeypatch):
    """Texts are shuffled where ids are too many to send; the rows are the same."""
    monkeypatch.setattr(common, "fits", lambda *_: False)
    a, b = near(groups=1, copies=2)
    rows = [(4, a), (2, b), (3, "quite another text of some more words than a shingle has"), (3, "and one more"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute({4: a, 2: b})
    left = sorted(str(r.doc_id) for r in nearcopies.keep_one(docs).collect())
    assert left == sorted(map(str, [*set(want.values()), 3, None]))


def test_grid_of_fingerprints_links_without_bands(spark, monkeypatch):
    """With no band at all the grid join of fingerprints links the copies within 4 bits, if they are similar enough."""
    rng, vocab = random.Random(4), [f"u{i}" for i in range(900)]

    def changed(words, n):
        w = list(words)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return w

    def differing(a, b):
        x, y = (nearcopies.fingerprint(nearcopies.shingle_set(" ".join(w))) for w in (a, b))
        return ((x ^ y) & (1 << 64) - 1).bit_count()

    base = [rng.choice(vocab) for _ in range(600)]
    texts = {1: base} | {k: w for k in range(2, 30) if differing(base, w := changed(base, 1)) <= 4}
    # fingerprints within 4 bits, similarity below 0.8: no link
    while True:
        one = [rng.choice(vocab) for _ in range(100)]
        two = changed(one, 3)
        a, b = ({tuple(w[k : k + 5]) for k in range(96)} for w in (one, two))
        if differing(one, two) <= 4 and len(a & b) < 0.8 * len(a | b):
            break
    texts = {k: " ".join(w) for k, w in (texts | {50: one, 51: two}).items()}
    assert len(texts) > 15

    def none(batches):
        for _ in batches:
            pass
        return iter(())

    monkeypatch.setattr(nearcopies, "_shared", none)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got == {k: k if k >= 50 else 1 for k in texts}


def test_close_nodes_make_no_more_rows_than_components():
    """A group of 300 nodes that are all close, and all apart, leaves as a tree; two blocks of it are connected by one row."""
    import numpy as np
    import pyarrow as pa

    def batches(side, wide):
        rows = {"group": [5] * len(side), "side": side, "component": range(1000, 1000 + len(side)), "wide": wide}
        types = {"group": pa.int64(), "side": pa.int64(), "component": pa.int64(), "wide": pa.list_(pa.int64())}
        whole = pa.record_batch([pa.array(rows[c], t) for c, t in types.items()], names=list(types))
        return iter([whole.slice(at, 70) for at in range(0, len(whole), 70)])

    def made(side, wide):
        got = pa.Table.from_batches(nearcopies._close_links(batches(side, wide)), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        return [*zip(*got.to_pydict().values())]

    close = [[100, *[0] * 15, k] for k in range(300)]  # at most nine bits apart
    tree = made([2] * 300, close)
    assert len(tree) == 299 and {x for ab in tree for x in ab} == {*range(1000, 1300)}
    across = made([0, 1] * 150, close)
    assert len(across) == 1 and (across[0][0] - across[0][1]) % 2
    far = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, (50, 16)).tolist()
    assert not made([2] * 50, [[100, *x] for x in far]) and not made([2] * 20, [[100 * 2**k, *[0] * 16] for k in range(20)])


def test_clusters_of_close_texts_in_blocks(spark, monkeypatch):
    """Components that close sketches connect are compared whole and in blocks by number of shingles: those of 0.8 link, others don't."""
    rng, vocab, texts = random.Random(5), [f"x{i}" for i in range(900)], {}
    for g in range(3):
        base = [rng.choice(vocab) for _ in range(150)]
        for k in range(30):
            w = list(base)
            for at in rng.sample(range(150), rng.randint(2, 5)):
                w[at] = rng.choice(vocab)
            texts[900 - 40 * g - k] = " ".join(w)
    want, docs = brute(texts), spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert 6 < len(set(want.values())) < len(texts)
    seen = []
    own = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *more: seen.append(1) or own(pairs.limit(0), *more))
    for shingles in (1 << 20, 1000):
        monkeypatch.setattr(nearcopies, "SHINGLES", shingles)
        assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want
    assert len(seen) == 4  # by the grid and by stars, here made idle; close pairs are judged within tasks


def test_components_by_stars_and_in_one_task(spark, monkeypatch):
    """Few links are connected by one task, more by stars; both give the same."""
    rng = random.Random(8)
    links = [(rng.randrange(150) * 11 - 300, rng.randrange(150) * 11 - 300) for _ in range(110)] + [(None, 3), (5, None)]
    df = spark.createDataFrame(links, "a long, b long")
    few = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "FEW", -1)
    assert few == sorted(map(tuple, components.components(df).collect())) and len(few) > 60
