import random

from loomwatch.llm import near_dup as nd, vector_dup as vd


def shingles(t, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 150))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 5)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            docs.append(" ".join(edited).upper() if rng.random() < 0.2 else "\n ".join(edited))
    docs += ["", None, " \t", docs[0], docs[0], docs[5]]
    return list(enumerate(docs))


def test_near_duplicates_against_brute_force(spark):
    docs = texts()
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(sets, links)
    n = {d: sum(d in x for x in links) for d in sets}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, key int").repartition(3)
    for block in (2,):
        got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in nd.near_duplicates(df, block=block).collect()}
        assert got == {d: (want[d], n[d], want[d] == d) for d in sets}
    assert len(links) > 30
    assert nd.near_duplicates(df.filter("false")).collect() == []
    assert nd.keep_one(df).count() == len(set(want.values()))


def test_depth_reaches_recall():
    d = nd.depth_for(0.8, 32, 0.9999)
    assert d == 6 - (1 - (1 - 0.8**6) ** 32 < 0.9999)


def test_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    x = base[rng.integers(0, 30, 400)] + rng.standard_normal((400, 16)) * rng.choice([0.05, 0.25, 0.5], 400)[:, None]
    x[10] = x[11] = x[12]
    rows = [(k, [float(v) for v in x[k]], int(k % 3)) for k in range(400)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [1.0, None], 1), (905, [], 1), (906, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {k: (np.array(v) / np.linalg.norm(v), lab) for k, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.93]
    ids = [r[0] for r in rows]
    want = components(ids, links)
    for options in ({}, {"block": 3, "block_dims": 4, "grid": 2}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.vector_duplicates(df, **options).collect()}
        assert got == {i: (sum(i in x for x in links), want[i], want[i] == i) for i in ids}
    assert len(links) > 50
    assert vd.vector_duplicates(df.filter("false")).collect() == []


def test_vectors_of_any_magnitude_and_without_ids(spark):
    e = [(1, [1e200, 1e200], 1, 0), (2, [1e200, 1e200], 1, 0), (3, [1e-200, 1e-200], 1, 0), (None, [1.0, 1.0], 1, 0), (None, [5e-324, 5e-324], 1, 0)]
    e += [(9, [1.0, -1.0], 1, 0), (9, [1e300, -1e300], 1, 0), (None, [0.0, 1.0], 2, 0), (11, None, 1, 0)]
    df = spark.createDataFrame(e, "vec_id long, embedding array<double>, label int, row int").repartition(3)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vd.vector_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 4, 1, False), (0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (9, 1, 9, True), (9, 1, 9, True), (11, 0, 11, True)]
