from datetime import datetime

import numpy as np

from attestor.llm.neighbours import NeighbourOptions, balanced_partitions, nearest_vectors, recall, similar_pairs

SCHEMA = "claim_id long, embed_model string, embedding array<float>, embedded_at timestamp, v int, model string"
T = datetime(2026, 1, 1)


def brute(rows, k=5, low=0.75):
    out = set()
    for model in {m for _, m, *_ in rows}:
        own = sorted({i: v for i, m, v, *_ in rows if m == model}.items())
        ids = np.array([i for i, _ in own])
        x = np.array([v for _, v in own], "f8")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = (x @ x.T).round(9)
        for i in range(len(ids)):
            s[i, i] = -2
            for j in np.lexsort((ids, -s[i]))[:k]:
                if s[i, j] >= low:
                    out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clustered(n, seed, groups=60):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, 96))
    return [(base[rng.integers(groups)] + 0.45 * rng.normal(size=96)).astype("f4") * rng.uniform(0.2, 9) for _ in range(n)]


def test_recall_against_brute_force(spark):
    rows = [(i * 7 + 1, "m1" if i % 9 else "m2", v.tolist(), T, 0, "x") for i, v in enumerate(clustered(900, 3))]
    opt = NeighbourOptions(partition_rows=100, probes=4, block=70)
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA), opt).collect()}
    want = brute(rows)
    assert len(got & want) / len(want) >= 0.95
    exact = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}  # one partition
    assert exact == want


def test_copies_and_ties(spark):
    v = clustered(3, 1)
    rows = [(i, "m", v[0].tolist(), T, 0, "") for i in range(1, 31)] + [(100 + i, "m", v[1 + i].tolist(), T, 0, "") for i in range(2)]
    near = nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    own = sorted(r.near_id for r in near if r.claim_id == 20)
    assert own == [1, 2, 3, 4, 5]  # equal similarity: the smaller id
    assert sorted(r.near_id for r in near if r.claim_id == 3) == [1, 2, 4, 5, 6]
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_unusable_and_repeated(spark):
    v = clustered(1, 2)[0].tolist()
    bad = [None, v[:50], [0.0] * 96, [float("nan"), *v[1:]], [None, *v[1:]], [float("inf"), *v[1:]]]
    rows = [(1, "m", v, T, 0, ""), (1, "m", v, T, 0, ""), (2, "m", v, T, 0, ""), (3, None, v, T, 0, ""), (None, "m", v, T, 0, ""), (4, "other", v, T, 0, "")]
    rows += [(10 + i, "m", b, T, 0, "") for i, b in enumerate(bad)]
    assert [tuple(r) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2)]
    assert similar_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_partitions_are_balanced():
    x = np.array(clustered(500, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = np.argsort(-(x @ x.T), axis=1)[:, 1:11]
    own = balanced_partitions(x, graph, 10, 1)
    assert np.bincount(own, minlength=10).max() <= np.ceil(500 / 10 * 1.1) and (own >= 0).all()


def test_many_partitions_few_questions(spark):
    rows = [(i * 7 + 1, "m1" if i % 3 else "m2", v.tolist(), T, 0, "x") for i, v in enumerate(clustered(3_000, 6, 400))]
    df = spark.createDataFrame(rows, SCHEMA)
    opt = NeighbourOptions(partition_rows=40)
    assert opt.asked(opt.partitions(2_000)) < opt.partitions(2_000) / 6
    got, want = {tuple(r) for r in similar_pairs(df, opt).collect()}, brute(rows)
    assert len(got & want) / len(want) >= 0.95
    assert all(r.recalled for r in recall(df, opt, every=7).collect())


def test_partition_counts():
    opt = NeighbourOptions()
    assert [opt.partitions(n) for n in (1, 900, 3_100, 63_000, 10**6, 4 * 10**6, 10**8)] == [1, 1, 2, 32, 500, 2_000, 10_000]
    assert [opt.asked(p) for p in (1, 3, 32, 1_000)] == [1, 3, 6, 12]
