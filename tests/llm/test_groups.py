import random
from datetime import datetime, timedelta

from attestor.llm.groups import connected_groups, holding_links, match_groups


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in parent}


def groups(spark, pairs, **extra):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, group_id string")
    return {tuple(r) for r in connected_groups(df, "a", "b").select("group_id", "record_id").collect()}


def test_chain_star_and_cycle(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, x) for x in range(1, 50)]
    cycle = [(2000, 2001), (2001, 2002), (2002, 2000)]
    pairs = chain + star + cycle
    random.Random(1).shuffle(pairs)
    assert groups(spark, pairs) == union_find(pairs)


def test_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(10**12, 10**12 + 400), rng.randrange(10**12, 10**12 + 400)) for _ in range(260)]
    pairs = [(a, b) for a, b in pairs if a != b]
    assert groups(spark, pairs + pairs[:50]) == union_find(pairs)


def test_hubs_are_told_apart(spark):
    rng = random.Random(8)
    pairs = [(1, x) for x in range(2, 40)] + [(x, x + 1000) for x in range(2, 20)] + [(500, x) for x in range(1010, 1050)] + [(rng.randrange(2000, 2040), rng.randrange(2000, 2040)) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for hub in (1, 5, 30):
        assert {tuple(r) for r in connected_groups(df, "a", "b", hub=hub).collect()} == union_find([(a, b) for a, b in pairs if a != b])


def test_nulls_selfs_and_empty(spark):
    assert groups(spark, [(1, 1), (None, 2), (3, None)]) == set()
    assert groups(spark, []) == set()
    assert groups(spark, [(2, 1), (1, 2), (5, 5)]) == {(1, 1), (1, 2)}


def test_spaces_are_apart(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 2, 3), (None, 3, 4)], "k string, u long, v long")
    got = {tuple(r) for r in connected_groups(df, "u", "v", space="k").collect()}
    assert got == {("a", 1, 1), ("a", 1, 2), ("b", 2, 2), ("b", 2, 3), (None, 3, 3), (None, 3, 4)}


LINK = "from_claim long, to_claim long, relation string, method string, created_at timestamp, a string"
T = datetime(2026, 1, 1)


def test_holding_link(spark):
    day = timedelta(days=1)
    rows = [
        (1, 2, "same", "model", T + 5 * day, ""), (2, 1, "unrelated", "human", T, ""),  # human wins
        (3, 4, "same", "rule", T + day, ""), (4, 3, "contradicts", "model", T, ""), (3, 4, "same", "model", T + 2 * day, ""),  # latest model
        (5, 5, "same", "human", T, ""), (6, 99, "same", "human", T, ""), (7, 8, "same", "guess", T, ""),
        (1, 3, "same", "rule", None, ""),
    ]
    claims = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4, 5, 6, 7, 8, 8, None)], "claim_id long, relation string")
    got = {tuple(r) for r in holding_links(claims, spark.createDataFrame(rows, LINK)).collect()}
    assert got == {(1, 2, "unrelated"), (3, 4, "same"), (1, 3, "same")}
    origins = spark.createDataFrame([(10, 11, "doi"), (11, 12, "doi"), (13, 13, "self"), (10, 11, "doi")], "document_id long, origin_id long, reason string")
    got = {tuple(r) for r in match_groups(claims, spark.createDataFrame(rows, LINK), origins).collect()}
    assert got == {("claim", 1, 1), ("claim", 1, 3), ("claim", 1, 4), ("document", 10, 10), ("document", 10, 11), ("document", 10, 12)}
