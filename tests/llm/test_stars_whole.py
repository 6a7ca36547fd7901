import itertools
import random

from pyspark.sql import functions as F

from convoweave.llm.stars import _prefix_buckets, shared_buckets, similar_links


def roots(sets, buckets):
    """Smallest member of each component, over all pairs that share a bucket."""
    group = {v: v for v in sets}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for members in buckets:
        for a, b in itertools.combinations(members, 2):
            x, y = sets[a], sets[b]
            if 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                group[hi] = lo
    return {v: root(v) for v in sets}


def test_cut_versions_of_a_text_with_many_copies(spark):
    # What the cut versions share lies inside the centre of their bucket.
    sets, buckets, rng = {}, [], random.Random(1)
    for g in range(25):
        base = list(range(1000 * g, 1000 * g + 30))
        copies = [base] + [[x if k != i else -(1000 * g + i + 1) for k, x in enumerate(base)] for i in range(30)]
        members = [*copies, base[:26], base[:21]]
        rng.shuffle(members)
        buckets.append(list(range(len(sets), len(sets) + len(members))))
        sets |= {len(sets) + i: set(m) for i, m in enumerate(members)}
    # One bucket of 300 members: groups nested in each other, pairs and single ones.
    start = len(sets)
    for i in range(300):
        low = 1_000_000 + 7 * rng.randrange(12)
        sets[start + i] = set(range(low, low + rng.randrange(20, 60)))
    buckets.append(list(range(start, start + 300)))
    df = spark.createDataFrame([(v, sorted(x)) for v, x in sets.items()], "v bigint, items array<bigint>")
    members = spark.createDataFrame([(k, v) for k, b in enumerate(buckets) for v in b], "key bigint, v bigint")
    links, labels = similar_links(shared_buckets(members), df, 80)
    found = {v: v for v in sets} | {r.v: r.label for r in labels.collect()}
    assert found == roots(sets, buckets)
    assert links.where(F.col("a") == F.col("b")).isEmpty()


def test_copies_too_far_from_all_others_are_not_compared(spark):
    """Each has 15 items of its own among 100 and the same rare rest; every pair of them was compared before."""
    base = list(range(100))
    sets = {v: [x if not v <= x < v + 15 else 1000 * (v + 1) + x for x in base] for v in range(60)}
    sets |= {60: base, 61: [-1, *base[1:]]}
    df = spark.createDataFrame([(v, x, 100) for v, x in sets.items()], "v bigint, items array<bigint>, n int")
    starred = spark.createDataFrame([(99, v) for v in sets], "c bigint, v bigint")
    labels = spark.createDataFrame([], "v bigint, label bigint")
    buckets = _prefix_buckets(starred, labels, df, 80, lambda items: items)
    assert {r.v for r in buckets.select("v").collect()} <= {60, 61}
    members = starred.select(F.col("c").alias("key"), "v")
    links, _ = similar_links(shared_buckets(members), df, 80)
    assert {tuple(r) for r in links.collect()} == {(60, 61)}
