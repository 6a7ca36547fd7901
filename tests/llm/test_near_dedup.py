import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from convoweave.llm.components import components
from convoweave.llm.near_dedup import drop_near_duplicates, near_duplicates, shingle_set, signature
from convoweave.llm.stars import shared_buckets, similar_links
from llm_data import EDGES, prose, varied


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(rows, width, percent=80):
    """Smallest id of each row's component, over all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            group[root(j)] = root(i)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[root(i)] = min(k, ids.get(root(i), k))
    return [(len(sets[i]), ids.get(root(i))) for i in range(len(rows))]


def compare(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = near_duplicates(df, width=width).collect()
    expected = sorted(((k, n, c, k == c) for (k, _), (n, c) in zip(rows, plain(rows, width))), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr) == expected


def test_odd_texts(spark):
    compare(spark, [(i, t) for i, t in EDGES if len(t or "") < 100_000], 4)


def test_groups_of_copies_chains_and_a_hub(spark):
    rows, rng = [], random.Random(4)
    hub = prose(100, 400)
    rows += [(1000 + i, varied(hub, 200 + i, 0.018)) for i in range(60)] + [(5000, hub)]  # copies of copies are far apart
    step = prose(101, 200)
    for i in range(12):  # each near the one before only
        rows.append((2000 - i, step))
        step = varied(step, 300 + i, 0.012)
    rows += [(3000 + i, hub) for i in range(40)]
    rows += [(4000 + i, prose(400 + i, rng.randint(1, 120))) for i in range(80)]
    rows += [(4500 + i, prose(400 + i, 30) + " " + prose(99, 60)) for i in range(30)]  # a shared passage is no copy
    compare(spark, rows, 5)


def test_stage_keeps_one_of_each_group_and_all_columns(spark, edges, no_rows):
    kept = drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i in (11, 12)) == [11, 11]  # equal rows stay together
    assert {1, 2, 3, 4, 13, None} <= set(ids)
    assert drop_near_duplicates(no_rows).count() == 0


def test_signatures_estimate_similarity():
    a = shingle_set(prose(1, 2000).encode(), 3)
    b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], a[-5:] ^ np.uint64(12345)]))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a, 512) == signature(b, 512)).mean() - exact) < 0.06
    one = np.array([7], np.uint64)
    assert (signature(one, 120) == 7).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7), (60, None)] + [(1, 0)] * 3
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    labels = {r.v: r.label for r in rows}
    assert len(rows) == len(labels) and labels == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_bucket_of_unlike_members_loses_no_link(spark):
    # One bucket of 30: five groups of six that only know their own; and a hub whose 20 copies hide a pair.
    items = lambda i: [1000 * (i % 5) + k for k in range(20)] + [10_000 + i]
    sets = [(i, items(i)) for i in range(30)]
    hub = list(range(50_000, 50_100))
    sets += [(100, hub)] + [(101 + i, [x + 1_000_000 * (i + 1) if x % 23 == i else x for x in hub]) for i in range(20)]
    far = [x + 7_000_000_000 if x % 4 == 0 else x for x in hub]
    sets += [(200, far), (201, [x + 1 if x == far[4] else x for x in far])]
    df = spark.createDataFrame(sets, "v bigint, items array<bigint>")
    members = df.select(F.when(F.col("v") < 100, 1).otherwise(2).cast("bigint").alias("key"), "v")
    labels = similar_links(shared_buckets(members), df, 80)[1]
    expected = {i: i % 5 for i in range(30)} | {100 + i: 100 for i in range(21)} | {200: 200, 201: 200}
    assert {r.v: r.label for r in labels.collect()} == expected


def test_stage_keeps_columns_of_any_name(spark):
    rows = [(1, prose(1, 60), "keep", 5, None, "c"), (2, prose(1, 60), "w", 6, "x", "d"), (3, prose(3, 60), "z", 7, "y", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _word string, _bits int, _chunk string, _c0 string")
    out = drop_near_duplicates(df)
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
