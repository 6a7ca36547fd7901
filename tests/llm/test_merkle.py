import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoweave.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(place, siblings) of each level."""
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return out


def plain(rows):
    """{(group, id, leaf): (subroot, root, proof)} of (id, group, leaf) rows; equal rows share a list of proofs."""
    groups = {}
    for id_, group, leaf in rows:
        groups.setdefault(group, []).append((id_ is not None, id_ or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    found = {}
    for at, g in enumerate(names):
        for i, (known, id_, leaf) in enumerate(sorted(groups[g])):
            proof = path(trees[g], i) + path(top, at)
            found.setdefault((g, id_ if known else None, leaf), []).append((trees[g][-1][0], top[-1][0], proof))
    return found


def check(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "id bigint, grp string, leaf string").withColumn("root", F.lit("x")).repartition(partitions)
    out = merkle.prove_rows(merkle.build_manifest(df, id_col="id", group_col="grp", leaf_col="leaf"))
    assert out.columns == ["id", "grp", "leaf", "proof", "subroot", "root"]
    folded = out.withColumn("folded", merkle.fold_proof(F.col("leaf"), F.col("proof")))
    folded = folded.withColumn("sides", merkle.proof_digest(F.col("proof"))).collect()
    found = {}
    for r in folded:
        proof = [(p.place, list(p.siblings)) for p in r.proof]
        assert r.folded == r.root and r.sides == sha(*itertools.chain(*(s for _, s in proof)))
        found.setdefault((r.grp, r.id, r.leaf), []).append((r.subroot, r.root, proof))
    expected = plain(rows)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def leaves(n, group, seed=0):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, group, sha(str(group), str(i))) for i in ids]


def test_addresses_are_a_permutation_with_close_subtrees():
    for count in range(1, 6):
        places = np.concatenate([merkle.address(count, d, np.arange(8**d)) for d in range(count)])
        assert sorted(places) == list(range(merkle.tree_size(count)))
    # Van Emde Boas: below the cut at half height each lower tree is one stretch.
    lower = [merkle.address(4, d, np.arange(8**d)) for d in (2, 3)]
    for s in range(64):
        members = [lower[0][s], *lower[1][8 * s : 8 * s + 8]]
        assert sorted(members) == list(range(min(members), min(members) + 9))


@pytest.mark.parametrize("sizes", [[1], [2, 1], [8, 9, 64, 65], [1] * 11, [4096, 513], [4097, 1, 7]])
def test_proofs_equal_plain_trees(spark, sizes):
    rows = [r for k, n in enumerate(sizes) for r in leaves(n, None if k == 0 else f"g{k}", k)]
    check(spark, rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = leaves(20, "a") + [(None, "a", sha("n"))] * 2 + [(3, None, sha("t"))] * 9 + [(3, None, sha("u"))]
    check(spark, rows, partitions=7)
    check(spark, [(5, "", sha("one"))])


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, grp string, leaf string")
    manifest = merkle.build_manifest(df, id_col="id", group_col="grp", leaf_col="leaf")
    assert manifest.root == sha("") and merkle.prove_rows(manifest).collect() == []


def test_null_digest_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", None)], "id bigint, grp string, leaf string")
    with pytest.raises(Exception, match="no digest"):
        merkle.build_manifest(df, id_col="id", group_col="grp", leaf_col="leaf")


def test_row_digest_and_tampering(spark, edges):
    columns = ["doc_id", "text", "lang", "n_chars"]
    shown = edges.select(*columns, merkle.row_digest([F.col(c) for c in columns]).alias("h"))
    for r in shown.collect():
        assert r.h == sha(*(field(r[c]) for c in columns))
    rows = leaves(70, "a")
    df = spark.createDataFrame(rows, "id bigint, grp string, leaf string")
    out = merkle.prove_rows(merkle.build_manifest(df, id_col="id", group_col="grp", leaf_col="leaf"))
    changed = out.select((merkle.fold_proof(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).alias("same"))
    assert not any(r.same for r in changed.collect())
