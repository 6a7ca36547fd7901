"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned from a sample (principal axes, then iterative quantisation)
turns each vector into 64 bits. Codes are cut into 8 substrings of 8 bits and each is an index of
its own. Two codes within Hamming distance ``r`` agree in some substring up to ``r // 8`` bits,
so probing all keys that close in every index retrieves every code within the radius.
Retrieved vectors are ranked by their exact cosine. The radius is learned from the
sample, too: the distance that nearly all its true neighbours stay within.

Indexes and probes meet in blocks of bounded size by (substring, key); a block returns only the
best of each query. A query that finds fewer than ``k`` candidates is compared with all
vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage

BITS = 64
SUBSTRINGS = 8
WIDTH = BITS // SUBSTRINGS

# Rows of one side of a block.
INDEX_ROWS = 8192
QUERY_ROWS = 1024


@dataclass(frozen=True)
class Codes:
    """Projection to bits and the search radius."""

    mean: np.ndarray
    rotation: np.ndarray  # [dimensions, bits]
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1, bitorder="little")


def usable(column: str) -> str:
    """SQL condition: a vector without null or non-finite components that is not zero."""
    return (
        f"{column} is not null and size({column}) > 0 and "
        f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and "
        f"exists({column}, x -> x <> 0)"
    )


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares of very large or small values stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of two blocks of codes."""
    return np.bitwise_count(
        a.view(np.uint64).reshape(-1, 1) ^ b.view(np.uint64).reshape(1, -1)
    ).astype(np.int16)


def fit_codes(
    vectors: DataFrame,
    *,
    vector_col: str = "embedding",
    sample_rows: int = 8000,
    k: int = 5,
    quantile: float = 0.97,
    rounds: int = 30,
) -> Codes:
    """Learn rotation and radius from about ``sample_rows`` vectors, drawn by content hash."""
    rows = vectors.where(usable(vector_col)).select(F.col(vector_col).cast("array<double>").alias("v"))
    total = rows.count()
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(place < min(1.0, sample_rows / max(1, total))).distinct().toArrow()
    if not sample.num_rows:
        return Codes(np.zeros(1), np.zeros((1, BITS)), BITS)
    x = _unit(np.array(sample.column("v").to_pylist(), float))
    x = x[np.lexsort(x.T[::-1])]  # the same model for any order of rows
    mean = x.mean(0)
    centred = x - mean
    rng = np.random.default_rng(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    while axes.shape[1] < BITS:  # fewer dimensions than bits: further random directions
        axes = np.hstack([axes, np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]])
    axes = axes[:, :BITS]
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    projected = centred @ axes
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ vt).T
    codes = Codes(mean, axes @ turn, BITS)
    packed = codes.encode(x)
    asked = np.arange(0, len(x), max(1, len(x) // 400))
    cosine = x[asked] @ x.T
    cosine[np.arange(len(asked)), asked] = -2
    nearest = np.argsort(-cosine, axis=1)[:, : min(k, len(x) - 1)]
    if not nearest.size:
        return codes
    far = np.take_along_axis(_distances(packed[asked], packed), nearest, 1)
    return Codes(codes.mean, codes.rotation, int(np.ceil(np.quantile(far, quantile))))


def _probe_keys(key: int, reach: int) -> list[int]:
    return [other for other in range(1 << WIDTH) if (key ^ other).bit_count() <= reach]


def _coded(vectors: DataFrame, codes: Codes, vector_col: str, id_col: str) -> DataFrame:
    """``(id, code, vector)``: the code as 8 bytes, the vector as doubles, for usable vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist(), float)
            packed = shared.value.encode(_unit(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    pa.array([row.tobytes() for row in x], pa.binary()),
                ],
                names=["id", "code", "vector"],
            )

    return vectors.where(usable(vector_col)).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where("id is not null").mapInArrow(encode, "id bigint, code binary, vector binary")


_BEST = "query_id bigint, vec_id bigint, score double"


def _search_block(probes: pa.Table, index: pa.Table, radius: int, k: int, band: int | None) -> pa.Table:
    """The best ``k`` of an index block for each query of a probe block."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not probes.num_rows or not index.num_rows:
        return empty

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        vector = np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(len(code), -1)
        return table.column("id").to_numpy(), code, vector

    q_id, q_code, q = columns(probes)
    x_id, x_code, x = columns(index)
    ok = q_id[:, None] != x_id[None]
    if band is not None:
        ok &= _distances(q_code, x_code) <= radius
        for earlier in range(band):  # a pair counts where it is retrieved first
            apart = np.bitwise_count(q_code[:, earlier, None] ^ x_code[None, :, earlier])
            ok &= apart > radius // SUBSTRINGS
    q_unit, x_unit = _unit(q), _unit(x)
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    for i in np.flatnonzero(ok.any(1)):
        at = np.flatnonzero(ok[i])
        score = x_unit[at] @ q_unit[i]
        order = np.lexsort((x_id[at], -score))[:k]
        out["query_id"] += [int(q_id[i])] * len(order)
        out["vec_id"] += x_id[at][order].tolist()
        out["score"] += score[order].tolist()
    return pa.table(
        {"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())}
    )


def _in_blocks(probes: DataFrame, index: DataFrame, keys: list[str], radius: int, k: int, banded: bool) -> DataFrame:
    """Search all probes against the index rows with the same ``keys``, in blocks of bounded size.

    The sides of a key are cut into parts by their numbers of rows; each part of the one meets each of
    the other, so that a key with a third of all rows is spread.
    """

    def parts(df: DataFrame, rows: int, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(out))

    cut = parts(index, INDEX_ROWS, "n_x").join(parts(probes, QUERY_ROWS, "n_q"), keys)
    cut = cut_lineage(cut)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = (
        probes.join(cut, keys).withColumn("q_part", part("n_q"))
        .withColumn("x_part", F.explode(F.expr("sequence(0, n_x - 1)")))
    )
    right = (
        index.join(cut, keys).withColumn("x_part", part("n_x"))
        .withColumn("q_part", F.explode(F.expr("sequence(0, n_q - 1)")))
    )
    group = [*keys, "q_part", "x_part"]
    columns = [*group, "id", "code", "vector"]

    def search(probes_: pa.Table, index_: pa.Table) -> pa.Table:
        band = probes_.column("band")[0].as_py() if banded and probes_.num_rows else None
        return _search_block(probes_, index_, radius, k, band)

    return (
        left.select(*columns).groupBy(*group).cogroup(right.select(*columns).groupBy(*group)).applyInArrow(search, _BEST)
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_neighbours(
    vectors: DataFrame,
    query: str,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    codes: Codes | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows where the SQL condition ``query`` holds, the ``k``
    other rows of largest cosine among those within the code radius, or among all where fewer are.

    Score is the cosine in double precision of the vectors as given; ties go to the smaller id. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows without an id. Rows
    that share an id are one candidate each; a query is not its own. All usable vectors must have one length.
    """
    codes = codes or fit_codes(vectors, vector_col=vector_col, k=k)
    coded = cut_lineage(_coded(vectors, codes, vector_col, id_col))
    asked = cut_lineage(_coded(vectors.where(query), codes, vector_col, id_col))
    bands = F.array(*[
        F.struct(
            F.lit(j).alias("band"),
            F.conv(F.hex(F.substring("code", j + 1, 1)), 16, 10).cast("int").alias("key"),
        )
        for j in range(SUBSTRINGS)
    ])
    banded = lambda df: df.withColumn("b", F.explode(bands)).select("b.band", "b.key", "id", "code", "vector")
    reach = min(WIDTH, codes.radius // SUBSTRINGS)
    near = vectors.sparkSession.createDataFrame(
        [(key, _probe_keys(key, reach)) for key in range(1 << WIDTH)], "key int, probes array<int>"
    )
    probes = (
        banded(asked).join(F.broadcast(near), "key")
        .select("band", F.explode("probes").alias("key"), "id", "code", "vector")
    )
    found = cut_lineage(_ranked(_in_blocks(probes, banded(coded), ["band", "key"], codes.radius, k, True), k))
    filled = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = cut_lineage(asked.join(filled.select(F.col("query_id").alias("id")), "id", "left_anti"))
    if not short.isEmpty():
        every = lambda df: df.withColumn("band", F.lit(0))
        rest = _ranked(_in_blocks(every(short), every(coded), ["band"], BITS, k, False), k)
        full = found.join(filled.select("query_id"), "query_id", "left_semi")
        found = full.select("query_id", "rank", "vec_id", "score").union(rest.select("query_id", "rank", "vec_id", "score"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
