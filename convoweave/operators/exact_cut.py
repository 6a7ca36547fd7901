"""Exact-size seeded selection without a global sort.

Rows are ordered by the md5 of seed, stage, member and row key. The k-th row of
that order is found by counting, and the selection is then a filter on the
scan: no row but a few thousand around the cut is ever sorted or moved.

Digests are uniform, so rank k lies in a narrow window around k/n of the digest
space. A counting pass counts the rows below the window and in up to 1,024 slots
of it; the slot (or, if the guess missed, the side) that holds rank k becomes
the new interval. At 10^11 rows one pass leaves a few thousand rows. The result
is exact whatever the distribution; uniformity only makes it quick.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import POSITIONS, position, position_prefix, row_key, stage_digest
from ..spec import check_fraction
from .copies import with_content_key

SLOTS = 1024
FETCH_ROWS = 20_000
_SIGMAS = 6.0

_DIGEST = "_digest"
_KEY = "_row_key"
_COPY = "_content_key"


@dataclass(frozen=True)
class Cut:
    """The last kept digest; without one either all or no rows are kept.

    ``key`` is set only if the next row shares the digest, so that the filter
    computes one digest per row and compares keys in that case alone. Where rows may
    share a key, ``tied`` says how many of the last key's are kept, if not all.
    """

    digest: str | None = None
    key: str | None = None
    keep_all: bool = False
    tied: int | None = None

    def keeps(self, digest: Column, key: Column) -> Column:
        if self.digest is None:
            return F.lit(self.keep_all)
        if self.key is None:
            return digest <= self.digest
        return (digest < self.digest) | ((digest == self.digest) & (key <= self.key))


@dataclass(frozen=True)
class _Interval:
    low: int
    high: int
    rows: int
    rank: int
    missed: bool = False

    def window(self) -> tuple[int, int]:
        """Where rank should lie; after a miss the whole interval, so that two
        passes narrow it at least by the number of slots."""
        if self.missed:
            return self.low, self.high
        width = self.high - self.low
        share = self.rank / self.rows
        spread = _SIGMAS * math.sqrt(share * (1 - share) / self.rows) + _SIGMAS / self.rows
        low = self.low + int(width * max(0.0, share - spread))
        high = self.low + math.ceil(width * min(1.0, share + spread))
        low = min(low, self.high - 1)
        return low, min(max(high, low + 1), self.high)


class DuplicateKeys(ValueError):
    """The key columns do not identify a row, so an exact cut does not exist."""


def find_cuts(
    keys: Mapping[str, DataFrame],
    wanted: Mapping[str, int],
    totals: Mapping[str, int],
    *,
    fetch_rows: int = FETCH_ROWS,
    slots: int = SLOTS,
    ties: bool = False,
) -> dict[str, Cut]:
    """Cuts that keep exactly ``wanted`` of ``totals`` rows, for several tables at once.

    Each frame of ``keys`` has the columns ``_digest`` and ``_row_key``. All
    tables share each job, so the number of jobs does not grow with them.
    Rows that share a key at the cut are an error, or with ``ties`` counted in ``Cut.tied``.
    """
    cuts: dict[str, Cut] = {}
    intervals: dict[str, _Interval] = {}
    for name, k in wanted.items():
        if not 0 <= k <= totals[name]:
            raise ValueError(f"{name}: cannot take {k} of {totals[name]} rows")
        if k in (0, totals[name]):
            cuts[name] = Cut(keep_all=k > 0)
        else:
            intervals[name] = _Interval(0, POSITIONS, totals[name], k)

    while wide := {n: i for n, i in intervals.items() if i.rows > fetch_rows}:
        single = [name for name, interval in wide.items() if interval.high - interval.low <= 1]
        if single and not ties:
            raise DuplicateKeys(f"{single[0]}: {wide[single[0]].rows} rows share one row key")
        for name in single:
            del wide[name]
        if not wide:
            break
        intervals.update(_narrow(keys, wide, slots))

    if intervals:
        cuts.update((_fetch_tied if ties else _fetch)(keys, intervals))
    return cuts


def _narrow(
    keys: Mapping[str, DataFrame], wide: Mapping[str, _Interval], slots: int
) -> dict[str, _Interval]:
    frames, windows = [], {}
    for name, interval in wide.items():
        low, high = interval.window()
        shift = max(0, (-(-(high - low) // slots) - 1).bit_length())
        windows[name] = (low, high, 1 << shift)
        digest = F.col(_DIGEST)
        slot = F.when(digest < position_prefix(low), F.lit(-1)).otherwise(
            F.shiftright(position(digest) - F.lit(low), shift).cast("int")
        )
        frames.append(
            _between(keys[name], interval.low, high).select(
                F.lit(name).alias("member"), slot.alias("slot")
            )
        )
    counts: dict[str, dict[int, int]] = {name: {} for name in wide}
    for member, slot, rows in (
        _union(frames).groupBy("member", "slot").count().collect()  # members x (slots + 1)
    ):
        counts[member][slot] = rows

    out = {}
    for name, interval in wide.items():
        low, high, step = windows[name]
        seen = counts[name].pop(-1, 0)
        if interval.rank <= seen:
            out[name] = replace(interval, high=low, rows=seen, missed=True)
            continue
        for slot, rows in sorted(counts[name].items()):
            if interval.rank <= seen + rows:
                start = low + slot * step
                out[name] = _Interval(start, min(start + step, high), rows, interval.rank - seen)
                break
            seen += rows
        else:
            out[name] = _Interval(
                high, interval.high, interval.rows - seen, interval.rank - seen, missed=True
            )
    return out


def _fetch(keys: Mapping[str, DataFrame], intervals: Mapping[str, _Interval]) -> dict[str, Cut]:
    """Rank inside intervals of at most ``fetch_rows`` rows each."""
    frames = [
        _between(keys[name], i.low, i.high).select(
            F.lit(name).alias("member"), _DIGEST, _KEY, F.lit(i.rank).alias("rank")
        )
        for name, i in intervals.items()
    ]
    order = Window.partitionBy("member").orderBy(_DIGEST, _KEY)
    around = (
        _union(frames)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place").between(F.col("rank"), F.col("rank") + 1))
    )
    cuts: dict[str, Cut] = {}
    last = {}
    found = around.collect()  # at most two rows per member
    for row in sorted(found, key=lambda row: row["place"]):
        member, digest, key = row["member"], row[_DIGEST], row[_KEY]
        if row["place"] == row["rank"]:
            cuts[member], last[member] = Cut(digest), (digest, key)
        elif member in last and last[member] == (digest, key):
            raise DuplicateKeys(f"{member}: rows at the cut share the key {key!r}")
        elif member in last and last[member][0] == digest:
            cuts[member] = Cut(*last[member])
    for name in intervals:
        if name not in cuts:
            raise RuntimeError(f"{name}: the table changed while its cut was being found")
    return cuts


def _fetch_tied(keys: Mapping[str, DataFrame], intervals: Mapping[str, _Interval]) -> dict[str, Cut]:
    """The same where rows may share a key: keys are counted first, however many rows have one."""
    frames = [
        _between(keys[name], i.low, i.high).select(
            F.lit(name).alias("member"), _DIGEST, _KEY, F.lit(i.rank).alias("rank")
        )
        for name, i in intervals.items()
    ]
    order = Window.partitionBy("member").orderBy(_DIGEST, _KEY)
    counted = _union(frames).groupBy("member", _DIGEST, _KEY, "rank").agg(F.count(F.lit(1)).alias("n"))
    around = (
        counted.withColumn("place", F.sum("n").over(order))
        .withColumn("next", F.lead(_DIGEST).over(order))
        .where((F.col("place") >= F.col("rank")) & (F.col("place") - F.col("n") < F.col("rank")))
    )
    cuts: dict[str, Cut] = {}
    for row in around.collect():  # one row per member
        kept = row["rank"] - (row["place"] - row["n"])
        if kept < row["n"]:
            cuts[row["member"]] = Cut(row[_DIGEST], row[_KEY], tied=kept)
        else:
            cuts[row["member"]] = Cut(row[_DIGEST], row[_KEY] if row["next"] == row[_DIGEST] else None)
    for name in intervals:
        if name not in cuts:
            raise RuntimeError(f"{name}: the table changed while its cut was being found")
    return cuts


def _between(frame: DataFrame, low: int, high: int) -> DataFrame:
    """Rows in ``[low, high)``; the rarer condition goes first, since each one
    computes the digest again."""
    digest = F.col(_DIGEST)
    above = [digest >= position_prefix(low)] if low > 0 else []
    below = [digest < position_prefix(high)] if high < POSITIONS else []
    conditions = below + above if high < POSITIONS - low else above + below
    return frame.where(reduce(Column.__and__, conditions)) if conditions else frame


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def key_frame(df: DataFrame, digest: Column, key: Column) -> DataFrame:
    return df.select(digest.alias(_DIGEST), key.alias(_KEY))


def exact_sample(
    df: DataFrame,
    key_cols: Sequence[str],
    *,
    fraction: float | None = None,
    k: int | None = None,
    seed: int = 0,
    stage: str = "sample",
    member: str = "",
    total: int | None = None,
    fetch_rows: int = FETCH_ROWS,
    by_content: bool = False,
) -> DataFrame:
    """Keep exactly ``k`` (or ``int(n * fraction)``) rows, nested for one seed.

    ``key_cols`` must identify a row, or at least the rows around the cut. With ``by_content`` rows may share a key: if
    only some of a key's rows can be kept, those follow each other by the content of all columns, equal ones by number.
    Pass ``total`` if the row count is known.
    The keys are read two or three times: write a costly input to storage first.
    """
    _batch_only(df, "exact_sample")
    if (fraction is None) == (k is None):
        raise ValueError("give either fraction or k")
    if fraction is not None:
        check_fraction(fraction, "fraction", upper_closed=True)
        if fraction == 1:
            return df
    n = df.count() if total is None else total
    k = int(n * fraction) if k is None else k
    key = row_key(key_cols)
    digest = stage_digest(seed, stage, member, key)
    cut = find_cuts(
        {member: key_frame(df, digest, key)}, {member: k}, {member: n}, fetch_rows=fetch_rows, ties=by_content
    )[member]
    if cut.tied is None:
        return df.where(cut.keeps(digest, key))
    last = (digest == cut.digest) & (key == cut.key)
    tied = with_content_key(df.where(last), _COPY)
    some = exact_sample(tied, [_COPY], k=cut.tied, seed=seed, stage=stage, member=member, fetch_rows=fetch_rows)
    return df.where(cut.keeps(digest, key) & ~last).unionAll(some.drop(_COPY))


def split_cut(
    df: DataFrame,
    *,
    test_size: float,
    digest: Column,
    key: Column,
    fetch_rows: int = FETCH_ROWS,
) -> tuple[Cut, int, int]:
    """The cut below which ``ceil(n * test_size)`` rows are test; also that number and n."""
    _batch_only(df, "a train/test split")
    check_fraction(test_size, "test_size", upper_closed=False)
    n = df.count()
    n_test = math.ceil(n * test_size)
    if not 0 < n_test < n:
        raise ValueError(f"test_size {test_size} of {n} rows leaves an empty side")
    keys = {"": key_frame(df, digest, key)}
    return find_cuts(keys, {"": n_test}, {"": n}, fetch_rows=fetch_rows)[""], n_test, n


def train_test_split(
    df: DataFrame,
    key_cols: Sequence[str],
    *,
    test_size: float,
    seed: int = 0,
    member: str = "",
    fetch_rows: int = FETCH_ROWS,
) -> dict[str, DataFrame]:
    """Disjoint, complete train and test frames of exact size."""
    key = row_key(key_cols)
    digest = stage_digest(seed, "split", member, key)
    cut, _, _ = split_cut(
        df, test_size=test_size, digest=digest, key=key, fetch_rows=fetch_rows
    )
    is_test = cut.keeps(digest, key)
    return {"train": df.where(~is_test), "test": df.where(is_test)}


def _batch_only(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs whole-table counts and works on batch data only")
