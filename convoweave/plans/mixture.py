"""From a mixture specification to shuffled train and test tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import row_key, stage_digest
from ..operators.copies import with_content_key
from ..operators.exact_cut import FETCH_ROWS, Cut, find_cuts, key_frame, split_cut
from ..operators.member_steps import initial_columns, reshape
from ..operators.nested_union import concat_nested
from ..operators.projection import concat_members
from ..sources.scratch import cut_lineage
from ..sources.sinks import save_metrics, write_marked
from ..sources.tables import load_dataset, load_member, select_split
from ..spec import BatchTransform, ColumnTransform, Member, Mixture, RowTransform

logger = logging.getLogger(__name__)

# Bookkeeping columns of a mixture, next to the data columns.
MEMBER, KEY, ORDER = "_member", "_row_key", "_order_key"
BOOKKEEPING = (MEMBER, KEY, ORDER)
_SPLIT = "split"


@dataclass(frozen=True)
class MixturePlan:
    """A lazy mixture: ``frame`` holds all rows with ``split`` and bookkeeping.

    ``sampled`` has the member sizes after sampling where a weight made them
    known; ``total`` is set if a split needed it.
    """

    frame: DataFrame
    names: tuple[str, ...]
    sampled: Mapping[str, int] = field(default_factory=dict)
    total: int | None = None
    test_rows: int | None = None

    @property
    def splits(self) -> dict[str, DataFrame]:
        if self.names == ("train",):
            return {"train": self.frame.drop(_SPLIT)}
        return {
            name: self.frame.where(F.col(_SPLIT) == name).drop(_SPLIT) for name in self.names
        }

    def counts(self) -> DataFrame:
        """Rows by member and split."""
        return self.frame.groupBy(F.col(MEMBER).alias("member"), _SPLIT).agg(
            F.count(F.lit(1)).alias("rows")
        )

    def write(
        self, path: str, *, files: int | None = None, mode: str = "errorifexists", metrics: str | None = None
    ) -> dict[str, int]:
        """Write all splits in shuffled order in one pass; a split gets files by its share.

        Returns the rows written by split, counted in that pass; ``metrics`` saves them there too (``save_metrics``).
        """
        if files is None:
            files = int(self.frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        per_split = {"train": files}
        if self.total:
            test = max(1, round(files * self.test_rows / self.total))
            per_split = {"train": max(1, files - test), "test": test}
        rows = write_marked(
            self.frame, path, names=list(self.names), order_key=ORDER, files=per_split, mode=mode
        )
        if metrics is not None:
            save_metrics(self.frame.sparkSession, rows, metrics, mode=mode)
        return rows


def plan_mixture(
    spark: SparkSession,
    mixture: Mixture,
    root: str | None = None,
    *,
    tables: Mapping[str, DataFrame] | None = None,
    materialise_keys: bool = False,
    fill_nested: bool = False,
    fetch_rows: int = FETCH_ROWS,
) -> MixturePlan:
    """Plan a mixture over tables below ``root`` (or given by member id in ``tables``).

    Small counting jobs run here, over key columns and for all members
    together; the returned frame is lazy and free of shuffles of its own.

    A test split counts the rows that are left after the transforms, two or
    three times. ``materialise_keys`` writes their keys to shared storage first,
    which pays if ``messages`` come out of costly expressions.

    Members must agree on the fields inside their columns, unless ``fill_nested`` fills the missing ones with nulls.
    """
    members = {member.label: member for member in mixture.datasets}
    loaded = {name: _load(spark, m, root, tables or {}) for name, m in members.items()}

    cuts, sampled = _sample_cuts(members, loaded, mixture.seed, fetch_rows)
    frames = []
    for name, member in members.items():
        df = loaded[name]
        if name in cuts:
            key = F.col(KEY)
            df = df.where(cuts[name].keeps(stage_digest(mixture.seed, "sample", name, key), key))
        df = reshape(df, member, also=[KEY])
        in_python = isinstance(member.transform, (BatchTransform, RowTransform)) or (
            isinstance(member.transform, ColumnTransform) and "messages" in member.transform.columns
        )
        if in_python and mixture.test_split_size is not None:
            # Splitting counts the rows that come out of the Python code; run that once.
            df = cut_lineage(df)
        frames.append(df.withColumn(MEMBER, F.lit(name)))
    united = concat_nested(frames) if fill_nested else concat_members(frames)
    united = united.withColumn(
        ORDER, stage_digest(mixture.seed, "shuffle", F.col(MEMBER), F.col(KEY))
    )

    if mixture.test_split_size is None:
        return MixturePlan(united.withColumn(_SPLIT, F.lit("train")), ("train",), sampled)

    # Member and key together identify a row here, and the digest is over both.
    identity = F.concat(F.col(MEMBER), F.lit(":"), F.col(KEY))
    digest = F.md5(F.concat(F.lit(f"{mixture.seed}:split:"), identity))
    keys = united.select(MEMBER, KEY)
    cut, test_rows, total = split_cut(
        cut_lineage(keys) if materialise_keys else keys,
        test_size=mixture.test_split_size,
        digest=digest,
        key=identity,
        fetch_rows=fetch_rows,
    )
    side = F.when(cut.keeps(digest, identity), "test").otherwise("train")
    marked = united.withColumn(_SPLIT, side)
    logger.info("mixture of %d rows, %d of them test", total, test_rows)
    return MixturePlan(marked, ("train", "test"), sampled, total, test_rows)


def build_mixture(
    spark: SparkSession,
    mixture: Mixture,
    root: str | None = None,
    *,
    tables: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """``{"train": ...}``, with ``"test"`` if a test size is set.

    Rows carry ``_order_key``: the shuffled order is ascending by it. It is
    applied when the splits are written, since a DataFrame has no order.
    """
    return plan_mixture(spark, mixture, root, tables=tables).splits


def load_training_data(
    spark: SparkSession,
    *,
    root: str,
    dataset_name: str | None = None,
    dataset_config: str | None = None,
    mixture: Mixture | Mapping | None = None,
) -> dict[str, DataFrame]:
    """A named dataset as it is, or a mixture; the mixture wins if both are given."""
    if mixture is not None:
        if not isinstance(mixture, Mixture):
            mixture = Mixture.from_dict(mixture)
        return build_mixture(spark, mixture, root)
    if dataset_name:
        return load_dataset(spark, dataset_name, dataset_config, root=root)
    raise ValueError("give a dataset name or a mixture")


def _load(
    spark: SparkSession, member: Member, root: str | None, tables: Mapping[str, DataFrame]
) -> DataFrame:
    """The member's split with its row key, projected to the initial columns."""
    if member.id in tables:
        df = select_split(tables[member.id], member)
    elif root is None:
        raise ValueError(f"member {member.id!r}: no table given and no root to read from")
    else:
        df = load_member(spark, member, root)
    clash = [name for name in (*BOOKKEEPING, _SPLIT) if name in df.columns]
    if clash:
        raise ValueError(f"member {member.label!r}: column names {clash} are reserved")
    if member.key is None:
        return with_content_key(initial_columns(df, member), KEY)
    return initial_columns(df.withColumn(KEY, row_key(member.key)), member, also=[KEY])


def _sample_cuts(
    members: Mapping[str, Member],
    loaded: Mapping[str, DataFrame],
    seed: int,
    fetch_rows: int,
) -> tuple[dict[str, Cut], dict[str, int]]:
    """One cut per member whose weight is below one, and the resulting sizes."""
    weighted = {n: m.weight for n, m in members.items() if m.weight is not None and m.weight < 1}
    if not weighted:
        return {}, {}
    ones = [loaded[name].select(F.lit(name).alias("member")) for name in weighted]
    totals = dict.fromkeys(weighted, 0) | {
        row["member"]: row["count"]
        for row in reduce(DataFrame.unionAll, ones).groupBy("member").count().collect()
    }
    # Python's int(n * w) on doubles; SQL decimals would give other sizes.
    wanted = {name: int(totals[name] * weight) for name, weight in weighted.items()}
    keys = {
        name: key_frame(
            loaded[name], stage_digest(seed, "sample", name, F.col(KEY)), F.col(KEY)
        )
        for name in weighted
    }
    for name, k in wanted.items():
        logger.info("member %s: %d of %d rows (weight %s)", name, k, totals[name], weighted[name])
        if k == 0:
            logger.warning("member %s is empty after sampling", name)
    return find_cuts(keys, wanted, totals, fetch_rows=fetch_rows), wanted
