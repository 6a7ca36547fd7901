"""The steps every mixture member goes through, in their fixed order.

All of them are row-local, so they also apply to streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..spec import Member
from .projection import drop_empty_conversations, rename_sequential, select_columns
from .transform import apply_transform


def initial_columns(df: DataFrame, member: Member, also: Sequence[str] = ()) -> DataFrame:
    """The first projection, before sampling; ``also`` keeps bookkeeping columns."""
    return df if member.columns is None else select_columns(df, [*member.columns, *also])


def reshape(df: DataFrame, member: Member, also: Sequence[str] = ()) -> DataFrame:
    """Rename, transform, final projection, then drop empty conversations.

    The filter comes last on purpose: it must see the transformed ``messages``,
    and rows it drops have already counted in the sample size.
    """
    if member.rename_columns is not None:
        df = rename_sequential(df, member.rename_columns)
    if member.transform is not None:
        df = apply_transform(df, member.transform)
    if member.final_columns is not None:
        df = select_columns(df, [*member.final_columns, *also])
    return drop_empty_conversations(df)
