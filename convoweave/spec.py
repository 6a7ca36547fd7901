"""Declarative mixture specification: small driver-side records, no Spark job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql.types import DataType, StructType


@dataclass(frozen=True)
class BatchTransform:
    """Python transform of pandas batches with a declared result.

    ``fn`` takes a pandas DataFrame and returns one with the same number of
    rows; the columns named in ``schema`` replace or extend the input columns
    and every other column stays as it was.
    """

    fn: Callable
    schema: str | StructType


@dataclass(frozen=True)
class RowTransform:
    """Python callback ``dict -> dict`` with a declared result.

    The returned keys replace or extend the sample and must be named in
    ``schema``. Values are plain Python: lists, dicts, None.
    """

    fn: Callable[[dict], dict]
    schema: str | StructType


@dataclass(frozen=True)
class ArrowColumn:
    """One column from others: ``fn`` takes their Arrow arrays and returns one of the same length."""

    fn: Callable
    type: str | DataType
    inputs: Sequence[str]


@dataclass(frozen=True)
class ColumnTransform:
    """Python transform column by column.

    Each of ``columns`` is replaced or added; all see the input row. Unlike a batch transform this is no barrier: filters on
    other columns and projections go through it to the scan, and a column that nobody asks for is not computed.
    """

    columns: Mapping[str, ArrowColumn]


Transform = Mapping[str, str] | BatchTransform | ColumnTransform | RowTransform


@dataclass(frozen=True)
class Member:
    """One table of a mixture.

    ``weight`` None means the sampling step is skipped; a spec without the key
    gets 1.0. ``key`` names the columns that identify a row; without it a row
    is identified by its content and copy number. ``name`` enters the sampling
    keys and must be unique in a mixture (default: the id).
    """

    id: str
    config: str | None = None
    data_dir: str | None = None
    split: str = "train"
    weight: float | None = None
    columns: Sequence[str] | None = None
    rename_columns: Mapping[str, str] | None = None
    final_columns: Sequence[str] | None = None
    transform: Transform | None = None
    key: Sequence[str] | None = None
    name: str | None = None
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str | StructType | None = None
    split_column: str = "split"

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not self.id.strip():
            raise ValueError("a mixture member needs a non-empty id")
        if self.weight is not None:
            check_fraction(self.weight, "weight", upper_closed=True)
        if self.transform is not None and not isinstance(
            self.transform, (Mapping, BatchTransform, ColumnTransform, RowTransform)
        ):
            raise ValueError(
                f"member {self.id!r}: no transform found; give SQL expressions by "
                "column, a BatchTransform or a RowTransform"
            )
        if "[" in self.split:
            raise ValueError(f"split slices are not supported: {self.split!r}")

    @property
    def label(self) -> str:
        return self.name or self.id

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> Member:
        if spec.get("transform_code") is not None:
            raise ValueError(
                "transform source text is not executed; give `transform` as SQL "
                "expressions by column, a BatchTransform or a RowTransform"
            )
        optional = (
            "config", "data_dir", "columns", "rename_columns", "final_columns",
            "transform", "key", "name", "schema",
        )
        return cls(
            id=spec.get("id"),
            split=spec.get("split", "train"),
            weight=spec.get("weight", 1.0),
            format=spec.get("format", "parquet"),
            options=spec.get("options", {}),
            split_column=spec.get("split_column", "split"),
            **{name: spec.get(name) for name in optional},
        )


@dataclass(frozen=True)
class Mixture:
    datasets: Sequence[Member]
    seed: int = 0
    test_split_size: float | None = None

    def __post_init__(self) -> None:
        if not self.datasets:
            raise ValueError("the mixture names no datasets")
        if self.test_split_size is not None:
            check_fraction(self.test_split_size, "test_split_size", upper_closed=False)
        object.__setattr__(self, "datasets", tuple(_unique_labels(self.datasets)))

    @classmethod
    def from_dict(cls, spec: Any) -> Mixture:
        if not isinstance(spec, Mapping) or "datasets" not in spec:
            raise ValueError("a mixture is a mapping with the key 'datasets'")
        members = spec["datasets"]
        if not isinstance(members, list):
            raise ValueError("'datasets' must be a list of member specifications")
        return cls(
            datasets=[Member.from_dict(member) for member in members],
            seed=spec.get("seed", 0),
            test_split_size=spec.get("test_split_size"),
        )

    @classmethod
    def from_fractions(
        cls, fractions: Mapping[str, float], *, split: str = "train", seed: int = 0
    ) -> Mixture:
        """Short form: dataset id -> fraction of the rows of ``split``."""
        return cls(
            datasets=[
                Member(id=name, weight=fraction, split=split)
                for name, fraction in fractions.items()
            ],
            seed=seed,
        )


def check_fraction(value: Any, what: str, *, upper_closed: bool) -> float:
    """Reject a share outside (0, 1] or (0, 1)."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{what} must be a number, got {value!r}")
    if not (0 < value < 1 or (upper_closed and value == 1)):
        bracket = "]" if upper_closed else ")"
        raise ValueError(f"{what} must be in (0, 1{bracket}, got {value!r}")
    return float(value)


def _unique_labels(members: Sequence[Member]) -> list[Member]:
    """Number members that share a label, so their sampling keys differ."""
    seen: dict[str, int] = {}
    out = []
    for member in members:
        times = seen[member.label] = seen.get(member.label, 0) + 1
        out.append(member if times == 1 else replace(member, name=f"{member.label}#{times}"))
    if len({member.label for member in out}) != len(out):
        raise ValueError("member names of a mixture must be unique")
    return out
