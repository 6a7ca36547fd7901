"""Row-local Python steps over Arrow batches that keep all other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

# A batch is worked on in slices of about this many text bytes at most, so that
# what a step holds in Python does not depend on how long the texts of a batch are.
SLICE_BYTES = 4 << 20


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of bounded text size; one long text is a piece."""
    if text is None or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[StructField],
    step: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    text: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns by default) plus what ``step`` returns for each row.

    ``step`` sees the ``inputs`` columns under their names. A kept column with the
    name of a new one gives way to it. ``text`` names the column that bounds a slice.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    carried = {f.name for f in kept}
    hidden = [name for name in dict.fromkeys(inputs) if name not in carried]
    schema = StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    names = list(inputs)
    quoted = ["`" + n.replace("`", "``") + "`" for n in [*(f.name for f in kept), *hidden]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                seen = pa.RecordBatch.from_arrays([batch.column(n) for n in names], names=names)
                columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                columns += [
                    a if isinstance(a, pa.Array) and a.type == arrow.field(len(kept) + i).type
                    else pa.array(a, arrow.field(len(kept) + i).type)
                    for i, a in enumerate(step(seen))
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*quoted).mapInArrow(run, schema)


class Recent:
    """Values of keys seen lately: a bounded table that keeps what was used since it last filled up.

    It only saves work, so what a task returns does not depend on it.
    """

    def __init__(self, entries: int) -> None:
        self.entries = entries
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def lookup(self, keys: Sequence[bytes], make: Callable[[list[bytes]], list], longest: int) -> list:
        """Values of ``keys``; unknown ones come from ``make``. Longer keys are not remembered."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        missing = {k for k, v in zip(keys, found) if v is None}
        again = {k: v for k in missing if (v := self.old.get(k)) is not None}
        new = list(missing - again.keys())
        again.update(zip(new, make(new)))
        out = [again[k] if v is None else v for k, v in zip(keys, found)]
        if len(self.young) + len(again) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in again.items() if len(k) <= longest)
        return out
