"""Helpers of operators that work on Arrow batches inside tasks."""

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of one piece of work inside a batch; a long text still makes a piece of its own size only.
PIECE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches go to Python workers in small pieces, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def once(key: tuple, make: Callable):
    """What ``make`` gives, made once per worker process.

    Functions travel by value, so a global of this package would be new in each task.
    """
    kept = sys.modules.setdefault("sproutscope_kept_by_worker", types.ModuleType("sproutscope_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Remembered:
    """Values of a worker's latest keys: two generations, of which the older goes when the newer is full.

    ``new`` may be read directly; a value found in ``old`` is new again.
    """

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def age(self) -> None:
        """Between two pieces of work, so that a reader's ``new`` stays the same during one."""
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}

    def older(self, key):
        found = self.old.get(key)
        if found is not None:
            self.new[key] = found
        return found


def sizes(column: pa.Array) -> list[int]:
    """Bytes of each value of a string, binary or 32-bit list column."""
    if pa.types.is_list(column.type):
        return [4 * (v or 0) for v in pc.list_value_length(column).to_pylist()]
    return [v or 0 for v in pc.binary_length(column).to_pylist()]


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``limit`` bytes of column ``name`` (one row at least)."""
    start = total = 0
    for row, size in enumerate(sizes(batch.column(name))):
        if row > start and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], compute: Callable) -> DataFrame:
    """``df`` without ``text`` and with ``fields``, which ``compute`` makes of a slice.

    ``compute`` takes a record batch and returns one Arrow array per field. The other columns
    pass through; one that has the name of a new field is replaced.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name != text]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                arrays = compute(part)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *arrays], names=schema.names)

    bounded_batches(df.sparkSession)
    return df.select(*[f.name for f in kept], text).mapInArrow(run, schema)
