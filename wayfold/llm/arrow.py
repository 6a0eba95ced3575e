"""Row-wise Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes of what is worked on at once; texts may be long, and a worker holds one part and what it makes of it.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | StructType, most: int = BATCH_BYTES) -> DataFrame:
    """``make()`` runs once per task and returns what maps the columns of a batch to new columns.

    A batch of over ``most`` bytes is worked on in parts, down to single rows.  Sets the session's Arrow batch
    size to BATCH_ROWS, and to four times BATCH_BYTES where it has such a limit, unless they are smaller already.
    """
    conf = df.sparkSession.conf
    for key, limit in ((_ROWS, BATCH_ROWS), (_BYTES, 4 * BATCH_BYTES)):
        held = conf.get(key, None)
        if held is not None and not (held.isdigit() and 0 < int(held) <= limit):
            conf.set(key, str(limit))
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch, most):
                out = work({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of at most ``most`` bytes, or of one row."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), most)
        yield from parts(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
