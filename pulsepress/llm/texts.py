"""Python work on whole texts: Arrow batches in, rows out, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text worked on before rows are handed back; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20


def in_pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` have about ``limit`` bytes together."""
    start = held = 0
    for i, value in enumerate(batch.column(column)):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[str], tuple]], fields: str
) -> DataFrame:
    """Columns ``keep`` and, for every row, what ``make()`` computes from its text (NULL: empty).

    ``make`` runs once per task; the function it returns gives the values of ``fields``.
    """
    narrow = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    new = StructType.fromDDL(fields)
    schema = StructType([*narrow.schema.fields[:-1], *new.fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in in_pieces(batch, len(keep)):
                values = [work(x) for x in piece.column(len(keep)).to_pylist()]
                new_columns = [
                    pa.array([x[i] for x in values], types.field(len(keep) + i).type) for i in range(len(new))
                ]
                kept = [piece.column(i).cast(types.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *new_columns], names=types.names)

    return narrow.mapInArrow(run, schema)
