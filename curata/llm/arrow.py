"""Columns computed from whole texts in Arrow batches; all other columns pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def release() -> None:
    """Gives what a finished task's arrays held back to the system: workers live on beside those of other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_text(docs: DataFrame, make: Callable[[list], dict[str, list]], added: str, rows: int = 256, column: str = "text") -> DataFrame:
    """docs with the columns that make returns for a list of texts (null: None), at most rows of them at a time.

    Columns of docs that share a name with an added one are replaced.
    """
    new = StructType.fromDDL(added)
    kept = [c for c in docs.columns if c not in new.names]
    schema = StructType([docs.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(new)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(made[f.name], f.type) for f in out)], names=[*part.schema.names, *new.names])
        release()

    return docs.select(*kept).mapInArrow(run, schema)
