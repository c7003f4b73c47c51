"""Add columns to rows in Arrow batches, without leaving their task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from shelfspark.llm.text_batches import slices
from shelfspark.session import ship_package


def with_text_columns(docs: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None, text: str = "text", also: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and the new ``fields``, row by row.

    ``make()`` is called once in a task and gives a function from a slice of rows
    to a list of arrays, one for each field; the slice holds the columns of
    ``also`` by name, and the text as ``_text``. Kept columns pass by position,
    so they may have any name; one named like a new field goes, whatever its
    case.
    """
    new = _parse_datatype_string(fields)
    names = {f.name.lower() for f in new.fields}
    kept, extra = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names], list(also or [])
    source = docs.select(*[docs[c].alias(f"kept{i}") for i, c in enumerate(kept)], *[docs[c].alias(f"also{i}") for i, c in enumerate(extra)], docs[text].cast("string").alias("body"))
    schema = StructType([StructField(c, source.schema[f"kept{i}"].dataType) for i, c in enumerate(kept)] + new.fields)
    n = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, "body"):
            seen = pa.RecordBatch.from_arrays(batch.columns[n:], [*extra, "_text"])
            columns = [*batch.columns[:n], *(c if isinstance(c, pa.Array) else pa.array(c) for c in work(seen))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    ship_package(docs.sparkSession)
    return source.mapInArrow(run, schema)


def text_rows(docs: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], keep: list[str], text: str = "text") -> DataFrame:
    """Rows of the new ``fields`` alone: any number of batches for each slice of rows."""
    source = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, "_text"):
            yield from work(batch)
        yield from work(None)

    ship_package(docs.sparkSession)
    return source.mapInArrow(run, fields)
