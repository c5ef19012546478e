"""Arrow-batch plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_rows(df: DataFrame, columns: list[str], emit: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``emit(*values)`` yields output rows for each input row; batches travel as Arrow."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out: list[tuple] = []
            for row in zip(*cols):
                out.extend(emit(*row))
            parts = list(zip(*out)) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(p), type=f.type) for p, f in zip(parts, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
