"""A caller's function over look-back windows: matrices of windows in, records out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candlewick.operators.indicators import block_edges, whole_blocks
from candlewick.operators.series import halo_blocks

#: Windows that one call of the function gets: with 250 bars, 8 MB a column.
WINDOWS_PER_CALL = 4096

Hook = Callable[[Mapping[str, np.ndarray]], Mapping[str, Sequence]]


def window_records(
    bars: DataFrame, keys: Sequence[str], lookback: int, hook: Hook, record: str, columns: Sequence[str] = ("open", "high", "low", "close")
) -> DataFrame:
    """keys, idx, ts, ``columns`` of the right edge and the fields of ``record`` for every bar with ``lookback`` bars up to it.

    ``hook`` gets a matrix per column, one window a row and the edge last, and returns a
    sequence per field, one value a window. It runs inside tasks, so it is a function
    of a module that executors have. What it sees is causal: no bar after the edge. Windows
    of long series are spread over blocks; a call may hold windows of several series.
    """
    keys, columns = list(keys), list(columns)
    fields = StructType.fromDDL(record)
    needed = bars.select(*keys, "idx", "ts", *columns)
    schema = StructType([*needed.schema.fields, *fields.fields])
    arrow, own = to_arrow_schema(schema), set(fields.names) - set(needed.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            edges = block_edges(table, lookback)
            views = {c: np.lib.stride_tricks.sliding_window_view(table[c].to_numpy(), lookback) for c in columns} if len(edges) else {}
            for at in range(0, len(edges), WINDOWS_PER_CALL):
                some = edges[at : at + WINDOWS_PER_CALL]
                found = hook({c: v[some - (lookback - 1)] for c, v in views.items()})
                kept = table.take(pa.array(some))
                made = [pa.array(found[f.name], from_pandas=True) if f.name in own else kept[f.name] for f in arrow]
                yield pa.Table.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow).combine_chunks().to_batches()[0]

    laid = halo_blocks(needed, before=lookback - 1).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "idx")
    return laid.mapInArrow(run, schema)
