"""Ordered folds: a state machine run over each key's rows in order, in bounded memory.

Rows are dealt by key, sorted, and streamed as Arrow batches; a key's state is carried from batch to
batch, so a key of any length needs the memory of one batch and of its state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """df's rows by ``key`` in ``order`` through make().feed(key value, columns) -> columns of ``schema``, then .end(key value).

    feed gets a dict of NumPy arrays and returns a dict of arrays, or None for no rows.
    """
    names = df.columns
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        state, current, begun = None, None, False

        def rows(out):
            if out is not None and len(out[target.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], f.type, from_pandas=True) for n, f in zip(target.names, target)], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key)).to_pylist()
            columns = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
            at = 0
            while at < len(keys):
                end = at + 1
                if keys[-1] == keys[at]:
                    end = len(keys)
                else:
                    while end < len(keys) and keys[end] == keys[at]:
                        end += 1
                if not begun or keys[at] != current:
                    if begun and hasattr(state, "end"):
                        yield from rows(state.end(current))
                    state, current, begun = make(), keys[at], True
                yield from rows(state.feed(current, {n: c[at:end] for n, c in columns.items()}))
                at = end
        if begun and hasattr(state, "end"):
            yield from rows(state.end(current))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def same_key(value, n: int) -> np.ndarray:
    out = np.empty(n, object)
    out[:] = value
    return out
