"""Folds along time: each symbol's rows in order, a chunk at a time.

Rows are dealt by key and sorted inside the partitions; tasks then stream Arrow
batches and carry a small state from one to the next, so a symbol may have any
number of rows.  Symbols of one task follow one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns a state and the next rows of a key into the next state and the rows that these give.
Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


def fold(frame: DataFrame, order: list[str | Column], start: Callable[[], Any], step: Step, schema: str, finish: Callable[[Any], pd.DataFrame | None] | None = None, key: str = "symbol") -> DataFrame:
    """Rows that ``step`` gives for each key's rows in order; ``finish`` may add some at a key's end.

    ``start`` makes the state of a key.  Rows of a null key are one key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, seen = None, None, False
        for batch in batches:
            if not len(batch):
                continue
            names = batch[key].to_numpy(object)
            change = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] and not (pd.isna(names[i]) and pd.isna(names[i - 1]))), len(names)]
            for low, high in zip(change, change[1:]):
                name = names[low]
                if not seen or not (name == current or (pd.isna(name) and pd.isna(current))):
                    if seen and finish is not None and (tail := finish(state)) is not None and len(tail):
                        yield tail
                    state, current, seen = start(), name, True
                state, out = step(state, batch.iloc[low:high])
                if out is not None and len(out):
                    yield out
        if seen and finish is not None and (tail := finish(state)) is not None and len(tail):
            yield tail

    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, key).sortWithinPartitions(F.col(key), *order).mapInPandas(run, schema)


def fields(frame: DataFrame) -> str:
    """The frame's columns as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
