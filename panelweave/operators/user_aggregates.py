"""Aggregates that the caller writes, in two phases.

`update` folds the rows of a key inside a task into a small state, `merge` folds states, `finish` makes the result. Only
states are shuffled, one for each key and task, so a key with a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys that a task holds before it passes their states on.
HELD_KEYS = 200_000


@dataclass(frozen=True)
class UserAggregate:
    """`init()` gives an empty state (tuple), `update(state, rows)` takes a data frame of one key, `merge(state, state)` and
    `finish(state)` (tuple of results). `state` and `result` are DDL columns."""

    state: str
    result: str
    init: Callable[[], tuple]
    update: Callable[[tuple, pd.DataFrame], tuple]
    merge: Callable[[tuple, tuple], tuple]
    finish: Callable[[tuple], tuple]


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(",")]


def aggregate(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], agg: UserAggregate) -> DataFrame:
    """One row per key: the keys and the columns of `agg.result`. A key may be NULL."""
    keys, inputs = list(keys), list(inputs)
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    states, results = _names(agg.state), _names(agg.result)

    def table(held: dict[tuple, tuple], types: pa.Schema, names: list[str]) -> pa.RecordBatch:
        rows = [(*k, *s) for k, s in held.items()]
        cols = list(zip(*rows)) if rows else [()] * (len(keys) + len(names))
        return pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type if n in types.names else None) for c, n in zip(cols, [*keys, *names])], [*keys, *names])

    def partial(batches):
        held: dict[tuple, tuple] = {}
        types = pa.schema([])
        for b in batches:
            types = pa.schema([b.schema.field(k) for k in keys])
            for key, rows in b.to_pandas().groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = agg.update(held[key] if key in held else agg.init(), rows[inputs])
            if len(held) > HELD_KEYS:
                yield table(held, types, states)
                held = {}
        if held:
            yield table(held, types, states)

    def final(key: tuple, rows: pa.Table) -> pa.Table:
        state = None
        for row in zip(*(rows.column(c).to_pylist() for c in states)):
            state = row if state is None else agg.merge(state, row)
        out = agg.finish(state)
        return pa.table([rows.column(k).slice(0, 1) for k in keys] + [pa.array([v]) for v in out], names=[*keys, *results])

    parts = df.select(*keys, *inputs).mapInArrow(partial, f"{key_ddl}, {agg.state}")
    return parts.groupBy(*keys).applyInArrow(final, f"{key_ddl}, {agg.result}")
