"""Folds over sorted keys that carry only their state from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def folded(df: DataFrame, key: Sequence[str], order: Sequence[str], start: Callable, step: Callable, schema: str, unit: str | None = None, finish: Callable | None = None) -> DataFrame:
    """step(state, rows) over each key's rows in order, from start() on; finish(state, key) at the end of a key. Either may give None.

    Rows of a key come to one task in sorted order and go through it batch by batch; only
    the state, and with `unit` the rows of the unit that a batch ends in, are carried on.
    """
    whole = [*key, unit] if unit else []

    def parts(f: pd.DataFrame, state: list) -> Iterator[pd.DataFrame]:
        for k, rows in f.groupby(list(key), sort=False, dropna=False):
            k = tuple(None if pd.isna(x) else x for x in k)
            if not state or state[0] != k:
                yield from ended(state)
                state[:] = [k, start()]
            out = step(state[1], rows)
            if out is not None:
                yield out

    def ended(state: list) -> Iterator[pd.DataFrame]:
        if state and finish is not None:
            out = finish(state[1], state[0])
            if out is not None:
                yield out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list = []
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            cut = len(f)
            if whole:
                other = np.flatnonzero(~(f[whole] == f[whole].iloc[-1]).all(axis=1).to_numpy())
                cut = int(other[-1]) + 1 if len(other) else 0
            held, f = (f.iloc[cut:] if cut < len(f) else None), f.iloc[:cut]
            if len(f):
                yield from parts(f, state)
        if held is not None:
            yield from parts(held, state)
        yield from ended(state)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)
