"""Ordered folds over keys of any length: one sort, then batches with the state carried from one to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(
    rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], list[tuple]], schema: str,
    finish: Callable[[Any], list[tuple]] | None = None,
) -> DataFrame:
    """For each key the rows that `step(state, row)` gives, row by row in order, and then those of `finish(state)`.

    The table is shuffled by key and sorted (the sort spills), and a task keeps one state and
    one batch, so a key of very many rows needs no more memory than a short one. `step` changes
    the state in place; its tuples, like those of `finish`, follow the columns of `schema`
    after those of the key.
    """
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    whole = {c: "Int64" for c, t in (p.split()[:2] for p in f"{kinds}, {schema}".replace("`", "").split(",")) if t in ("int", "long", "bigint")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        frame = lambda out: pd.DataFrame(out, columns=[*by, *names]).astype(whole)
        for batch in batches:
            out = []
            at = [batch.columns.get_loc(c) for c in by]
            for row in batch.itertuples(index=False):
                own = tuple(row[i] for i in at)
                if own != key:
                    if key is not None and finish is not None:
                        out += [(*key, *x) for x in finish(state)]
                    key, state = own, start()
                out += [(*own, *x) for x in step(state, row)]
            yield frame(out)
        if key is not None and finish is not None:
            yield frame([(*key, *x) for x in finish(state)])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{kinds}, {schema}")
