"""Windows of a sequence brought into the frame of the first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from trajecta.operators.folds import sorted_fold


def chain_alignments(pairs: DataFrame, by: list[str], window: str) -> DataFrame:
    """(by, window, scale, m) that bring each window into the first one's frame.

    pairs(by, window, scale, m) bring a window into the frame of the one before it:
    x -> scale * R x + t. The first window's own row does not count: it stays as it is. The
    chain is a fold in the order of the windows.
    """

    class Chain:
        scale, rotation, shift = 1.0, np.eye(3), np.zeros(3)
        first = True

    def step(s: Chain, row) -> list[tuple]:
        if not s.first:
            m = np.asarray(row.m, dtype=np.float64).reshape(3, 4)
            s.shift = s.shift + s.scale * (s.rotation @ m[:, 3])
            s.rotation, s.scale = s.rotation @ m[:, :3], s.scale * float(row.scale)
        s.first = False
        return [(int(getattr(row, window)), s.scale, np.concatenate([s.rotation, s.shift[:, None]], axis=1).ravel().tolist())]

    return sorted_fold(pairs.select(*by, window, "scale", "m"), by, [window], Chain, step, f"`{window}` int, scale double, m array<double>")
