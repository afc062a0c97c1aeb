"""Percentiles of sliding frames, used inside tasks on one bounded run of values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Frames that are sorted together.
BLOCK = 10_000


def sliding_percentiles(
    values: np.ndarray, rows: int, shares: Sequence[float], skip: int = 0
) -> list[np.ndarray]:
    """Per share, the percentile of the last ``rows`` values at each place from ``skip`` on.

    It is interpolated at ``(n - 1) * share``; absent values (NaN) are left out.
    """
    padded = np.concatenate([np.full(rows - 1, np.nan), values])
    frames = np.lib.stride_tricks.sliding_window_view(padded, rows)
    seen = np.concatenate([[0], np.cumsum(~np.isnan(padded))])
    last = np.maximum(seen[rows:] - seen[:-rows] - 1, 0)
    results = [np.empty(len(values) - skip) for _ in shares]
    for start in range(skip, len(values), BLOCK):
        stop = min(start + BLOCK, len(values))
        ordered = np.sort(frames[start:stop], axis=1)  # NaN comes last
        row = np.arange(stop - start)
        for result, share in zip(results, shares):
            spot = last[start:stop] * share
            low = np.floor(spot).astype(int)
            lower, upper = ordered[row, low], ordered[row, np.ceil(spot).astype(int)]
            result[start - skip:stop - skip] = lower + (upper - lower) * (spot - low)
    return results
