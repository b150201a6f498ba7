"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def pandas_rows(batches: Iterable[pd.DataFrame], rows: int, text: str | None = None, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most ``rows`` rows and, but for single longer texts, ``chars`` characters."""
    for batch in batches:
        if not len(batch):
            continue
        length = batch[text].str.len().fillna(0).to_numpy() if text else np.zeros(len(batch))
        part = np.maximum(np.arange(len(batch)) // rows, (np.cumsum(length) // chars).astype(int))
        cut = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cut], [*cut, len(batch)]):
            yield batch.iloc[a:b]
