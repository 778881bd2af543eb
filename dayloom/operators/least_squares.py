"""Least squares from cross-product matrices, many small systems at a time."""

from __future__ import annotations

import numpy as np

# A pivot this small next to its starting value is a column the earlier ones
# already explain; it is left out and not counted in the rank.
RANK_TOLERANCE = 1e-11


class Residuals:
    """Cross-products of what is left of every column after regressing out some.

    `cross` is a stack (systems, columns, columns) of symmetric matrices.
    """

    def __init__(self, cross: np.ndarray):
        self.cross = np.array(cross, dtype=float)
        self.start = np.einsum("sii->si", self.cross).copy()
        self.rank = np.zeros(len(self.cross), dtype=int)

    def remove(self, column: int, only: np.ndarray | None = None) -> None:
        """Regress `column` out of all columns (of the systems in `only`)."""
        pivot = self.cross[:, column, column]
        usable = pivot > RANK_TOLERANCE * np.maximum(self.start[:, column], 1e-300)
        if only is not None:
            usable &= only
        weight = np.where(usable, 1.0 / np.where(usable, pivot, 1.0), 0.0)
        edge = self.cross[:, :, column]
        self.cross = self.cross - weight[:, None, None] * edge[:, :, None] * edge[:, None, :]
        self.rank += usable

    def left(self, column: int) -> np.ndarray:
        """Residual sum of squares of a column."""
        return np.maximum(self.cross[:, column, column], 0.0)

    def explained(self, column: int) -> np.ndarray:
        """Whether a column is constant or fully explained so far."""
        return self.cross[:, column, column] <= RANK_TOLERANCE * np.maximum(self.start[:, column], 1e-300)


def stacked(flat, order: int) -> np.ndarray:
    """Series of flattened matrices to a (rows, order, order) stack."""
    return np.stack([np.asarray(m, dtype=float) for m in flat]).reshape(-1, order, order)
