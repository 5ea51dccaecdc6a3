"""Area of a union of boxes."""

from __future__ import annotations

import numpy as np


def union_area(boxes: np.ndarray) -> float:
    """boxes: rows of (xmin, ymin, xmax, ymax)."""
    if not len(boxes):
        return 0.0
    xs = np.unique(boxes[:, [0, 2]])
    total = 0.0
    for a, b in zip(xs, xs[1:]):
        live = boxes[(boxes[:, 0] <= a) & (boxes[:, 2] >= b)]
        if not len(live):
            continue
        live = live[np.argsort(live[:, 1])]
        top = np.maximum.accumulate(live[:, 3])
        start = live[:, 1].copy()
        start[1:] = np.maximum(start[1:], top[:-1])
        total += (b - a) * float(np.maximum(live[:, 3] - start, 0).sum())
    return total
