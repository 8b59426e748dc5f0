"""Preset modes of profiling."""

from __future__ import annotations

from seqloom.operators.profile import Params

#: Fixed values of the six modes: r, p, d, u, U, H, P.
PRESETS = {
    0: Params(1, 0.2, 10, 1, 1, 0.7, 0.01, main_gap=0.4),
    1: Params(5, 0.6, 2, 2, 1, 0.7, 0.1),
    2: Params(10, 0.7, 2, 5, 2, 0.7, 0.2),
    3: Params(50, 0.8, 2, 20, 5, 0.75, 0.1),
    4: Params(100, 1, 2, 50, 10, 0.8, 0.1),
    5: Params(100, 1, 1.5, 50, 10, 0.8, 0.15),
}


def mode(n: int = 3, **changes) -> Params:
    """A preset with single thresholds replaced."""
    return PRESETS[n].but(**changes)
