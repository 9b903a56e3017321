"""How the cells that a map reads reach the cells it writes.

* ``pointwise``: all reads are at the own place of grids that live in one frame.
* ``window``: reads along one axis of one grid: ``lag`` and ``lead`` in partitions of
  the other axes.
* ``scatter``: every source cell is sent to the places that read it, and one
  ``groupBy`` on the place collects them: one shuffle for any number of offsets
  and grids.
* ``tile``: blocks with halos as numpy arrays, several steps to a shuffle. Chains of
  maps that read straight neighbours on grids of equal extents run this way
  (``tiles.steps_on_tiles``); ``choose`` below plans the maps of all others.

Reads that can't be inverted (constant planes, grids of lower rank) are joined on
the coordinates they use, beside either strategy.
"""

from __future__ import annotations

from math import prod

from .expr import Get
from .trace import Traced

#: Cells of a grid that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_CELLS = 200_000


def own_place(g: Get) -> bool:
    return all((c.dim, c.sign, c.offset) == (k, 1, 0) for k, c in enumerate(g.index))


def invertible(g: Get, rank: int) -> bool:
    """Whether a source cell knows which places read it."""
    return len(g.index) == rank and sorted(c.dim for c in g.index if c.sign) == list(range(rank))


def broadcastable(dims: tuple[int, ...]) -> bool:
    return prod(dims) <= BROADCAST_CELLS


def choose(t: Traced, rank: int, base: str, same_frame) -> str:
    """The strategy of a map whose written grid is ``base``; ``same_frame(arg)``: the argument is that grid."""
    moving = [g for g in t.reads.values() if invertible(g, rank) and not own_place(g)]
    if not moving:
        return "pointwise"
    axes = {k for g in moving for k, c in enumerate(g.index) if c.offset or c.sign != 1}
    straight = all(c.dim == k and c.sign == 1 for g in moving for k, c in enumerate(g.index))
    one_grid = all(same_frame(g.arg) for g in moving)
    if rank > 1 and len(axes) == 1 and straight and one_grid and not any(g.periodic for g in moving):
        return "window"
    return "scatter"
