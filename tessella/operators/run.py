"""Runs: an ordered list of maps, repeated."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from ..plans.trace import BLACK, RED, StencilMap
from .grids import Grid, checkpointed, cut
from .stencil import apply_map
from .tiles import batches, grids_of, joined, parted, run_tiles, steps_on_tiles, tileable

CHECKPOINT_EVERY = 4


@dataclass
class RunResult:
    """Steps taken, seconds spent, and (kernel, seconds) of each step if traced."""

    steps: int = 0
    seconds: float = 0.0
    traced: list[tuple[str, float]] = field(default_factory=list)


def run(
    *maps: StencilMap, iters: int = 1, strategy: str | None = None, steps_per_shuffle: int = 4, tile: tuple[int, ...] | None = None,
    checkpoint_every: int = CHECKPOINT_EVERY, traced: bool = False,
) -> RunResult:
    """Run the maps in order, ``iters`` times; each map sees what the ones before it wrote.

    ``strategy``: None lets the planner choose (tiles for chains of straight reads,
    else map by map); ``map`` has it choose map by map; ``scatter`` forces the
    one-shuffle gather; ``tile`` runs ``steps_per_shuffle`` steps on halo tiles.
    Lineage is cut every ``checkpoint_every`` steps of longer runs. ``traced``
    evaluates and times each step.
    """
    steps: list[tuple[StencilMap, int | None]] = []
    for m in maps:
        steps += [(m, RED), (m, BLACK)] if m.both_colors else [(m, m.color)]
    steps *= iters
    out = RunResult(steps=len(steps))
    began = time.perf_counter()
    if strategy is None and not traced and (size := steps_on_tiles(steps)):
        strategy, steps_per_shuffle = "tile", min(size, steps_per_shuffle)
    if strategy == "map":
        strategy = None
    if strategy == "tile":
        if not tileable(steps):
            raise ValueError("tiles need straight reads, scalar members and grids of equal extents")
        parts, grids = list(batches(steps, steps_per_shuffle)), grids_of(steps)
        frame = joined(grids)
        for k, part in enumerate(parts, 1):
            frame = run_tiles(frame, grids, part, tile)
            if k < len(parts):  # all grids stay side by side, computed and written once a part
                frame = cut(grids[0].session.spark, frame)
        parted(frame, grids, steps)
        out.seconds = time.perf_counter() - began
        return out
    for k, (m, color) in enumerate(steps, 1):
        at = time.perf_counter()
        grids = apply_map(m, color, strategy)
        if traced or k % checkpoint_every == 0 and k < len(steps):
            for g in {id(a): a for a in m.args.values() if isinstance(a, Grid)}.values():
                if any(g is h for h in grids) or k % checkpoint_every == 0:
                    checkpointed(g)
        if traced:
            out.traced.append((m.kernel.__name__, time.perf_counter() - at))
    out.seconds = time.perf_counter() - began
    return out
