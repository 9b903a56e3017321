"""Run settings: kept in files, and chosen by trial.

The planner decides from the shape of the reads alone; ``tuned`` times a short
run of each of some settings instead and returns the fastest.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from itertools import product
from pathlib import Path

from ..plans.trace import StencilMap
from .grids import Grid
from .run import CHECKPOINT_EVERY, RunResult, run
from .tiles import tileable


@dataclass(frozen=True)
class Settings:
    """What ``run`` takes besides its maps."""

    strategy: str | None = None
    steps_per_shuffle: int = 4
    tile: tuple[int, ...] | None = None
    checkpoint_every: int = CHECKPOINT_EVERY

    @staticmethod
    def of(values: dict) -> Settings:
        unknown = set(values) - {f.name for f in fields(Settings)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        values = dict(values)
        if values.get("tile") is not None:
            values["tile"] = tuple(values["tile"])
        return Settings(**values)

    @staticmethod
    def load(path: str) -> Settings:
        """From a JSON file on the driver."""
        return Settings.of(json.loads(Path(path).read_text()))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    def run(self, *maps: StencilMap, iters: int = 1) -> RunResult:
        return run(*maps, iters=iters, **asdict(self))


def patterns(*maps: StencilMap, steps: tuple[int, ...] = (1, 2, 4), edges: tuple[int, ...] = (16, 32, 64)) -> list[Settings]:
    """Settings worth a trial: map by map, the one-shuffle gather, and tiles of some edges and depths."""
    out = [Settings("map"), Settings("scatter")]
    grids = [a for m in maps for a in m.args.values() if isinstance(a, Grid)]
    if tileable([(m, None) for m in maps]):
        dims = grids[0].dims
        tiles = dict.fromkeys(tuple(min(e, n) for n in dims) for e in edges)
        out += [Settings("tile", s, t) for s, t in product(steps, tiles)]
    return out


def tuned(*maps: StencilMap, iters: int = 1, settings: list[Settings] | None = None) -> tuple[Settings, dict[Settings, float]]:
    """The fastest of some settings for these maps, and the seconds of each; the grids are as before.

    Each runs ``iters`` times and has its written grids evaluated in full; settings
    that can't run these maps (a halo wider than the grid) are left out.
    """
    grids = list({id(a): a for m in maps for a in m.args.values() if isinstance(a, Grid)}.values())
    held = [g.frame for g in grids]
    seconds: dict[Settings, float] = {}
    for choice in settings or patterns(*maps):
        try:
            took = choice.run(*maps, iters=iters).seconds
            for g, before in zip(grids, held, strict=True):
                if g.frame is not before:
                    took += g.evaluated()
            seconds[choice] = took
        except ValueError:
            pass
        finally:
            for g, before in zip(grids, held, strict=True):
                g.frame = before
    return min(seconds, key=seconds.get), seconds
