"""Maps over tiles: blocks with halos as numpy arrays, several steps to one shuffle.

A cell goes to its tile and to those whose halo it lies in. With a halo as wide as
all offsets of the steps together, a tile runs these steps alone: what it computes
in the halo spoils from the outside by one step's offsets at a time, and never
reaches the tile. So k steps cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES, NUMPY
from ..plans.expr import Get, array, converted
from ..plans.planner import own_place
from ..plans.trace import StencilMap
from .grids import Grid

Step = tuple[StencilMap, int | None]


def tileable(steps: list[Step]) -> bool:
    """Straight reads, scalar members, equal extents."""
    dims = {tuple(a.dims) for m, _ in steps for a in m.args.values() if isinstance(a, Grid)}
    plain = all(not k.shape for m, _ in steps for a in m.args.values() if isinstance(a, Grid) for k in a.type.members.values())
    straight = all(c.dim == k and c.sign == 1 for m, _ in steps for g in m.traced.reads.values() for k, c in enumerate(g.index))
    return len(dims) == 1 and plain and straight


def halo(steps: list[Step], rank: int) -> list[int]:
    """Cells that a tile needs around it, a dimension."""
    out = [0] * rank
    for m, _ in steps:
        for k in range(rank):
            out[k] += max((abs(g.index[k].offset) for g in m.traced.reads.values()), default=0)
    return out


#: Tile edges by rank, and the widest halo that the planner takes on them.
EDGE = {1: 1 << 16, 2: 256, 3: 40}
WIDEST = {1: 1 << 12, 2: 32, 3: 8}
#: Moving reads from which a single map is better off on tiles (64^3: 26 reads 0.8 s against 1.7 s by scatter, 6 reads 1.1 against 0.8).
MANY_READS = 12


def steps_on_tiles(steps: list[Step]) -> int:
    """How many steps of a list the planner runs on tiles in one shuffle; 0 where map by map is better.

    A chain of two maps or more that move cells, or a map of ``MANY_READS``: one
    shuffle of a cell's few copies then takes the place of a shuffle a map of a
    row for every read.
    """
    moving = [sum(not own_place(g) for g in m.traced.reads.values()) for m, _ in steps]
    many = max(moving) >= MANY_READS
    if (sum(n > 0 for n in moving) < 2 and not many) or not tileable(steps):
        return 0
    dims = next(a.dims for m, _ in steps for a in m.args.values() if isinstance(a, Grid))
    room = [min(n, WIDEST[len(dims)]) for n in dims]
    for size in range(len(steps), 0 if many else 1, -1):
        if all(h <= r for part in batches(steps, size) for h, r in zip(halo(part, len(dims)), room, strict=True)):
            return size
    return 0


def _dealt(frame: DataFrame, dims: tuple[int, ...], tile: tuple[int, ...], width: list[int], wraps: bool) -> DataFrame:
    """Copies of every cell for the tiles that hold it: tile number and unwrapped coordinate an axis."""
    for axis, n, t, h in zip(AXES, dims, tile, width, strict=False):
        last = -(-n // t) - 1
        shifts = (-n, 0, n) if wraps and h else (0,)
        spots = F.array(*[F.col(axis) + F.lit(s) for s in shifts])
        tiles = f"sequence(greatest(0, cast(floor((u - {h}) / {t}) as int)), least({last}, cast(floor((u + {h}) / {t}) as int)))"
        pairs = (
            f"flatten(transform(filter(us, u -> u >= -{h} and u < {n + h}), u -> "
            f"transform(filter({tiles}, k -> u >= k * {t} - {h} and u < least((k + 1) * {t}, {n}) + {h}), k -> struct(k as k, u as u))))"
        )
        frame = frame.withColumn("us", spots).withColumn("p", F.explode(F.expr(pairs)))
        frame = frame.withColumn(f"k{axis}", F.col("p.k")).withColumn(f"u{axis}", F.col("p.u")).drop("us", "p")
    return frame


def grids_of(steps: list[Step]) -> list[Grid]:
    """All grids that some steps read or write, each once."""
    return list({id(a): a for m, _ in steps for a in m.args.values() if isinstance(a, Grid)}.values())


def joined(grids: list[Grid]) -> DataFrame:
    """The cells of several grids side by side; member ``m`` of grid i is ``g{i}_m``."""
    frame = None
    for i, g in enumerate(grids):
        part = g.frame.select(*g.axes, *(F.col(m).alias(f"g{i}_{m}") for m in g.type.members))
        frame = part if frame is None else frame.join(part, list(g.axes))
    return frame


def parted(frame: DataFrame, grids: list[Grid], steps: list[Step]) -> None:
    """Give the grids that some steps write their cells of a joined frame."""
    for i, g in enumerate(grids):
        if any(m.args[e.arg] is g for m, _ in steps for e in m.traced.emits):
            g.frame = frame.select(*g.axes, *(F.col(f"g{i}_{m}").alias(m) for m in g.type.members))


def run_tiles(frame: DataFrame, grids: list[Grid], steps: list[Step], tile: tuple[int, ...] | None = None) -> DataFrame:
    """The joined frame of ``grids`` after all steps, in one shuffle."""
    dims = grids[0].dims
    rank, axes = len(dims), AXES[: len(dims)]
    tile = tile or tuple(max(1, min(n, EDGE[rank])) for n in dims)
    width = halo(steps, rank)
    if any(h > n for h, n in zip(width, dims, strict=True)):
        raise ValueError("the halo is wider than the grid: run fewer steps a shuffle")
    wraps = any(g.periodic for m, _ in steps for g in m.traced.reads.values())
    place = {id(g): i for i, g in enumerate(grids)}
    kinds = {f"g{i}_{m}": k.kind for i, g in enumerate(grids) for m, k in g.type.members.items()}
    # plain data only goes to the workers: expressions, and the place of each argument
    plan = [
        (m.domain.ranges, color, [(f"g{place[id(m.args[e.arg])]}_{e.member}", e.value, e.condition) for e in m.traced.emits],
         {n: place[id(a)] for n, a in m.args.items() if isinstance(a, Grid)})
        for m, color in steps
    ]

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        key = [k.as_py() for k in key]
        low = [k * t - h for k, t, h in zip(key, tile, width, strict=True)]
        high = [min((k + 1) * t, n) + h for k, t, n, h in zip(key, tile, dims, width, strict=True)]
        shape = tuple(b - a for a, b in zip(low, high, strict=True))
        at = tuple(rows[f"u{a}"].to_numpy() - lo for a, lo in zip(axes, low, strict=True))
        held = {}
        for name, kind in kinds.items():
            held[name] = np.zeros(shape, NUMPY[kind])
            held[name][at] = rows[name].to_numpy()
        coords = [
            np.mod(np.arange(lo, hi), n).reshape([-1 if j == k else 1 for j in range(rank)])
            for k, (lo, hi, n) in enumerate(zip(low, high, dims, strict=True))
        ]
        with np.errstate(all="ignore"):
            for ranges, color, emits, where in plan:
                here = np.ones(shape, bool)
                for c, (a, b) in zip(coords, ranges, strict=True):
                    here &= (c >= a) & (c < b)
                if color is not None:
                    here &= sum(coords) % 2 == color

                def read(g: Get, where=where) -> np.ndarray:
                    value = held[f"g{where[g.arg]}_{g.member}"]
                    for k, c in enumerate(g.index):
                        if c.offset:
                            value = value.take(np.arange(shape[k]) + c.offset, axis=k, mode="clip")
                    return value

                new = []
                for name, value, condition in emits:
                    mask = here if condition is None else here & np.asarray(array(condition, read, coords)).astype(bool)
                    new.append((name, mask, np.broadcast_to(np.asarray(array(value, read, coords)), shape)))
                for name, mask, value in new:
                    held[name] = np.where(mask, converted(value, kinds[name]), held[name])
        core = tuple(slice(h, s - h) for h, s in zip(width, shape, strict=True))
        spots = np.indices(tuple(c.stop - c.start for c in core)).reshape(rank, -1)
        data = {a: (spots[k] + key[k] * tile[k]).astype("int32") for k, a in enumerate(axes)}
        return pa.table(data | {n: np.ascontiguousarray(held[n][core]).reshape(-1) for n in kinds})

    names = {"int": "int", "long": "bigint", "float": "float", "double": "double"}
    schema = ", ".join([f"{a} int" for a in axes] + [f"{n} {names[k]}" for n, k in kinds.items()])
    return _dealt(frame, dims, tile, width, wraps).groupBy(*(f"k{a}" for a in axes)).applyInArrow(work, schema)


def batches(steps: list[Step], size: int) -> Iterator[list[Step]]:
    for k in range(0, len(steps), size):
        yield steps[k : k + size]
