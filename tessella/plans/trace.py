"""Tracing: a kernel is called once with symbolic coordinates and grids."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from ..model import AXES, Domain
from .expr import Const, Coord, Expr, Get, When, gets, lift

RED, BLACK = 0, 1


@dataclass
class Emit:
    """A write at the kernel's own place: grid argument, member, element path, value, condition."""

    arg: str
    member: str
    path: tuple[int, ...]
    value: Expr
    condition: Expr | None


@dataclass
class Traced:
    """What a kernel reads and writes."""

    emits: list[Emit]
    reads: dict[tuple, Get]
    guarded: dict[tuple, bool]
    value: Expr | None = None

    def ranges(self, arg: str, rank: int) -> list[tuple[int, int]]:
        """Least and greatest offset a dimension over the plain reads of an argument."""
        out = [(0, 0)] * rank
        for g in self.reads.values():
            if g.arg == arg:
                for k, c in enumerate(g.index[:rank]):
                    out[k] = (min(out[k][0], c.offset), max(out[k][1], c.offset))
        return out


class _Element:
    """``g[x, y]`` of a struct or array cell: members and elements are taken from it."""

    def __init__(self, make: Callable, members: dict, member: str | None = None, path: tuple[int, ...] = ()):
        self._make, self._members, self._member, self._path = make, members, member, path

    def __getattr__(self, name: str):
        name = name if name in self._members else f"m_{name}"
        if self._member is not None or name not in self._members:
            raise AttributeError(f"no member {name}")
        return _Element(self._make, self._members, name, ())._done()

    def __getitem__(self, i: int):
        return _Element(self._make, self._members, self._member, (*self._path, int(i)))._done()

    def _done(self):
        shape = self._members[self._member].shape
        if len(self._path) < len(shape):
            if self._path and not 0 <= self._path[-1] < shape[len(self._path) - 1]:
                raise IndexError(f"{self._member}{list(self._path)} is outside {shape}")
            return self
        if any(not 0 <= p < n for p, n in zip(self._path, shape, strict=True)):
            raise IndexError(f"{self._member}{list(self._path)} is outside {shape}")
        return self._make(self._member, self._path)


class _Emitter:
    def __init__(self, ref: GridRef, member: str, path: tuple[int, ...] = ()):
        self._ref, self._member, self._path = ref, member, path

    def __getitem__(self, i: int) -> _Emitter:
        return _Emitter(self._ref, self._member, (*self._path, int(i)))

    def emit(self, value) -> None:
        self._ref._emit(self._member, self._path, value, None)

    def emit_if(self, condition, value) -> None:
        self._ref._emit(self._member, self._path, value, condition)


class GridRef:
    """A grid argument inside a kernel."""

    def __init__(self, name: str, grid, log: list[Emit], periodic: bool = False):
        self._name, self._grid, self._log, self._wraps = name, grid, log, periodic

    @property
    def periodic(self) -> GridRef:
        return GridRef(self._name, self._grid, self._log, True)

    def dim(self, d: int) -> int:
        return self._grid.dims[d]

    def __getitem__(self, index):
        index = index if isinstance(index, tuple) else (index,)
        if len(index) != len(self._grid.dims):
            raise IndexError(f"{self._name} has {len(self._grid.dims)} dimensions, not {len(index)}")
        coords = []
        for i in index:
            if isinstance(i, Coord):
                coords.append(i if i.sign else Coord(0, 0, i.offset))
            elif isinstance(i, Const):
                coords.append(Coord(0, 0, int(i.value)))
            elif isinstance(i, Expr):
                raise TypeError("an index is one coordinate, plus or minus a constant, or a constant")
            else:
                coords.append(Coord(0, 0, int(i)))
        place = tuple(coords)
        members = self._grid.type.members

        def make(member: str, path: tuple[int, ...]) -> Get:
            for e in self._log:
                if e.arg == self._name and e.member == member and all((c.dim, c.sign, c.offset) == (k, 1, 0) for k, c in enumerate(place)):
                    if e.path[: len(path)] == path or path[: len(e.path)] == e.path:
                        raise ValueError(f"{self._name}.{member} is read after it was emitted in the same call; keep the value in a variable")
            return Get(self._name, place, self._wraps, member, path, members[member].kind)

        return make("v", ()) if self._grid.type.primitive else _Element(make, members)

    def _emit(self, member: str, path: tuple[int, ...], value, condition) -> None:
        m = self._grid.type.members[member]
        if len(path) != len(m.shape):
            raise ValueError(f"{member} has {len(m.shape)} array dimensions")
        if any(not 0 <= p < n for p, n in zip(path, m.shape, strict=True)):
            raise IndexError(f"{member}{list(path)} is outside {m.shape}")
        self._log.append(Emit(self._name, member, path, lift(value), None if condition is None else lift(condition)))

    def emit(self, value) -> None:
        """Write a cell: a value, a whole read struct, or {member: value or nested lists}."""
        self.emit_if(None, value)

    def emit_if(self, condition, value) -> None:
        members = self._grid.type.members
        if self._grid.type.primitive:
            self._emit("v", (), value, condition)
            return

        def spread(name: str, shape: tuple[int, ...], held, path: tuple[int, ...]) -> None:
            if len(path) == len(shape):
                self._emit(name, path, held, condition)
            else:
                for i in range(shape[len(path)]):
                    spread(name, shape, held[i], (*path, i))

        for name, m in members.items():
            plain = name[2:] if name.startswith("m_") else name
            held = value[plain] if isinstance(value, dict) else getattr(value, name)
            spread(name, m.shape, held, ())

    def _edge(self) -> Expr:
        """Whether the place is on the grid's boundary."""
        out = None
        for k, n in enumerate(self._grid.dims):
            here = (Coord(k) == 0) | (Coord(k) == n - 1)
            out = here if out is None else out | here
        return out

    def emit_dirichlet(self, value) -> None:
        """Write a constant at the grid's boundary, over what was emitted there."""
        self.emit_if(self._edge(), value)

    def emit_neumann(self, source: GridRef, factor=1) -> None:
        """Write, at the grid's boundary, the inner neighbour in ``source`` times ``factor``, over what was emitted there.

        The inner neighbour is one step inwards along every axis at whose end the place lies.
        """
        dims = self._grid.dims
        if any(n < 2 for n in dims):
            raise ValueError(f"{dims} has no inner neighbours")

        def pick(index: tuple) -> Expr:
            k = len(index)
            if k == len(dims):
                return source[index]
            c = Coord(k)
            return When(c == 0, pick((*index, c + 1)), When(c == dims[k] - 1, pick((*index, c - 1)), pick((*index, c))))

        self.emit_if(self._edge(), pick(()) * lift(factor))

    def __getattr__(self, name: str) -> _Emitter:
        members = self._grid.type.members
        for n in (name, f"m_{name}"):
            if n in members and not self._grid.type.primitive:
                return _Emitter(self, n)
        raise AttributeError(name)


@dataclass
class StencilMap:
    """A kernel bound to a domain and arguments: a node of the plan."""

    kernel: Callable
    domain: Domain
    args: dict[str, object]
    color: int | None = None
    both_colors: bool = False
    traced: Traced = field(init=False)

    def __post_init__(self):
        self.traced = trace(self.kernel, self.domain, self.args)


def trace(kernel: Callable, domain: Domain, args: dict[str, object], returns: bool = False) -> Traced:
    log: list[Emit] = []
    coords = [Coord(k) for k in range(domain.rank)]
    refs = [GridRef(n, a, log) if hasattr(a, "dims") else a for n, a in args.items()]
    value = kernel(*coords, *refs)
    if returns != (value is not None):
        raise TypeError("a map's kernel emits and returns nothing; a reduction's kernel returns its value")
    out = Traced(log, {}, {}, lift(value) if returns else None)
    trees = [(e.value, e.condition is not None) for e in log] + [(e.condition, False) for e in log if e.condition is not None]
    if returns:
        trees.append((out.value, False))
    for tree, under in trees:
        for g, guarded in gets(tree, under):
            out.reads.setdefault(g.place, g)
            out.guarded[g.place] = out.guarded.get(g.place, True) and guarded
    check(out, domain, args)
    return out


def check(t: Traced, domain: Domain, args: dict) -> None:
    """Bounds of unguarded reads, and writes that would meet in one cell."""
    for place, g in t.reads.items():
        for c, n in zip(g.index, args[g.arg].dims, strict=True):
            if g.periodic and c.sign == 0 and not 0 <= c.offset < n:
                raise IndexError(f"constant index {c.offset} of {g.arg} is outside 0 to {n - 1}")
            if g.periodic or t.guarded[place]:
                continue
            low, high = domain.ranges[c.dim] if c.sign else (0, 1)
            if low >= high:
                continue
            ends = (c.offset + c.sign * low, c.offset + c.sign * (high - 1))
            if min(ends) < 0 or max(ends) >= n:
                raise IndexError(f"{g.arg} is read at {min(ends)} to {max(ends)} of {n} cells; guard the read with when()")
    for e in t.emits:
        grid = args[e.arg]
        if len(grid.dims) != domain.rank:
            raise ValueError(f"{e.arg} has rank {len(grid.dims)}: a map over rank {domain.rank} would write its cells many times")
        if any(b > n and b > a for (a, b), n in zip(domain.ranges, grid.dims, strict=True)) or any(a < 0 for a, _ in domain.ranges):
            raise IndexError(f"{domain} is not inside {e.arg} {grid.dims}")


def _names(kernel: Callable, rank: int, args: tuple) -> dict[str, object]:
    names = list(inspect.signature(kernel).parameters)[rank:]
    if len(names) != len(args):
        raise TypeError(f"{kernel.__name__} takes {len(names)} arguments after its {rank} coordinates, not {len(args)}")
    for name, a in zip(names, args, strict=True):
        if not hasattr(a, "dims") and not isinstance(a, (int, float, Expr)) and not hasattr(a, "dtype"):
            raise TypeError(f"{name} is neither a grid nor a number")
    return dict(zip(names, args, strict=True))


def smap(kernel: Callable, domain: Domain, *args) -> StencilMap:
    """A map over a domain."""
    return StencilMap(kernel, domain, _names(kernel, domain.rank, args))


def smap_red(kernel: Callable, domain: Domain, *args) -> StencilMap:
    """Only places of even coordinate sum."""
    return StencilMap(kernel, domain, _names(kernel, domain.rank, args), RED)


def smap_black(kernel: Callable, domain: Domain, *args) -> StencilMap:
    """Only places of odd coordinate sum."""
    return StencilMap(kernel, domain, _names(kernel, domain.rank, args), BLACK)


def smap_redblack(kernel: Callable, domain: Domain, *args) -> StencilMap:
    """The red places, then the black ones, which see the red results."""
    return StencilMap(kernel, domain, _names(kernel, domain.rank, args), None, True)


AXIS_NAMES = AXES
