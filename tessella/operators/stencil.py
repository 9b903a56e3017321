"""One map as a DataFrame: gather the cells it reads, evaluate, keep the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, PRIMITIVES
from ..plans.expr import Coord, Get, c_arithmetic, column, gets, to_kind, truth
from ..plans.planner import broadcastable, choose, invertible
from ..plans.trace import StencilMap, Traced
from .grids import Grid, nested


def _read_columns(m: StencilMap) -> dict[tuple, dict[str, str]]:
    """Column name of each (place, member) that the kernel reads."""
    out: dict[tuple, dict[str, str]] = {}
    for e in m.traced.emits:
        for tree in (e.value, e.condition):
            for g, _ in gets(tree) if tree is not None else ():
                n = list(m.traced.reads).index(g.place)
                out.setdefault(g.place, {})[g.member] = f"r{n}_{g.member}"
    return out


def active(m: StencilMap, color: int | None, axes: tuple[str, ...] = AXES) -> Column:
    """The places that the map writes: its domain, and one colour of it."""
    here = m.domain.predicate(axes)
    if color is not None:
        total = sum((F.col(a) for a in axes[1 : m.domain.rank]), F.col(axes[0]))
        here &= F.pmod(total, F.lit(2)) == color
    return here


def _mapped(c: Coord, axes, n: int | None) -> Column:
    """The source coordinate that index ``c`` names, wrapped to ``n`` cells if given."""
    value = F.col(axes[c.dim]) * F.lit(c.sign) + F.lit(c.offset) if c.sign else F.lit(c.offset)
    return F.pmod(value, F.lit(n)) if n else value


def _scatter(m: StencilMap, targets: dict[str, Grid], reads: dict[tuple, dict[str, str]], color: int | None) -> DataFrame:
    """Send every source cell to the places that read it; one groupBy collects them."""
    dims = next(iter(targets.values())).dims
    axes = AXES[: len(dims)]
    sources: dict[int, tuple[Grid, list]] = {}
    slot = 0
    wanted: list[tuple[int, str, str]] = []  # slot, source column, result column
    for name, grid in targets.items():
        held = sources.setdefault(id(grid), (grid, []))
        held[1].append((slot, None))
        wanted += [(slot, f"s{id(grid)}_{member}", f"o_{name}_{member}") for member in grid.type.members]
        slot += 1
    for place, names in reads.items():
        grid = m.args[place[0]]
        get = m.traced.reads[place]
        held = sources.setdefault(id(grid), (grid, []))
        held[1].append((slot, get))
        wanted += [(slot, f"s{id(grid)}_{member}", out) for member, out in names.items()]
        slot += 1
    parts = []
    to = tuple(f"t{a}" for a in axes)
    for grid, slots in sources.values():
        sent = []
        for number, get in slots:
            spot: list[Column | None] = [None] * len(axes)
            if get is None:
                spot = [F.col(a) for a in axes]
            else:
                # the reader's coordinate from the source's: index = sign * place + offset
                for own, c, n in zip(axes, get.index, grid.dims, strict=True):
                    back = (F.col(own) - F.lit(c.offset)) * F.lit(c.sign)
                    if get.periodic:
                        back = F.pmod(back, F.lit(n))
                    spot[c.dim] = back
            sent.append(F.struct(*(s.cast("int").alias(t) for s, t in zip(spot, to, strict=True)), F.lit(number).alias("slot")))
        rows = grid.frame.withColumn("sent", F.explode(F.array(*sent)))
        values = [F.col(member).alias(f"s{id(grid)}_{member}") for member in grid.type.members]
        rows = rows.select("sent.*", *values)
        keep = F.col("slot") < len(targets)
        inside = F.lit(True)
        for t, n in zip(to, dims, strict=True):
            inside &= F.col(t).between(0, n - 1)
        parts.append(rows.where(inside & (keep | active(m, color, to))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    picked = [F.max(F.when(F.col("slot") == n, F.col(src))).alias(out) for n, src, out in wanted]
    return rows.groupBy(*(F.col(t).alias(a) for t, a in zip(to, axes, strict=True))).agg(*picked)


def _window(base: Grid, name: str, reads: dict[tuple, dict[str, str]], m: StencilMap) -> DataFrame:
    """Reads along one axis: lag and lead over the lines of the grid."""
    axes = base.axes
    moving = next(k for p in reads for k, c in enumerate(m.traced.reads[p].index) if c.offset)
    line = Window.partitionBy(*(a for k, a in enumerate(axes) if k != moving)).orderBy(axes[moving])
    cols = [F.col(member).alias(f"o_{name}_{member}") for member in base.type.members]
    for place, names in reads.items():
        by = m.traced.reads[place].index[moving].offset
        for member, out in names.items():
            cols.append((F.col(member) if by == 0 else F.lead(member, by).over(line)).alias(out))
    return base.frame.select(*axes, *cols)


def _pointwise(m: StencilMap, targets: dict[str, Grid], reads: dict[tuple, dict[str, str]]) -> DataFrame:
    first = next(iter(targets.values()))
    axes = first.axes
    grids: dict[int, Grid] = {id(g): g for g in targets.values()}
    for place in reads:
        grids.setdefault(id(m.args[place[0]]), m.args[place[0]])
    out = None
    for grid in grids.values():
        cols = [F.col(member).alias(f"o_{n}_{member}") for n, t in targets.items() if t is grid for member in grid.type.members]
        cols += [F.col(member).alias(c) for p, names in reads.items() if m.args[p[0]] is grid for member, c in names.items()]
        part = grid.frame.select(*axes, *cols)
        out = part if out is None else out.join(part, list(axes), "left")
    return out


def _join(frame: DataFrame, m: StencilMap, place: tuple, names: dict[str, str]) -> DataFrame:
    """A read of a plane, a line, a lower rank or other extents: an equi-join on what the index uses."""
    get: Get = m.traced.reads[place]
    grid: Grid = m.args[get.arg]
    rows, on = grid.frame, []
    keys = []
    for own, c, n in zip(grid.axes, get.index, grid.dims, strict=True):
        if c.sign:
            keys.append(F.col(own).alias(f"k_{own}"))
            on.append((f"k_{own}", _mapped(c, AXES, n if get.periodic else None)))
        else:
            rows = rows.where(F.col(own) == c.offset)
    rows = rows.select(*keys, *(F.col(member).alias(out) for member, out in names.items()))
    if not on:
        return frame.crossJoin(F.broadcast(rows))  # a single cell
    if broadcastable(tuple(n for n, c in zip(grid.dims, get.index, strict=True) if c.sign)):
        rows = F.broadcast(rows)
    condition = F.lit(True)
    for key, value in on:
        condition &= F.col(key) == value
    return frame.join(rows, condition, "left").drop(*(k for k, _ in on))


def _new_values(m: StencilMap, name: str, grid: Grid, here: Column, read) -> list[Column]:
    out = []
    for member, kind in grid.type.members.items():
        writes = [e for e in m.traced.emits if e.arg == name and e.member == member]
        old = F.col(f"o_{name}_{member}")

        def leaf(path, writes=writes, old=old, kind=kind):
            value = old
            for i in path:
                value = value[i]
            for e in writes:
                if e.path == path:
                    new = to_kind(column(e.value, read, AXES), e.value.kind, kind.kind)
                    when = here if e.condition is None else here & truth(e.condition, lambda x: column(x, read, AXES))
                    value = F.when(when, new.cast(PRIMITIVES[kind.kind])).otherwise(value)
            return value

        out.append((nested(kind.shape, leaf) if writes else old).alias(member))
    return out


def gather(m: StencilMap, targets: dict[str, Grid], color: int | None, strategy: str | None):
    """(frame, read): the written grids' places with old cells and all cells read, and how a read is found in it."""
    reads = _read_columns(m)
    first, base = next(iter(targets.items()))
    dims, rank = base.dims, len(base.dims)
    used = {p: c for p, c in reads.items() if _used(m, p, targets)}

    def direct(p: tuple) -> bool:
        g = m.traced.reads[p]
        # a wrapped source of other extents is read more than once by a place
        return invertible(g, rank) and not (g.periodic and tuple(m.args[g.arg].dims) != tuple(dims))

    gathered = {p: c for p, c in used.items() if direct(p)}
    plan = strategy or choose(_only(m, gathered), rank, first, lambda a: m.args[a] is base)
    if plan == "window" and len(targets) > 1:
        plan = "scatter"
    if plan == "pointwise":
        frame = _pointwise(m, targets, gathered)
    elif plan == "window":
        frame = _window(base, first, gathered, m)
    else:
        frame = _scatter(m, targets, gathered, color)
    for p, c in used.items():
        if p not in gathered:
            frame = _join(frame, m, p, c)

    def read(g: Get) -> Column:
        value = F.col(reads[g.place][g.member])
        for i in g.path:
            value = value[i]
        return value

    return frame, read


def apply_map(m: StencilMap, color: int | None = None, strategy: str | None = None) -> list[Grid]:
    """Run one map: all reads see the cells as they were before it; returns the grids written."""
    with c_arithmetic(next(m.args[e.arg] for e in m.traced.emits).session.spark):
        return _applied(m, color, strategy)


def _applied(m: StencilMap, color: int | None, strategy: str | None) -> list[Grid]:
    todo = {n: m.args[n] for n in dict.fromkeys(e.arg for e in m.traced.emits)}
    done: list[tuple[Grid, DataFrame]] = []
    while todo:
        dims = next(iter(todo.values())).dims
        targets = {n: g for n, g in todo.items() if g.dims == dims}
        todo = {n: g for n, g in todo.items() if n not in targets}
        frame, read = gather(m, targets, color, strategy)
        here = active(m, color)
        for n, grid in targets.items():
            done.append((grid, frame.select(*grid.axes, *_new_values(m, n, grid, here, read))))
    for grid, frame in done:
        grid.frame = frame
    return [g for g, _ in done]


def _used(m: StencilMap, place: tuple, targets: dict[str, Grid]) -> bool:
    for e in m.traced.emits:
        if e.arg in targets:
            for tree in (e.value, e.condition):
                if tree is not None and any(g.place == place for g, _ in gets(tree)):
                    return True
    return False


def _only(m: StencilMap, places) -> Traced:
    return Traced(m.traced.emits, {p: m.traced.reads[p] for p in places}, m.traced.guarded)
