"""One query an operator, over grids of the driver's tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernel as k
from .model import Domain
from .operators.grids import GridSession, checkpointed
from .operators.reduce import map_reduce_df, reduce_grid_df
from .operators.run import run
from .operators.tune import Settings, tuned
from .plans.trace import smap, smap_black, smap_red, smap_redblack
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
when = k.when

HD, NM, SD, DT = (24, 30), (25, 80), (2500,), (11, 9, 50)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[GridSession, str], DataFrame]) -> Callable:
        def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
            with T.utc(spark):
                return f(GridSession(spark), sf_dir)

        QUERIES[name] = asked
        if sql:
            ORACLES[name] = sql
        return f

    return add


# SQL for stencils --------------------------------------------------------------------------------


def _at(table: str, name: str, places: dict[str, str], target: str = "t") -> str:
    on = " AND ".join(f"{name}.{axis} = {place}" for axis, place in places.items())
    return f" LEFT JOIN {table} {name} ON {on}"


def _shift(dims: tuple[int, ...], offset: tuple[int, ...], periodic: bool) -> dict[str, str]:
    out = {}
    for axis, n, o in zip("xyz", dims, offset, strict=False):
        out[axis] = f"(t.{axis} + {o % n}) % {n}" if periodic and o else f"t.{axis} + {o}" if o else f"t.{axis}"
    return out


def _box(domain: Domain, t: str = "t") -> str:
    return " AND ".join(f"{t}.{a} >= {lo} AND {t}.{a} < {hi}" for a, (lo, hi) in zip("xyz", domain.ranges, strict=False))


def sum_sql(grid: str, dims: tuple[int, ...], offsets: list[tuple[int, ...]], domain: Domain, periodic: bool = False, old: str = "t.v") -> str:
    """The sum of neighbours on a domain, the old cell elsewhere."""
    axes = ", ".join(f"t.{a}" for a in "xyz"[: len(dims)])
    joins = "".join(_at("g", f"n{i}", _shift(dims, o, periodic)) for i, o in enumerate(offsets))
    total = " + ".join(f"n{i}.v" for i in range(len(offsets)))
    return f"WITH g AS ({grid}) SELECT {axes}, CASE WHEN {_box(domain)} THEN {total} ELSE {old} END AS v FROM g t{joins}"


def step_sql(name: str, source: str, dims: tuple[int, ...], offsets, where: str, periodic: bool, old: str) -> str:
    """One CTE of a chain: ``name`` from ``source``, keeping ``old`` elsewhere."""
    axes = ", ".join(f"t.{a}" for a in "xyz"[: len(dims)])
    joins = "".join(_at(source, f"n{i}", _shift(dims, o, periodic)) for i, o in enumerate(offsets))
    keep = _at(old, "k", _shift(dims, (0,) * len(dims), False))
    total = " + ".join(f"n{i}.v" for i in range(len(offsets)))
    return f"{name} AS (SELECT {axes}, CASE WHEN {where} THEN {total} ELSE k.v END AS v FROM {source} t{joins}{keep})"


def star(rank: int) -> list[tuple[int, ...]]:
    """The centre and the nearest neighbours along the axes."""
    out = [(0,) * rank]
    for d in range(rank):
        out += [tuple(s if j == d else 0 for j in range(rank)) for s in (-1, 1)]
    return out


def cube(rank: int) -> list[tuple[int, ...]]:
    """All neighbours at distance one, diagonals included."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(rank):
        out = [(*o, s) for s in (-1, 0, 1) for o in out]
    return out


def summing(offsets: list[tuple[int, ...]], periodic: bool = False):
    """A kernel that emits the sum of its neighbours, in this order."""

    def body(coords, g, out):
        source = g.periodic if periodic else g
        cells = [source[tuple(c + o for c, o in zip(coords, off, strict=True))] for off in offsets]
        total = cells[0]
        for c in cells[1:]:
            total = total + c
        out.emit(total)

    kernels = {
        1: lambda x, g, out: body((x,), g, out), 2: lambda x, y, g, out: body((x, y), g, out), 3: lambda x, y, z, g, out: body((x, y, z), g, out),
    }
    return kernels[len(offsets[0])]


def inner(dims: tuple[int, ...], width: int = 1) -> Domain:
    return Domain(*((width, n - width) for n in dims))


def whole(dims: tuple[int, ...]) -> Domain:
    return Domain(*((0, n) for n in dims))


def neighbours(name: str, make, grid: str, dims, offsets, domain: Domain, periodic: bool = False) -> None:
    """Register a summing stencil from a grid into a copy of it."""

    @query(name, sum_sql(T.sql(grid), dims, offsets, domain, periodic))
    def f(gs, d):
        g, out = make(gs, d), make(gs, d)
        run(smap(summing(offsets, periodic), domain, g, out))
        return out.to_df()


# Sources, sinks and points -----------------------------------------------------------------------


@query("zeros", f"SELECT x, y, z, CAST(0 AS INTEGER) AS v FROM ({T.points_sql((4, 3, 2))})")
def _zeros(gs, d):
    return gs.zeros((4, 3, 2), "int").to_df()


@query("zeros_struct", f"SELECT x, y, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q FROM ({T.points_sql((5, 4))})")
def _zeros_struct(gs, d):
    return gs.zeros((5, 4), {"p": "double", "q": "double"}).to_df()


@query("copyin_copyout", f"SELECT CAST(x + 7 * y AS BIGINT) AS id, x, y, CAST(3 * (x + 7 * y) AS BIGINT) AS v FROM ({T.points_sql((7, 5))})")
def _copy(gs, d):
    return gs.from_memory([3 * i for i in range(35)], (7, 5), "long").to_table()


@query("from_table", T.sql("nation_month"))
def _from_table(gs, d):
    return T.nation_month(gs, d).to_df()


@query("grid_dim", "SELECT CAST(11 AS INTEGER) AS nx, CAST(9 AS INTEGER) AS ny, CAST(50 AS INTEGER) AS nz")
def _dim(gs, d):
    g = T.dtq(gs, d)
    return gs.spark.range(1).select(*(F.lit(g.dim(i)).cast("int").alias(n) for i, n in enumerate(("nx", "ny", "nz"))))


@query("point_get", f"WITH g AS ({T.sql('event_hd')}) SELECT v FROM g WHERE x = 5 AND y = 7")
def _get(gs, d):
    return gs.spark.range(1).select(F.lit(T.event_hd(gs, d).get(5, 7)).cast("bigint").alias("v"))


@query("point_set", f"WITH g AS ({T.sql('event_hd')}) SELECT x, y, CASE WHEN x = 3 AND y = 4 THEN -5 WHEN x = 0 AND y = 29 THEN 77 ELSE v END AS v FROM g")
def _set(gs, d):
    g = T.event_hd(gs, d)
    g.set(3, 4, 1)
    g.set_many([((3, 4), -5), ((0, 29), 77)])
    return g.to_df()


@query("grid_free", "SELECT CAST(2 AS INTEGER) AS before, CAST(1 AS INTEGER) AS after, CAST(0 AS INTEGER) AS finished")
def _free(gs, d):
    a, _ = gs.zeros((3, 3)), gs.iota((4,))
    counts = [len(gs.grids)]
    a.free()
    counts.append(len(gs.grids))
    gs.finish()
    counts.append(len(gs.grids))
    return gs.spark.range(1).select(*(F.lit(n).cast("int").alias(c) for n, c in zip(counts, ("before", "after", "finished"), strict=True)))


@query("grid_info", "SELECT CAST(2 AS BIGINT) AS lines, true AS has_extents, true AS has_plan")
def _info(gs, d):
    gs.zeros((3, 5), "int"), gs.iota((7,))
    said, plans = gs.info(), gs.info(plans=True)
    return gs.spark.range(1).select(
        F.lit(len(said.splitlines())).cast("bigint").alias("lines"), F.lit("(3, 5)" in said and "(7,)" in said).alias("has_extents"), F.lit("Range" in plans).alias("has_plan")
    )


@query("save_restore", T.sql("event_hd"))
def _save(gs, d):
    name = f"query-{uuid.uuid4().hex}"
    T.event_hd(gs, d).save(name)
    out = checkpointed_copy(gs.restore(name, HD, "long"))
    gs.forget(name)
    return out


def checkpointed_copy(grid) -> DataFrame:
    checkpointed(grid)
    return grid.to_df()


def _block_sql(axis: str, n: int, parts: int) -> str:
    base, more = divmod(n, parts)
    edge = (parts - more) * base
    return f"CASE WHEN {axis} < {edge} THEN {axis} // {base} ELSE {parts - more} + ({axis} - {edge}) // {base + 1} END"


@query(
    "block_partition",
    f"WITH g AS ({T.sql('event_hd')}) SELECT CAST({_block_sql('x', 24, 5)} + 5 * ({_block_sql('y', 30, 4)}) AS INTEGER) AS block, "
    "CAST(1 AS BIGINT) AS partitions, count(*) AS cells, CAST(sum(v) AS BIGINT) AS total FROM g GROUP BY 1",
)
def _blocks(gs, d):
    rows = T.event_hd(gs, d).partitioned((5, 4)).withColumn("at", F.spark_partition_id())
    return rows.groupBy("block").agg(F.countDistinct("at").alias("partitions"), F.count("*").alias("cells"), F.sum("v").cast("bigint").alias("total"))


@query("traced_run", "SELECT CAST(4 AS BIGINT) AS steps, CAST(4 AS BIGINT) AS timed, true AS all_took_time, 'rise' AS kernel")
def _traced(gs, d):
    g = gs.iota((6, 5), "int")

    def rise(x, y, g):
        g.emit(g[x, y] + 1)

    told = run(smap(rise, whole((6, 5)), g), iters=4, traced=True)
    timed = all(s > 0 for _, s in told.traced) and told.seconds >= sum(s for _, s in told.traced)
    return gs.spark.range(1).select(
        F.lit(told.steps).cast("bigint").alias("steps"), F.lit(len(told.traced)).cast("bigint").alias("timed"), F.lit(timed).alias("all_took_time"),
        F.lit(told.traced[0][0]).alias("kernel"),
    )


# Domains, maps -----------------------------------------------------------------------------------


@query("identity_map", T.sql("event_hd"))
def _identity(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")
    run(smap(lambda x, y, g, out: out.emit(g[x, y]), whole(HD), g, out))
    return out.to_df()


@query("copy_map", T.sql("dtq"))
def _copy_map(gs, d):
    a, b = T.dtq(gs, d), gs.zeros(DT, "long")
    copy = lambda x, y, z, g, out: out.emit(g[x, y, z])
    run(smap(copy, whole(DT), a, b), smap(copy, whole(DT), b, a), iters=2)
    return a.to_df()


def _scaled(box: Domain) -> str:
    return f"WITH t AS ({T.sql('event_hd')}) SELECT x, y, CASE WHEN {_box(box)} THEN v * 10 ELSE v END AS v FROM t"


def _scale(gs, d, box):
    g = T.event_hd(gs, d)
    run(smap(lambda x, y, g: g.emit(g[x, y] * 10), box, g))
    return g.to_df()


query("domain_inner", _scaled(inner(HD)))(lambda gs, d: _scale(gs, d, inner(HD)))
query("domain_face", _scaled(Domain((22, 24), (0, 30))))(lambda gs, d: _scale(gs, d, whole(HD).face(0, 2, True)))
query("domain_shrink", _scaled(Domain((3, 21), (3, 27))))(lambda gs, d: _scale(gs, d, whole(HD).shrink(3)))

neighbours("stencil_3pt_1d", T.ship_day, "ship_day", SD, [(-1,), (0,), (1,)], inner(SD))
neighbours("stencil_5pt_2d", T.event_hd, "event_hd", HD, star(2), inner(HD))
neighbours("stencil_9pt_2d", T.nation_month, "nation_month", NM, cube(2), inner(NM))
neighbours("stencil_7pt_3d", T.dtq, "dtq", DT, star(3), inner(DT))
neighbours("stencil_27pt_3d", T.dtq, "dtq", DT, cube(3), inner(DT))
neighbours("stencil_asymmetric", T.dtq, "dtq", DT, [(0, 0, 0), (1, 1, 1), (-2, -2, -2)], inner(DT, 2))
neighbours("stencil_hole", T.nation_month, "nation_month", NM, [(0, 0), (2, 0), (-2, 0)], inner(NM, 2))
neighbours("window_axis", T.nation_month, "nation_month", NM, [(0, -3), (0, 0), (0, 2)], Domain((0, 25), (3, 78)))
neighbours("periodic_3", T.ship_day, "ship_day", SD, [(-1,), (0,), (1,)], whole(SD), True)
neighbours("periodic_5", T.event_hd, "event_hd", HD, star(2), whole(HD), True)
neighbours("periodic_9", T.event_hd, "event_hd", HD, cube(2), whole(HD), True)
neighbours("periodic_7", T.dtq, "dtq", DT, star(3), whole(DT), True)
neighbours("periodic_27", T.dtq, "dtq", DT, cube(3), whole(DT), True)


@query(
    "asymmetric_periodic",
    f"WITH g AS ({T.sql('event_hd')}) SELECT t.x, t.y, CASE WHEN t.x >= 1 THEN t.v + a.v + b.v ELSE t.v END AS v FROM g t "
    "LEFT JOIN g a ON a.x = t.x - 1 AND a.y = t.y LEFT JOIN g b ON b.x = (t.x + 2) % 24 AND b.y = t.y",
)
def _mixed_periodic(gs, d):
    g, out = T.event_hd(gs, d), T.event_hd(gs, d)
    run(smap(lambda x, y, g, o: o.emit(g[x, y] + g[x - 1, y] + g.periodic[x + 2, y]), Domain((1, 24), (0, 30)), g, out))
    return out.to_df()


# Conditions, types, functions --------------------------------------------------------------------


def _clamped(rank: int):
    def emit(coords, g, out, dims):
        total = g[coords]
        for i, n in enumerate(dims):
            for s, edge in ((-1, coords[i] == 0), (1, coords[i] == n - 1)):
                near = tuple(c + s if j == i else c for j, c in enumerate(coords))
                total = total + when(edge, g[coords], g[near])
        out.emit(total)

    if rank == 2:
        return lambda x, y, g, out: emit((x, y), g, out, HD)
    return lambda x, y, z, g, out: emit((x, y, z), g, out, DT)


def _clamped_sql(grid: str, dims) -> str:
    offsets = star(len(dims))[1:]
    joins = "".join(_at("g", f"n{i}", _shift(dims, o, False)) for i, o in enumerate(offsets))
    total = " + ".join(f"coalesce(n{i}.v, t.v)" for i in range(len(offsets)))
    axes = ", ".join(f"t.{a}" for a in "xyz"[: len(dims)])
    return f"WITH g AS ({T.sql(grid)}) SELECT {axes}, t.v + {total} AS v FROM g t{joins}"


@query("neumann_2d", _clamped_sql("event_hd", HD))
def _neumann2(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")
    run(smap(_clamped(2), whole(HD), g, out))
    return out.to_df()


@query("neumann_3d", _clamped_sql("dtq", DT))
def _neumann3(gs, d):
    g, out = T.dtq(gs, d), gs.zeros(DT, "long")
    run(smap(_clamped(3), whole(DT), g, out))
    return out.to_df()


@query(
    "conditional_get",
    f"WITH g AS ({T.sql('event_hd')}) SELECT t.x, t.y, t.v + CASE WHEN t.x > 0 AND t.x < 23 THEN a.v + b.v ELSE t.v END AS v FROM g t "
    "LEFT JOIN g a ON a.x = t.x - 1 AND a.y = t.y LEFT JOIN g b ON b.x = t.x + 1 AND b.y = t.y",
)
def _conditional(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")
    run(smap(lambda x, y, g, o: o.emit(g[x, y] + when((x > 0) & (x < 23), g[x - 1, y] + g[x + 1, y], g[x, y])), whole(HD), g, out))
    return out.to_df()


@query("conditional_emit", f"WITH g AS ({T.sql('event_hd')}) SELECT x, y, CASE WHEN v > 1 OR y < 3 THEN -v ELSE v END AS v FROM g")
def _emit_if(gs, d):
    g = T.event_hd(gs, d)
    run(smap(lambda x, y, g: g.emit_if((g[x, y] > 1) | (y < 3), -g[x, y]), whole(HD), g))
    return g.to_df()


_EDGE = "(t.x = 0 OR t.x = 23 OR t.y = 0 OR t.y = 29)"


@query("dirichlet_emit", f"WITH t AS ({T.sql('event_hd')}) SELECT x, y, CASE WHEN {_EDGE} THEN -9 ELSE v * 2 END AS v FROM t")
def _dirichlet(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")

    def kernel(x, y, g, out):
        out.emit(g[x, y] * 2)
        out.emit_dirichlet(-9)

    run(smap(kernel, whole(HD), g, out))
    return out.to_df()


@query(
    "neumann_emit",
    f"WITH g AS ({T.sql('event_hd')}) SELECT t.x, t.y, CASE WHEN {_EDGE} THEN i.v * 3 ELSE t.v END AS v FROM g t "
    "LEFT JOIN g i ON i.x = least(greatest(t.x, 1), 22) AND i.y = least(greatest(t.y, 1), 28)",
)
def _neumann_emit(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")

    def kernel(x, y, g, out):
        out.emit(g[x, y])
        out.emit_neumann(g, 3)

    run(smap(kernel, whole(HD), g, out))
    return out.to_df()


@query("mod_branch", f"WITH g AS ({T.sql('event_hd')}) SELECT x, y, CASE WHEN x % 2 = 0 THEN v * 2 + y % 7 ELSE v - x END AS v FROM g")
def _mod(gs, d):
    g = T.event_hd(gs, d)
    run(smap(lambda x, y, g: g.emit(when(x % 2 == 0, g[x, y] * 2 + y % 7, g[x, y] - x)), whole(HD), g))
    return g.to_df()


@query(
    "integer_division",
    f"WITH g AS ({T.sql('event_cents')}) SELECT x, y, CAST(sign(v - 5000) * (abs(v - 5000) // 7) + (v - 5000) % 13 AS BIGINT) AS v FROM g",
)
def _division(gs, d):
    g = T.event_cents(gs, d)
    run(smap(lambda x, y, g: g.emit((g[x, y] - 5000) / 7 + (g[x, y] - 5000) % 13), whole(HD), g))
    return g.to_df()


@query(
    "mixed_type",
    f"WITH g AS ({T.sql('event_hd')}) SELECT t.x, t.y, CAST((t.v + a.v + b.v) * ((t.x + 24 * t.y) % 10) AS DOUBLE) * 0.5 AS v FROM g t "
    "LEFT JOIN g a ON a.x = (t.x + 23) % 24 AND a.y = t.y LEFT JOIN g b ON b.x = (t.x + 1) % 24 AND b.y = t.y",
)
def _mixed_type(gs, d):
    g, out = T.event_hd(gs, d, "float"), gs.zeros(HD, "double")
    coeff = gs.iota(HD, "int")
    run(smap(lambda x, y, c: c.emit(c[x, y] % 10), whole(HD), coeff))

    def kernel(x, y, g, out, coeff):
        p = g.periodic
        out.emit(k.cast(g[x, y] + p[x - 1, y] + p[x + 1, y], "double") * coeff[x, y] * 0.5)

    run(smap(kernel, whole(HD), g, out, coeff))
    return out.to_df()


@query("scalar_argument", f"WITH g AS ({T.sql('event_hd')}) SELECT x, y, v * 3 + 100 AS v FROM g")
def _scalars(gs, d):
    g = T.event_hd(gs, d)
    run(smap(lambda x, y, g, a, b: g.emit(g[x, y] * a + b), whole(HD), g, 3, 100))
    return g.to_df()


def _told(value: str, digits: int) -> str:
    """SQL of a number as (state, its value in units of 10**-digits): not finite ones have a state of their own and 0."""
    return (
        f"CASE WHEN isnan({value}) THEN 'nan' WHEN isinf({value}) THEN CASE WHEN {value} > 0 THEN 'inf' ELSE '-inf' END ELSE 'number' END AS state, "
        f"CASE WHEN isfinite({value}) THEN CAST(floor({value} * {10**digits} + 0.5) AS BIGINT) ELSE 0 END AS v"
    )


def _tell(df: DataFrame, digits: int) -> DataFrame:
    """The same of a grid's cells."""
    v = F.col("v").cast("double")
    infinite = F.abs(v) == float("inf")
    state = F.when(F.isnan(v), "nan").when(infinite & (v > 0), "inf").when(infinite, "-inf").otherwise("number")
    number = F.when(F.isnan(v) | infinite, F.lit(0).cast("bigint")).otherwise(F.floor(v * 10**digits + 0.5).cast("bigint"))
    return df.select("x", "y", state.alias("state"), number.alias("v"))


#: Each function: kernel, SQL (DuckDB raises outside the range of some). Cells are -2, -1, 0, 1 ...: counts less two.
_OUT = "CAST('NaN' AS DOUBLE)"
FUNCTIONS = {
    "exp": (lambda f, v: f(v / 10.0), "exp(v / 10.0)"),
    "log": (lambda f, v: f(v), f"CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN -CAST('Infinity' AS DOUBLE) ELSE {_OUT} END"),
    "sqrt": (lambda f, v: f(v), f"CASE WHEN v >= 0 THEN sqrt(v) ELSE {_OUT} END"),
    "cos": (lambda f, v: f(v), "cos(v)"),
    "sin": (lambda f, v: f(v), "sin(v)"),
    "acos": (lambda f, v: f(v / 2.0), f"CASE WHEN abs(v) <= 2 THEN acos(v / 2.0) ELSE {_OUT} END"),
    "fabs": (lambda f, v: f(v), "abs(v)"),
    "pow": (lambda f, v: f(v, 1.5), f"CASE WHEN v >= 0 THEN power(v, 1.5) ELSE {_OUT} END"),
}


def _function(name: str, single: bool) -> None:
    body, sql = FUNCTIONS[name]
    call = getattr(k, name + "f" * single)
    digits = 2 if single else 6
    value = f"CAST(CAST({sql} AS FLOAT) AS DOUBLE)" if single else f"({sql})"

    @query(f"math_{name}{'f' * single}", f"WITH g AS (SELECT x, y, v - 2 AS v FROM ({T.sql('event_hd', 'DOUBLE')})), m AS (SELECT x, y, {value} AS w FROM g) SELECT x, y, {_told('w', digits)} FROM m")
    def f(gs, d):
        g, out = T.event_hd(gs, d, "double"), gs.zeros(HD, "float" if single else "double")
        run(smap(lambda x, y, g, out: out.emit(body(call, g[x, y] - 2.0)), whole(HD), g, out))
        return _tell(out.to_df(), digits)


for _name in FUNCTIONS:
    _function(_name, False)
    _function(_name, True)


@query(
    "nan_on_tiles",
    f"WITH g AS (SELECT x, y, CASE WHEN v > 2 THEN sqrt(v - 2) ELSE {_OUT} END AS v FROM ({T.sql('event_hd', 'DOUBLE')})) "
    "SELECT t.x, t.y, " + _told("(CASE WHEN t.x < 23 THEN t.v + a.v ELSE t.v END)", 6) + " FROM g t LEFT JOIN g a ON a.x = t.x + 1 AND a.y = t.y",
)
def _nan(gs, d):
    g, h, out = T.event_hd(gs, d, "double"), gs.zeros(HD, "double"), gs.zeros(HD, "double")
    nan = float("nan")
    run(
        smap(lambda x, y, g, h: h.emit(when(g[x, y] > 2.0, k.sqrt(g[x, y] - 2.0), nan)), whole(HD), g, h),
        smap(lambda x, y, h, out: out.emit(when(x < 23, h[x, y] + h[x + 1, y], h[x, y])), whole(HD), h, out),
        strategy="tile", tile=(7, 11),
    )
    return _tell(out.to_df(), 6)


@query(
    "long_wraps",
    f"WITH g AS ({T.sql('event_cents')}), m AS (SELECT x, y, CAST(v AS HUGEINT) * 4611686018427387904 + 9223372036854775807 AS w FROM g) "
    "SELECT x, y, CAST((w % 18446744073709551616 + 18446744073709551616 + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS v FROM m",
)
def _wraps(gs, d):
    g = T.event_cents(gs, d)
    run(smap(lambda x, y, g: g.emit(g[x, y] * 2**62 + (2**63 - 1)), whole(HD), g))
    return g.to_df()


@query("zero_division", f"WITH g AS ({T.sql('event_cents')}) SELECT x, y, CASE WHEN v % 3 = 0 THEN 7 ELSE v // (v % 3) + v % (v % 3) + 7 END AS v FROM g")
def _by_zero(gs, d):
    g = T.event_cents(gs, d)
    run(smap(lambda x, y, g: g.emit(g[x, y] / (g[x, y] % 3) + g[x, y] % (g[x, y] % 3) + 7), whole(HD), g))
    return g.to_df()


@query(
    "inner_kernel_call",
    f"WITH g AS ({T.sql('event_hd')}) SELECT t.x, t.y, 2 * (t.v + a.v) AS v FROM g t LEFT JOIN g a ON a.x = (t.x + 1) % 24 AND a.y = t.y",
)
def _inner(gs, d):
    def pair(x, y, g):
        return g[x, y] + g.periodic[x + 1, y]

    def kernel(x, y, g, out):
        out.emit(pair(x, y, g) * 2)

    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")
    run(smap(kernel, whole(HD), g, out))
    return out.to_df()


# Indices that are no plain offsets, grids of other ranks and extents -----------------------------


@query("const_plane", f"WITH g AS ({T.sql('dtq')}) SELECT t.x, t.y, t.z, t.v + p.v AS v FROM g t LEFT JOIN g p ON p.x = t.x AND p.y = t.y AND p.z = 3")
def _plane(gs, d):
    g, out = T.dtq(gs, d), gs.zeros(DT, "long")
    run(smap(lambda x, y, z, g, o: o.emit(g[x, y, z] + g[x, y, 3]), whole(DT), g, out))
    return out.to_df()


@query("reflect", f"WITH g AS ({T.sql('event_hd')}) SELECT t.x, t.y, r.v AS v FROM g t LEFT JOIN g r ON r.x = 23 - t.x AND r.y = t.y")
def _reflect(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros(HD, "long")
    run(smap(lambda x, y, g, o: o.emit(g[24 - x - 1, y]), whole(HD), g, out))
    return out.to_df()


@query(
    "staggered",
    f"WITH g AS ({T.sql('event_hd')}) SELECT p.x, p.y, CASE WHEN p.x < 24 AND p.y < 30 THEN CASE WHEN p.x > 0 THEN a.v + b.v ELSE a.v END ELSE 0 END AS v "
    f"FROM ({T.points_sql((25, 31))}) p LEFT JOIN g a ON a.x = p.x AND a.y = p.y LEFT JOIN g b ON b.x = p.x - 1 AND b.y = p.y",
)
def _staggered(gs, d):
    g, out = T.event_hd(gs, d), gs.zeros((25, 31), "long")
    run(smap(lambda x, y, g, o: o.emit(when(x > 0, g[x, y] + g[x - 1, y], g[x, y])), Domain((0, 24), (0, 30)), g, out))
    return out.to_df()


@query(
    "thin_output",
    f"WITH g AS ({T.sql('dtq')}) SELECT p.x, p.y, p.z, g.v FROM ({T.points_sql((1, 9, 50))}) p LEFT JOIN g ON g.x = 4 AND g.y = p.y AND g.z = p.z",
)
def _thin(gs, d):
    g, out = T.dtq(gs, d), gs.zeros((1, 9, 50), "long")
    run(smap(lambda x, y, z, g, o: o.emit(g[4, y, z]), whole((1, 9, 50)), g, out))
    return out.to_df()


def _coefficient(gs, n: int):
    c = gs.iota((n,), "int")
    run(smap(lambda x, c: c.emit(1 + x % 2), whole((n,)), c))
    return c


@query(
    "mixed_dim_1",
    f"WITH g AS ({T.sql('dtq')}) SELECT t.x, t.y, t.z, CASE WHEN t.x >= 1 AND t.x < 10 THEN t.v * (1 + t.x % 2) + a.v * (1 + (t.x - 1) % 2) + b.v * (1 + (t.x + 1) % 2) "
    "ELSE t.v END AS v FROM g t LEFT JOIN g a ON a.x = t.x - 1 AND a.y = t.y AND a.z = t.z LEFT JOIN g b ON b.x = t.x + 1 AND b.y = t.y AND b.z = t.z",
)
def _mixed1(gs, d):
    g, out, c = T.dtq(gs, d), T.dtq(gs, d), _coefficient(gs, 11)

    def kernel(x, y, z, g, o, c):
        o.emit(g[x, y, z] * c[x] + g[x - 1, y, z] * c[x - 1] + g[x + 1, y, z] * c[x + 1])

    run(smap(kernel, Domain((1, 10), (0, 9), (0, 50)), g, out, c))
    return out.to_df()


@query("mixed_dim_2", f"WITH g AS ({T.sql('dtq')}) SELECT x, y, z, v * (1 + x % 2) + (1 + y % 2) * 10 + (1 + z % 2) * 100 AS v FROM g")
def _mixed2(gs, d):
    g, out = T.dtq(gs, d), gs.zeros(DT, "long")
    cs = [_coefficient(gs, n) for n in DT]
    run(smap(lambda x, y, z, g, o, a, b, c: o.emit(g[x, y, z] * a[x] + b[y] * 10 + c[z] * 100), whole(DT), g, out, *cs))
    return out.to_df()


@query(
    "mixed_dim_3",
    f"WITH g AS ({T.sql('dtq')}), h AS (SELECT x AS y, y AS z, v FROM ({T.sql('event_hd')})) SELECT t.x, t.y, t.z, "
    "CASE WHEN t.y >= 1 AND t.y < 8 AND t.z < 29 THEN t.v + a.v * i.v + b.v * j.v ELSE t.v END AS v FROM g t "
    "LEFT JOIN g a ON a.x = t.x AND a.y = t.y - 1 AND a.z = t.z LEFT JOIN g b ON b.x = t.x AND b.y = t.y AND b.z = t.z + 1 "
    "LEFT JOIN h i ON i.y = t.y - 1 AND i.z = t.z LEFT JOIN h j ON j.y = t.y AND j.z = t.z + 1",
)
def _mixed3(gs, d):
    g, out, j = T.dtq(gs, d), T.dtq(gs, d), T.event_hd(gs, d)

    def kernel(x, y, z, g, o, j):
        o.emit(g[x, y, z] + g[x, y - 1, z] * j[y - 1, z] + g[x, y, z + 1] * j[y, z + 1])

    run(smap(kernel, Domain((0, 11), (1, 8), (0, 29)), g, out, j))
    return out.to_df()


# Runs --------------------------------------------------------------------------------------------


@query("multi_kernel", T.sql("event_hd"))
def _multi(gs, d):
    g, h = T.event_hd(gs, d), gs.zeros(HD, "long")
    run(smap(lambda x, y, a, b: b.emit(a[x, y] * 2), whole(HD), g, h), smap(lambda x, y, a, b: b.emit(a[x, y] / 2), whole(HD), h, g))
    return g.to_df()


@query("multi_emit", f"WITH g AS ({T.sql('event_hd')}) SELECT x, y, v + 1 AS v, v * v AS w FROM g")
def _multi_emit(gs, d):
    g, a, b = T.event_hd(gs, d), gs.zeros(HD, "long"), gs.zeros(HD, "long")

    def kernel(x, y, g, a, b):
        a.emit(g[x, y] + 1)
        b.emit(g[x, y] * g[x, y])

    run(smap(kernel, whole(HD), g, a, b))
    return a.to_df().join(b.to_df().withColumnRenamed("v", "w"), ["x", "y"])


def _chain(grid: str, dims, offsets, steps: int, domain: Domain, periodic: bool) -> str:
    """Ping-pong: step n writes the grid that step n - 1 read."""
    parts = [f"s0 AS ({T.sql(grid)})"]
    for n in range(1, steps + 1):
        parts.append(step_sql(f"s{n}", f"s{n - 1}", dims, offsets, _box(domain), periodic, f"s{max(n - 2, 0)}"))
    return f"WITH {', '.join(parts)} SELECT * FROM s{steps}"


@query("multi_iter", _chain("event_hd", HD, star(2), 3, whole(HD), True))
def _iter(gs, d):
    a, b = T.event_hd(gs, d), T.event_hd(gs, d)
    kernel = summing(star(2), True)
    run(smap(kernel, whole(HD), a, b), smap(lambda x, y, s, t: t.emit(s[x, y]), whole(HD), b, a), iters=3)
    return a.to_df()


@query("ping_pong", _chain("event_hd", HD, star(2), 4, inner(HD), False))
def _ping(gs, d):
    a, b = T.event_hd(gs, d), T.event_hd(gs, d)
    kernel = summing(star(2))
    run(smap(kernel, inner(HD), a, b), smap(kernel, inner(HD), b, a), iters=2)
    return a.to_df()


@query("tiles_temporal", _chain("event_hd", HD, star(2), 4, inner(HD), False))
def _tiles(gs, d):
    a, b = T.event_hd(gs, d), T.event_hd(gs, d)
    kernel = summing(star(2))
    run(smap(kernel, inner(HD), a, b), smap(kernel, inner(HD), b, a), iters=2, strategy="tile", steps_per_shuffle=4, tile=(8, 10))
    return a.to_df()


@query("tuned_run", _chain("event_hd", HD, star(2), 4, inner(HD), False))
def _tuned(gs, d):
    a, b = T.event_hd(gs, d), T.event_hd(gs, d)
    kernel = summing(star(2))
    maps = [smap(kernel, inner(HD), a, b), smap(kernel, inner(HD), b, a)]
    best, _ = tuned(*maps, settings=[Settings("scatter"), Settings("tile", 2, (12, 15))])
    best.run(*maps, iters=2)
    return a.to_df()


def _colored(grid: str, dims, offsets, colors: list[int], domain: Domain, periodic: bool) -> str:
    parts = [f"s0 AS ({T.sql(grid)})"]
    total = " + ".join(f"t.{a}" for a in "xyz"[: len(dims)])
    for n, c in enumerate(colors, 1):
        where = f"{_box(domain)} AND ({total}) % 2 = {c}"
        parts.append(step_sql(f"s{n}", f"s{n - 1}", dims, offsets, where, periodic, f"s{n - 1}"))
    return f"WITH {', '.join(parts)} SELECT * FROM s{len(colors)}"


def _color_query(name: str, make_map, colors: list[int], periodic: bool = False) -> None:
    box = whole(HD) if periodic else inner(HD)

    @query(name, _colored("event_hd", HD, star(2), colors, box, periodic))
    def f(gs, d):
        g = T.event_hd(gs, d)
        kernel = summing(star(2), periodic)
        run(make_map(lambda x, y, g: kernel(x, y, g, g), box, g))
        return g.to_df()


_color_query("red", smap_red, [0])
_color_query("black", smap_black, [1])
_color_query("redblack", smap_redblack, [0, 1])
_color_query("redblack_periodic", smap_redblack, [0, 1], True)


# Reductions --------------------------------------------------------------------------------------


def _reduce(name: str, op: str, grid: str, make, kind: str, sql: str) -> None:
    @query(name, f"WITH g AS ({T.sql(grid, kind)}) SELECT {sql} AS value FROM g")
    def f(gs, d):
        return reduce_grid_df(make(gs, d), op)


for _kind, _sql, _back in (("long", "BIGINT", "BIGINT"), ("int", "INTEGER", "BIGINT"), ("double", "DOUBLE", "DOUBLE"), ("float", "FLOAT", "DOUBLE")):
    _make = lambda gs, d, _k=_kind: T.event_hd(gs, d, _k)
    _reduce(f"reduce_max_{_kind}", "max", "event_hd", _make, _sql, "max(v)")
    _reduce(f"reduce_min_{_kind}", "min", "event_hd", _make, _sql, "min(v)")
    _reduce(f"reduce_sum_{_kind}", "sum", "event_hd", _make, _sql, f"CAST(sum(v) AS {_back})")


def _product(kind: str) -> None:
    """Factors 1 and 3 from the first hour's counts: exact in every type."""
    back = "BIGINT" if kind in ("int", "long") else "DOUBLE"

    @query(f"reduce_prod_{kind}", f"WITH g AS ({T.sql('event_hd')}) SELECT CAST(product(CASE WHEN x = 0 THEN 1 + 2 * (v % 2) ELSE 1 END) AS {back}) AS value FROM g")
    def f(gs, d):
        g, out = T.event_hd(gs, d), gs.zeros(HD, kind)
        run(smap(lambda x, y, g, out: out.emit(k.cast(when(x == 0, g[x, y] % 2 * 2 + 1, 1), kind)), whole(HD), g, out))
        return reduce_grid_df(out, "prod")


for _kind in ("long", "int", "float", "double"):
    _product(_kind)


_AFTER = _chain("event_hd", HD, cube(2), 2, inner(HD), False)


@query("reduce_after_run", f"SELECT CAST(sum(v) AS BIGINT) AS value FROM ({_AFTER})")
def _after(gs, d):
    a, b = T.event_hd(gs, d), T.event_hd(gs, d)
    kernel = summing(cube(2))
    run(smap(kernel, inner(HD), a, b), smap(kernel, inner(HD), b, a))
    return reduce_grid_df(a, "sum")


@query("reduce_wrap32", f"WITH g AS ({T.sql('event_cents')}) SELECT CAST((CAST(sum(v * 4096) AS BIGINT) % 4294967296 + 4294967296 + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS value FROM g")
def _wrap(gs, d):
    g = T.event_cents(gs, d)
    run(smap(lambda x, y, g: g.emit(g[x, y] * 4096), whole(HD), g))
    return reduce_grid_df(g, "sum", overflow="wrap32")


@query(
    "map_reduce",
    f"WITH g AS ({T.sql('event_hd')}) SELECT CAST(sum((a.v - t.v) * (a.v - t.v)) AS BIGINT) AS value FROM g t JOIN g a ON a.x = t.x + 1 AND a.y = t.y WHERE t.y >= 1 AND t.x < 23",
)
def _map_reduce(gs, d):
    g = T.event_hd(gs, d)
    return map_reduce_df("sum", lambda x, y, g: (g[x + 1, y] - g[x, y]) * (g[x + 1, y] - g[x, y]), Domain((0, 23), (1, 30)), g)


@query("grid_reduce", f"WITH g AS ({T.sql('event_hd')}) SELECT CAST(sum(v) FILTER (x >= 2 AND x < 9) AS BIGINT) AS part, max(v) AS most, CAST(sum(v * v) AS BIGINT) AS squares FROM g")
def _grid_reduce(gs, d):
    g = T.event_hd(gs, d)
    values = {"part": g.reduce("sum", Domain((2, 9), (0, 30))), "most": g.reduce("max"), "squares": g.reduce("sum", kernel=lambda x, y, g: g[x, y] * g[x, y])}
    return gs.spark.range(1).select(*(F.lit(v).cast("bigint").alias(c) for c, v in values.items()))


# Struct and array cells --------------------------------------------------------------------------


@query("utype_member_emit", f"WITH g AS ({T.sql('event_pq')}) SELECT x, y, p + q AS p, q FROM g")
def _member(gs, d):
    g = T.event_pq(gs, d)
    run(smap(lambda x, y, g: g.p.emit(g[x, y].p + g[x, y].q), whole(HD), g))
    return g.to_df()


@query(
    "utype_struct_emit",
    f"WITH g AS ({T.sql('event_pq')}) SELECT t.x, t.y, a.p AS p, a.q AS q FROM g t LEFT JOIN g a ON a.x = (t.x + 1) % 24 AND a.y = t.y",
)
def _struct(gs, d):
    g, out = T.event_pq(gs, d), gs.zeros(HD, {"p": "double", "q": "double"})
    run(smap(lambda x, y, g, o: o.emit(g.periodic[x + 1, y]), whole(HD), g, out))
    return out.to_df()


@query(
    "utype_two_kernels",
    f"WITH g AS ({T.sql('event_pq')}), h AS (SELECT t.x, t.y, t.p + a.q AS p, t.q FROM g t LEFT JOIN g a ON a.x = (t.x + 23) % 24 AND a.y = t.y) "
    "SELECT t.x, t.y, t.p, t.q + a.p AS q FROM h t LEFT JOIN h a ON a.x = t.x AND a.y = (t.y + 1) % 30",
)
def _two(gs, d):
    g = T.event_pq(gs, d)
    run(
        smap(lambda x, y, g: g.p.emit(g[x, y].p + g.periodic[x - 1, y].q), whole(HD), g),
        smap(lambda x, y, g: g.q.emit(g[x, y].q + g.periodic[x, y + 1].p), whole(HD), g),
    )
    return g.to_df()


@query(
    "utype_array_member",
    f"WITH g AS ({T.sql('event_pq')}) SELECT t.x, t.y, t.p AS p0, t.q + a.p AS p1 FROM g t LEFT JOIN g a ON a.x = (t.x + 1) % 24 AND a.y = t.y",
)
def _array(gs, d):
    g, a = T.event_pq(gs, d), gs.zeros(HD, {"p": ("double", 2)})

    def fill(x, y, g, a):
        a.p[0].emit(g[x, y].p)
        a.p[1].emit(g[x, y].q)

    run(smap(fill, whole(HD), g, a), smap(lambda x, y, a: a.p[1].emit(a[x, y].p[1] + a.periodic[x + 1, y].p[0]), whole(HD), a))
    return a.to_df().select("x", "y", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))


@query("utype_transpose", f"WITH g AS ({T.sql('event_pq')}) SELECT x, y, p AS c00, p + 10 AS c01, p + 1 AS c10, p + 11 AS c11, p + 2 AS c20, p + 12 AS c21 FROM g")
def _transpose(gs, d):
    g = T.event_pq(gs, d)
    a, b = gs.zeros(HD, {"p": ("double", 2, 3)}), gs.zeros(HD, {"p": ("double", 3, 2)})

    def fill(x, y, g, a):
        for i in range(2):
            for j in range(3):
                a.p[i][j].emit(g[x, y].p + (10 * i + j))

    def turn(x, y, a, b):
        for i in range(2):
            for j in range(3):
                b.p[j][i].emit(a[x, y].p[i][j])

    run(smap(fill, whole(HD), g, a), smap(turn, whole(HD), a, b))
    return b.to_df().select("x", "y", *(F.col("p")[i][j].alias(f"c{i}{j}") for i in range(3) for j in range(2)))


# Workloads ---------------------------------------------------------------------------------------


def diffusion(x, y, z, g, out):
    """A weighted mean of the star's cells; an edge cell takes the place of neighbours beyond it."""
    here = (x, y, z)
    total = g[here] * 0.25
    for axis in range(3):
        for by, edge in ((-1, 0), (1, g.dim(axis) - 1)):
            near = tuple(c + by if j == axis else c for j, c in enumerate(here))
            total = total + when(here[axis] == edge, g[here], g[near]) * 0.125
    out.emit(total)


@query(
    "diffusion_step",
    f"WITH g AS ({T.sql('dtq', 'DOUBLE')}) SELECT t.x, t.y, t.z, t.v * 0.25"
    + "".join(f" + coalesce(n{i}.v, t.v) * 0.125" for i in range(6))
    + " AS v FROM g t" + "".join(_at("g", f"n{i}", _shift(DT, o, False)) for i, o in enumerate(star(3)[1:])),
)
def _diffusion(gs, d):
    g, out = T.dtq(gs, d, "double"), gs.zeros(DT, "double")
    run(smap(diffusion, whole(DT), g, out))
    return out.to_df()


#: The 18 neighbours of a 19-point step: faces and edges of the cube.
EDGES = [o for o in cube(3) if 0 < sum(map(abs, o)) < 3]
_WEIGHTS = {o: 4 if sum(map(abs, o)) == 1 else 1 for o in EDGES}


def jacobi19(x, y, z, p, out, bnd):
    """A relaxation over 19 points: the residual, where the boundary grid lets it in, is added."""
    total = None
    for o in EDGES:
        cell = p[x + o[0], y + o[1], z + o[2]] * _WEIGHTS[o]
        total = cell if total is None else total + cell
    residual = (total - p[x, y, z] * 36) * bnd[x, y, z]
    out.emit(p[x, y, z] + residual)


@query(
    "jacobi19_step",
    f"WITH g AS ({T.sql('dtq')}) SELECT t.x, t.y, t.z, CASE WHEN {_box(inner(DT))} THEN t.v + ("
    + " + ".join(f"n{i}.v * {_WEIGHTS[o]}" for i, o in enumerate(EDGES))
    + " - t.v * 36) * ((t.x + t.y) % 2) ELSE t.v END AS v FROM g t"
    + "".join(_at("g", f"n{i}", _shift(DT, o, False)) for i, o in enumerate(EDGES)),
)
def _jacobi(gs, d):
    p, out, bnd = T.dtq(gs, d), T.dtq(gs, d), gs.zeros(DT, "int")
    run(smap(lambda x, y, z, b: b.emit((x + y) % 2), whole(DT), bnd))
    run(smap(jacobi19, inner(DT), p, out, bnd))
    return out.to_df()
