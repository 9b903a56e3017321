"""Stencil computations on dense 1-, 2- and 3-dimensional grids, planned as DataFrames.

    from tessella import Domain, Grid, GridSession, run, smap, when

    def five_point(x, y, g, out):
        out.emit(g[x, y] + g[x + 1, y] + g[x - 1, y] + g[x, y + 1] + g[x, y - 1])

    gs = GridSession(spark, (64, 64))
    a, b = gs.from_numpy(array), gs.zeros((64, 64), "float")
    run(smap(five_point, Domain((1, 63), (1, 63)), a, b), iters=10)
"""

from .functions.kernel import cast, f32, when
from .model import Domain, GridType
from .operators.grids import Grid, GridSession
from .operators.reduce import map_reduce, reduce_grid
from .operators.run import RunResult, run
from .operators.tune import Settings, tuned
from .plans.trace import StencilMap, smap, smap_black, smap_red, smap_redblack

__all__ = [
    "Domain", "Grid", "GridSession", "GridType", "RunResult", "Settings", "StencilMap", "cast", "f32", "map_reduce", "reduce_grid",
    "run", "smap", "smap_black", "smap_red", "smap_redblack", "tuned", "when",
]
