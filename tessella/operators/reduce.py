"""Reductions of whole grids, and of an expression over a domain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Domain
from ..plans.expr import c_arithmetic, column, wrapped
from ..plans.trace import Emit, StencilMap, Traced, _names, trace
from .grids import Grid
from .stencil import gather

OPS = ("max", "min", "sum", "prod")


def _aggregate(frame: DataFrame, op: str, value: Column, kind: str, overflow: str) -> DataFrame:
    """max and min keep the type (NaN is greatest); sums and products of integers are bigint and wrap, the others double.

    ``overflow='wrap32'`` gives an integer result as C's int would hold it.
    """
    if op not in OPS:
        raise ValueError(f"{op} is not one of {OPS}")
    if op in ("max", "min"):
        return frame.agg((F.max(value) if op == "max" else F.min(value)).alias("value"))
    whole = kind in ("int", "long")
    if op == "prod" and whole:
        frame, out = _products(frame.select(value.cast("bigint").alias("v"))), F.aggregate(F.collect_list("v"), F.lit(1).cast("bigint"), lambda a, x: a * x)
    elif op == "prod":
        out = F.product(value.cast("double"))
    else:
        out = F.sum(value.cast("bigint" if whole else "double"))
    return frame.agg((wrapped(out) if whole and overflow == "wrap32" else out).alias("value"))


def _products(frame: DataFrame) -> DataFrame:
    """The product of each partition's values, modulo 2**64: Spark's own product is in double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.int64(1), False
        with np.errstate(over="ignore"):
            for batch in batches:
                total, some = total * np.multiply.reduce(batch.column(0).to_numpy(), dtype=np.int64), some or len(batch) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["v"])

    return frame.mapInArrow(run, "v long")


def reduce_grid_df(grid: Grid, op: str, member: str | None = None, overflow: str = "widen") -> DataFrame:
    """One row, column ``value``: the reduction of all cells. A struct grid needs a member."""
    if not grid.type.primitive and member is None:
        raise ValueError("a struct grid is reduced one member at a time")
    name = member or "v"
    m = grid.type.members[name]
    if m.shape:
        raise ValueError(f"{name} is an array")
    with c_arithmetic(grid.session.spark):
        return _aggregate(grid.frame, op, F.col(name), m.kind, overflow)


def reduce_grid(grid: Grid, op: str, member: str | None = None, overflow: str = "widen"):
    return reduce_grid_df(grid, op, member, overflow).first()["value"]


def map_reduce_df(op: str, kernel: Callable, domain: Domain, *args, overflow: str = "widen") -> DataFrame:
    """One row, column ``value``: what the kernel returns at every place of a domain, reduced."""
    names = _names(kernel, domain.rank, args)
    t: Traced = trace(kernel, domain, names, returns=True)
    base = next((a for a in names.values() if isinstance(a, Grid) and len(a.dims) == domain.rank), None)
    if base is None:
        raise ValueError("a reduction reads a grid of its domain's rank")
    m = StencilMap.__new__(StencilMap)
    m.kernel, m.domain, m.args, m.color, m.both_colors = kernel, domain, names, None, False
    first = next(n for n, a in names.items() if a is base)
    m.traced = Traced([Emit(first, next(iter(base.type.members)), (), t.value, None)], t.reads, t.guarded)
    with c_arithmetic(base.session.spark):
        frame, read = gather(m, {first: base}, None, None)
        value = column(t.value, read, ("x", "y", "z"))
        return _aggregate(frame.where(domain.predicate()), op, value, t.value.kind, overflow)


def map_reduce(op: str, kernel: Callable, domain: Domain, *args, overflow: str = "widen"):
    return map_reduce_df(op, kernel, domain, *args, overflow=overflow).first()["value"]
