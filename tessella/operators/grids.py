"""Grids as DataFrames: one row a cell, coordinates first, then the cell's members."""

from __future__ import annotations

import time
from collections.abc import Iterable
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AXES, NUMPY, PRIMITIVES, Domain, GridType
from ..plans.expr import to_kind


def nested(shape: tuple[int, ...], leaf):
    """An array Column of the given extents; ``leaf(path)`` gives its elements."""

    def build(path: tuple[int, ...]):
        if len(path) == len(shape):
            return leaf(path)
        return F.array(*[build((*path, i)) for i in range(shape[len(path)])])

    return build(())


def points(spark: SparkSession, dims: tuple[int, ...]) -> DataFrame:
    """All coordinates of a grid, the first axis fastest."""
    rows, step = spark.range(prod(dims)), 1
    cols = []
    for axis, n in zip(AXES, dims, strict=False):
        cols.append(F.expr(f"cast(id div {step} % {n} as int)").alias(axis))
        step *= n
    return rows.select(*cols)


#: Writes from the driver after which a grid's lineage is cut.
WRITES = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    In local mode one is set where there is none; a cluster session has to name it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if path is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file:///tmp/checkpoints/tessella"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The frame without its lineage, through the shared folder.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` has Spark remove the files with the frame.
    """
    shared_folder(spark)
    return frame.checkpoint(eager=True)


def checkpointed(grid: Grid) -> None:
    """Cut the lineage of a grid."""
    grid.frame = cut(grid.session.spark, grid.frame)


class Grid:
    """A dense grid. Its frame holds exactly one row a cell; maps and writes replace the frame."""

    def __init__(self, session: GridSession, type_: GridType, dims: tuple[int, ...], frame: DataFrame):
        self.session, self.type, self.dims, self.frame = session, type_, tuple(dims), frame
        self._writes = 0

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: len(self.dims)]

    @property
    def linear(self):
        """The cell's place in memory order, as a Column."""
        out, step = F.lit(0).cast("bigint"), 1
        for axis, n in zip(self.axes, self.dims, strict=True):
            out, step = out + F.col(axis).cast("bigint") * F.lit(step), step * n
        return out

    def dim(self, d: int) -> int:
        return self.dims[d]

    def domain(self) -> Domain:
        return Domain(*((0, n) for n in self.dims))

    def to_df(self) -> DataFrame:
        return self.frame.select(*self.axes, *self.type.members)

    def to_table(self) -> DataFrame:
        """The cells with their place in memory order as ``id``."""
        return self.frame.select(self.linear.alias("id"), *self.axes, *self.type.members)

    def to_numpy(self) -> np.ndarray | dict[str, np.ndarray]:
        """Copy out to the driver: arrays indexed [x], [x, y] or [x, y, z]."""
        rows = self.to_df().toPandas()
        at = tuple(rows[a].to_numpy() for a in self.axes)
        out = {}
        for name, m in self.type.members.items():
            held = np.zeros((*self.dims, *m.shape), NUMPY[m.kind])
            values = rows[name].to_numpy() if not m.shape else np.stack([np.array(_plain(v), NUMPY[m.kind]) for v in rows[name]]) if len(rows) else held
            held[at] = values
            out[name] = held
        return out["v"] if self.type.primitive else out

    def write_parquet(self, path: str) -> None:
        self.to_df().write.mode("overwrite").parquet(path)

    def get(self, *index: int, member: str | None = None):
        """Read one cell from the driver. Reads never wrap here."""
        self._inside(index)
        row = self.frame.where(self._at(index)).first()
        if self.type.primitive:
            return row["v"]
        return row[member] if member else {m: row[m] for m in self.type.members}

    def set(self, *index_and_value) -> None:
        """Write one cell: coordinates, then the value."""
        *index, value = index_and_value
        self.set_many([(tuple(index), value)])

    def set_many(self, writes: Iterable[tuple[tuple[int, ...], object]]) -> None:
        """Write some cells in one pass, by a broadcast join; the last of equal places holds.

        Lineage is cut every ``WRITES`` calls.
        """
        last = {}
        for index, value in writes:
            self._inside(index)
            last[tuple(int(i) for i in index)] = value if isinstance(value, dict) else {"v": value}
        if not last:
            return
        schema = GridType(self.type.rank, self.type.members, self.type.primitive).schema()
        rows = []
        for index, value in last.items():
            rows.append((*index, *(_typed(value[n], m.kind) for n, m in self.type.members.items())))
        news = self.session.spark.createDataFrame(rows, schema).withColumn("_new", F.lit(True))
        news = news.select(*self.axes, "_new", *(F.col(n).alias(f"_n_{n}") for n in self.type.members))
        news = F.broadcast(news) if len(rows) <= 100_000 else news
        out = self.frame.join(news, list(self.axes), "left")
        self.frame = out.select(*self.axes, *(F.when(F.col("_new"), F.col(f"_n_{n}")).otherwise(F.col(n)).alias(n) for n in self.type.members))

        self._writes += 1
        if self._writes % WRITES == 0:
            checkpointed(self)

    def save(self, name: str) -> None:
        """Keep the cells under a name in the shared folder (see ``GridSession.restore``); a later save replaces it."""
        self.write_parquet(f"{shared_folder(self.session.spark)}/grids/{name}")

    def partitioned(self, parts: tuple[int, ...]) -> DataFrame:
        """The cells with the number of their block, a partition a block (see ``block_of``)."""
        block, step = F.lit(0), 1
        for axis, n, p in zip(self.axes, self.dims, parts, strict=True):
            block, step = block + block_of(axis, n, p) * F.lit(step), step * p
        return self.to_df().withColumn("block", block.cast("int")).repartitionById(step, "block")

    def evaluated(self) -> float:
        """Compute all cells and drop them; returns the seconds it took."""
        began = time.perf_counter()
        self.to_df().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    def reduce(self, op: str, domain: Domain | None = None, kernel=None, **options):
        """max, min, sum or prod of the cells, or of what a kernel gives, over a domain (or the whole grid)."""
        from .reduce import map_reduce, reduce_grid

        if domain is None and kernel is None:
            return reduce_grid(self, op, **options)
        return map_reduce(op, kernel or _itself(len(self.dims)), domain or self.domain(), self, **options)

    def free(self) -> None:
        self.frame.unpersist()
        self.session.grids.discard(self)

    def checked(self) -> Grid:
        """Raise unless the frame holds every cell once."""
        n = self.frame.select(*self.axes).where(self.domain().predicate(self.axes)).distinct().count()
        if n != prod(self.dims) or self.frame.count() != n:
            raise ValueError(f"a grid of {self.dims} needs {prod(self.dims)} cells, each once")
        return self

    def _at(self, index):
        out = F.lit(True)
        for axis, i in zip(self.axes, index, strict=True):
            out &= F.col(axis) == int(i)
        return out

    def _inside(self, index) -> None:
        if len(index) != len(self.dims) or any(not 0 <= i < n for i, n in zip(index, self.dims, strict=True)):
            raise IndexError(f"{tuple(index)} is not a cell of {self.dims}")


def block_of(axis: str, n: int, parts: int):
    """Which of ``parts`` blocks of an axis of ``n`` cells a coordinate lies in; what remains of ``n / parts`` widens the last ones."""
    if not 0 < parts <= n:
        raise ValueError(f"{n} cells can't be cut in {parts} blocks")
    base, more = divmod(n, parts)
    plain = parts - more  # blocks of the least width
    edge = plain * base
    at = F.col(axis)
    return F.when(at < edge, F.floor(at / base)).otherwise(plain + F.floor((at - edge) / (base + 1))).cast("int")


def _itself(rank: int):
    return {1: lambda x, g: g[x], 2: lambda x, y, g: g[x, y], 3: lambda x, y, z, g: g[x, y, z]}[rank]


def _plain(v):
    return [_plain(x) for x in v] if isinstance(v, (list, np.ndarray)) else v


def _typed(value, kind: str):
    if isinstance(value, (list, tuple, np.ndarray)):
        return [_typed(v, kind) for v in value]
    return float(value) if kind in ("float", "double") else int(value)


class GridSession:
    """Makes grids on a SparkSession, none larger than ``max_dims``."""

    def __init__(self, spark: SparkSession, max_dims: tuple[int, ...] | None = None):
        self.spark, self.max_dims, self.grids = spark, max_dims, set()

    def _made(self, type_: GridType, dims: tuple[int, ...], frame: DataFrame) -> Grid:
        if any(n <= 0 for n in dims):
            raise ValueError(f"extents {dims} are not positive")
        if self.max_dims and any(n > m for n, m in zip(dims, self.max_dims, strict=False)):
            raise ValueError(f"a grid of {dims} is larger than the session's {self.max_dims}")
        grid = Grid(self, type_, dims, frame)
        self.grids.add(grid)
        return grid

    def zeros(self, dims: tuple[int, ...], cell="float") -> Grid:
        type_ = GridType.of(len(dims), cell)
        zero = lambda m: nested(m.shape, lambda _: F.lit(0).cast(PRIMITIVES[m.kind]))
        return self._made(type_, dims, points(self.spark, dims).select("*", *(zero(m).alias(n) for n, m in type_.members.items())))

    def iota(self, dims: tuple[int, ...], cell: str = "float", start: int = 0) -> Grid:
        """Each cell holds its place in memory order, plus ``start``."""
        grid = self.zeros(dims, cell)
        value = to_kind(grid.linear + F.lit(start), "long", cell)
        grid.frame = grid.frame.select(*grid.axes, value.cast(PRIMITIVES[cell]).alias("v"))
        return grid

    def from_numpy(self, values: np.ndarray | dict[str, np.ndarray], cell=None) -> Grid:
        """Copy in from arrays indexed [x], [x, y] or [x, y, z] (then a member's own indices)."""
        if not isinstance(values, dict):
            values = {"v": values}
            back = {v: k for k, v in NUMPY.items()}
            cell = cell or back[str(values["v"].dtype)]
            rank = values["v"].ndim
        else:
            rank = min(v.ndim for v in values.values()) if cell is None else next(v.ndim - (len(cell[n]) - 1 if isinstance(cell[n], tuple) else 0) for n, v in values.items())
            cell = cell or {n: ("float" if v.dtype == np.float32 else "double") for n, v in values.items()}
        type_ = GridType.of(rank, cell)
        dims = next(iter(values.values())).shape[:rank]
        at = np.indices(dims).reshape(rank, -1)
        data = {a: at[k].astype("int32") for k, a in enumerate(AXES[:rank])}
        for (name, m), v in zip(type_.members.items(), values.values(), strict=True):
            flat = np.asarray(v, NUMPY[m.kind]).reshape(-1, *m.shape)
            data[name] = flat if not m.shape else [x.tolist() for x in flat]
        return self._made(type_, dims, self.spark.createDataFrame(pd.DataFrame(data), type_.schema()))

    def from_memory(self, values, dims: tuple[int, ...], cell: str = "float") -> Grid:
        """Copy in from linear memory, the first axis fastest."""
        return self.from_numpy(np.asarray(values, NUMPY[cell]).reshape(dims[::-1]).transpose(), cell)

    def from_table(self, df: DataFrame, dims: tuple[int, ...], coords: list, values: dict[str, object], cell="long") -> Grid:
        """Aggregate a table into a grid: coordinate Columns, and an aggregate Column a member.

        Rows outside the extents or with a null coordinate are left out; cells
        without rows hold 0.  One shuffle for the sums; the empty cells come by
        a join with the grid's points.
        """
        type_ = GridType.of(len(dims), cell)
        axes = AXES[: len(dims)]
        rows = df.select("*", *(c.cast("int").alias(f"_{a}") for a, c in zip(axes, coords, strict=True)))
        rows = rows.where(Domain(*((0, n) for n in dims)).predicate(tuple(f"_{a}" for a in axes)))
        sums = rows.groupBy(*(F.col(f"_{a}").alias(a) for a in axes)).agg(*(v.alias(n) for n, v in values.items()))
        dense = points(self.spark, dims).join(sums, list(axes), "left")
        cols = [F.coalesce(F.col(n), F.lit(0)).cast(PRIMITIVES[m.kind]).alias(n) for n, m in type_.members.items()]
        return self._made(type_, dims, dense.select(*axes, *cols))

    def from_df(self, df: DataFrame, dims: tuple[int, ...], cell="float") -> Grid:
        """Take a frame of coordinates and members as it is (see ``Grid.checked``)."""
        type_ = GridType.of(len(dims), cell)
        return self._made(type_, dims, df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in type_.schema())))

    def read_parquet(self, path: str, dims: tuple[int, ...], cell="float") -> Grid:
        return self.from_df(self.spark.read.schema(GridType.of(len(dims), cell).schema()).parquet(path), dims, cell)

    def restore(self, name: str, dims: tuple[int, ...], cell="float") -> Grid:
        """The grid that was saved under a name."""
        return self.read_parquet(f"{shared_folder(self.spark)}/grids/{name}", dims, cell)

    def forget(self, name: str) -> None:
        """Remove a saved grid."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark)}/grids/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def finish(self) -> None:
        """Release all grids."""
        for grid in list(self.grids):
            grid.free()

    def info(self, plans: bool = False) -> str:
        """Extents and members of every grid; with the plan that makes its cells, if asked."""
        out = []
        for g in sorted(self.grids, key=lambda g: (g.dims, str(g.type))):
            out.append(f"{g.dims} {dict(g.type.members)}")
            if plans:
                out.append(g.frame._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(out)


