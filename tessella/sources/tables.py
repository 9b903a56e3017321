"""Grids derived from the driver's tables, each with the SQL that gives the same cells."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.grids import Grid, GridSession


def _day(col: str, start: str):
    return F.datediff(F.col(col).cast("date"), F.lit(start).cast("date"))


@contextmanager
def utc(spark: SparkSession) -> Iterator[None]:
    """Frames made inside read clocks in UTC; the session's own zone is put back.

    Spark fixes an expression's zone when the frame is analysed, which is when it is made.
    """
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, "UTC")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def event_hd(gs: GridSession, sf_dir: str, cell: str = "long") -> Grid:
    """Events by hour of day and day: 24 x 30."""
    events = gs.spark.read.parquet(f"{sf_dir}/events.parquet")
    return gs.from_table(events, (24, 30), [F.hour("ts"), _day("ts", "2024-01-01")], {"v": F.count("*")}, cell)


def event_cents(gs: GridSession, sf_dir: str, cell: str = "long") -> Grid:
    """Cents by hour of day and day: 24 x 30."""
    events = gs.spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return gs.from_table(events, (24, 30), [F.hour("ts"), _day("ts", "2024-01-01")], {"v": cents}, cell)


def event_pq(gs: GridSession, sf_dir: str) -> Grid:
    """Struct cells: p the count, q the cents of an hour and day."""
    events = gs.spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return gs.from_table(
        events, (24, 30), [F.hour("ts"), _day("ts", "2024-01-01")], {"p": F.count("*"), "q": cents}, {"p": "double", "q": "double"}
    )


def ship_day(gs: GridSession, sf_dir: str) -> Grid:
    """Lines by ship day: 2500."""
    lines = gs.spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return gs.from_table(lines, (2500,), [_day("l_shipdate", "1995-01-01")], {"v": F.count("*")}, "long")


def nation_month(gs: GridSession, sf_dir: str) -> Grid:
    """Cents of orders by customer nation and month: 25 x 80."""
    orders = gs.spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = gs.spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return gs.from_table(rows, (25, 80), [F.col("c_nationkey"), month], {"v": cents}, "long")


def dtq(gs: GridSession, sf_dir: str, cell: str = "long") -> Grid:
    """Lines by discount, tax and quantity: 11 x 9 x 50."""
    lines = gs.spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    coords = [F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.col("l_quantity") - 1]
    return gs.from_table(lines, (11, 9, 50), coords, {"v": F.count("*")}, cell)


def _points(dims: tuple[int, ...]) -> str:
    cols, step, total = [], 1, 1
    for axis, n in zip("xyz", dims, strict=False):
        cols.append(f"CAST(i // {step} % {n} AS INTEGER) AS {axis}")
        step *= n
        total *= n
    return f"SELECT {', '.join(cols)} FROM range({total}) r(i)"


def _dense(dims: tuple[int, ...], source: str, values: dict[str, str], kinds: dict[str, str]) -> str:
    axes = "xyz"[: len(dims)]
    cols = ", ".join(f"CAST(coalesce(c.{n}, 0) AS {kinds[n]}) AS {n}" for n in values)
    on = " AND ".join(f"p.{a} = c.{a}" for a in axes)
    group = ", ".join(str(i + 1) for i in range(len(dims)))
    sums = ", ".join(f"{e} AS {n}" for n, e in values.items())
    return f"SELECT {', '.join('p.' + a for a in axes)}, {cols} FROM ({_points(dims)}) p LEFT JOIN (SELECT {source.format(sums=sums)} GROUP BY {group}) c ON {on}"


_HD = "hour(ts) AS x, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS y, {sums} FROM events"
_CENTS = "sum(CAST(round(value * 100) AS BIGINT))"


def sql(name: str, kind: str = "BIGINT") -> str:
    """The cells of a grid above, as SQL."""
    if name == "event_hd":
        return _dense((24, 30), _HD, {"v": "count(*)"}, {"v": kind})
    if name == "event_cents":
        return _dense((24, 30), _HD, {"v": _CENTS}, {"v": kind})
    if name == "event_pq":
        return _dense((24, 30), _HD, {"p": "count(*)", "q": _CENTS}, {"p": "DOUBLE", "q": "DOUBLE"})
    if name == "ship_day":
        return _dense((2500,), "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS x, {sums} FROM lineitem", {"v": "count(*)"}, {"v": kind})
    if name == "nation_month":
        source = (
            "c_nationkey AS x, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS y, {sums} "
            "FROM orders JOIN customer ON o_custkey = c_custkey"
        )
        return _dense((25, 80), source, {"v": "sum(CAST(round(o_totalprice * 100) AS BIGINT))"}, {"v": kind})
    if name == "dtq":
        source = (
            "CAST(round(l_discount * 100) AS INTEGER) AS x, CAST(round(l_tax * 100) AS INTEGER) AS y, "
            "CAST(l_quantity AS INTEGER) - 1 AS z, {sums} FROM lineitem"
        )
        return _dense((11, 9, 50), source, {"v": "count(*)"}, {"v": kind})
    raise KeyError(name)


def points_sql(dims: tuple[int, ...]) -> str:
    return _points(dims)
