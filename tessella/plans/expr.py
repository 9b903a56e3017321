"""Scalar expressions of kernels: a tree with C's types, lowered to Columns or to numpy.

Both lowerings give the same values, also where C leaves them open: integers wrap
at their width, an integer divided by zero (and its remainder) is 0, a float
becomes an integer towards zero, saturated at 64 bits and then wrapped, with NaN
as 0.  Floats follow IEEE 754: log(0) is -inf, NaN equals nothing.  Columns are
built under ``c_arithmetic``, as Spark's own default raises on overflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..model import NUMPY, PRIMITIVES

_ORDER = ("bool", "int", "long", "float", "double")


def promoted(a: str, b: str) -> str:
    """The type of an arithmetic result; conditions count as int."""
    return max(a, b, "int", key=_ORDER.index)


class Expr:
    kind: str

    def children(self) -> tuple[Expr, ...]:
        return ()

    def __bool__(self) -> bool:
        raise TypeError("a kernel is traced: use when(condition, a, b) in place of if, and & | in place of and, or")

    def __add__(self, o):
        return Binary("+", self, lift(o))

    def __radd__(self, o):
        return Binary("+", lift(o), self)

    def __sub__(self, o):
        return Binary("-", self, lift(o))

    def __rsub__(self, o):
        return Binary("-", lift(o), self)

    def __mul__(self, o):
        return Binary("*", self, lift(o))

    def __rmul__(self, o):
        return Binary("*", lift(o), self)

    def __truediv__(self, o):
        return Binary("/", self, lift(o))

    def __rtruediv__(self, o):
        return Binary("/", lift(o), self)

    def __mod__(self, o):
        return Binary("%", self, lift(o))

    def __neg__(self):
        return Binary("-", Const(0, "int"), self) if self.kind in ("int", "long", "bool") else Binary("*", Const(-1.0, self.kind), self)

    def __and__(self, o):
        return Binary("and", self, lift(o))

    def __or__(self, o):
        return Binary("or", self, lift(o))

    def __lt__(self, o):
        return Binary("<", self, lift(o))

    def __le__(self, o):
        return Binary("<=", self, lift(o))

    def __gt__(self, o):
        return Binary(">", self, lift(o))

    def __ge__(self, o):
        return Binary(">=", self, lift(o))

    def __eq__(self, o):  # type: ignore[override]
        return Binary("==", self, lift(o))

    def __ne__(self, o):  # type: ignore[override]
        return Binary("!=", self, lift(o))

    __hash__ = object.__hash__


@dataclass(eq=False)
class Const(Expr):
    value: int | float
    kind: str


@dataclass(eq=False)
class Coord(Expr):
    """Coordinate ``sign * axis + offset``; sign 0 is a constant. Usable as an index and as a value."""

    dim: int
    sign: int = 1
    offset: int = 0
    kind: str = "int"

    def __add__(self, o):
        if isinstance(o, (int, np.integer)) and not isinstance(o, bool):
            return Coord(self.dim, self.sign, self.offset + int(o))
        return super().__add__(o)

    __radd__ = __add__

    def __sub__(self, o):
        if isinstance(o, (int, np.integer)) and not isinstance(o, bool):
            return Coord(self.dim, self.sign, self.offset - int(o))
        return super().__sub__(o)

    def __rsub__(self, o):
        if isinstance(o, (int, np.integer)) and not isinstance(o, bool):
            return Coord(self.dim, -self.sign, int(o) - self.offset)
        return super().__rsub__(o)

    def __neg__(self):
        return Coord(self.dim, -self.sign, -self.offset)

    __hash__ = object.__hash__


@dataclass(eq=False)
class Get(Expr):
    """A read of a grid argument at index ``index`` (a Coord a dimension), of one member or element."""

    arg: str
    index: tuple[Coord, ...]
    periodic: bool
    member: str
    path: tuple[int, ...]
    kind: str

    @property
    def place(self) -> tuple:
        """What tells one gathered cell from another."""
        return self.arg, tuple((c.dim, c.sign, c.offset) for c in self.index), self.periodic


@dataclass(eq=False)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr

    def __post_init__(self):
        self.kind = "bool" if self.op in ("<", "<=", ">", ">=", "==", "!=", "and", "or") else promoted(self.a.kind, self.b.kind)

    def children(self):
        return self.a, self.b


@dataclass(eq=False)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    kind: str = "double"

    def children(self):
        return self.args


@dataclass(eq=False)
class Cast(Expr):
    a: Expr
    kind: str

    def children(self):
        return (self.a,)


@dataclass(eq=False)
class When(Expr):
    condition: Expr
    then: Expr
    otherwise: Expr

    def __post_init__(self):
        same = self.then.kind == self.otherwise.kind
        self.kind = self.then.kind if same else promoted(self.then.kind, self.otherwise.kind)

    def children(self):
        return self.condition, self.then, self.otherwise


def lift(value) -> Expr:
    """A Python number as a constant: int, long beyond 32 bits, double."""
    if isinstance(value, Expr):
        return value
    if isinstance(value, (bool, np.bool_)):
        return Const(int(value), "int")
    if isinstance(value, (int, np.integer)):
        return Const(int(value), "int" if -(2**31) <= value < 2**31 else "long")
    if isinstance(value, np.float32):
        return Const(float(value), "float")
    if isinstance(value, (float, np.floating)):
        return Const(float(value), "double")
    raise TypeError(f"{value!r} can't be used in a kernel")


def gets(e: Expr, guarded: bool = False) -> Iterator[tuple[Get, bool]]:
    """Every read below, and whether a condition stands above it."""
    if isinstance(e, Get):
        yield e, guarded
    for k, child in enumerate(e.children()):
        yield from gets(child, guarded or isinstance(e, When) and k > 0)


@contextmanager
def c_arithmetic(spark: SparkSession) -> Iterator[None]:
    """Frames made inside have integer arithmetic that wraps; the session's own setting is put back.

    Spark fixes an expression's overflow rule when the frame is analysed, which
    is when it is made.
    """
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def wrapped(value: Column, bits: int = 32) -> Column:
    """A bigint as a two's complement integer of 32 bits."""
    half = 1 << (bits - 1)
    return F.pmod(value + F.lit(half), F.lit(1 << bits)) - F.lit(half)


def to_kind(value: Column, have: str, want: str) -> Column:
    """C's conversion. Integers are carried as bigint and wrapped where they become int."""
    if have == want:
        return value
    if want in ("int", "long"):
        if have in ("float", "double"):
            whole = F.when(F.isnan(value), F.lit(0).cast("bigint")).otherwise(value.cast("bigint"))
            return wrapped(whole) if want == "int" else whole
        if have == "bool":
            return value.cast("int").cast("bigint")
        return wrapped(value) if want == "int" else value
    if have == "bool":
        value = value.cast("int")
    return value.cast(PRIMITIVES[want])


def column(e: Expr, read: Callable[[Get], Column], axes: tuple[str, ...]) -> Column:
    """Lower to a Column; ``read`` gives the column of a read cell."""
    go = lambda x: column(x, read, axes)
    if isinstance(e, Const):
        return F.lit(e.value).cast("bigint" if e.kind in ("int", "long") else PRIMITIVES[e.kind])
    if isinstance(e, Coord):
        value = F.col(axes[e.dim]).cast("bigint") * F.lit(e.sign) if e.sign else F.lit(0).cast("bigint")
        return value + F.lit(e.offset)
    if isinstance(e, Get):
        value = read(e)
        return value.cast("bigint") if e.kind in ("int", "long") else value
    if isinstance(e, Cast):
        return to_kind(go(e.a), e.a.kind, e.kind)
    if isinstance(e, When):
        a, b = (to_kind(go(x), x.kind, e.kind) for x in (e.then, e.otherwise))
        return F.when(truth(e.condition, go), a).otherwise(b)
    if isinstance(e, Call):
        args = [go(a) for a in e.args]
        return {"exp": F.exp, "log": _log, "sqrt": F.sqrt, "cos": F.cos, "sin": F.sin, "acos": F.acos, "abs": F.abs, "pow": F.pow}[e.name](*args)
    if e.op in ("and", "or"):
        a, b = truth(e.a, go), truth(e.b, go)
        return a & b if e.op == "and" else a | b
    both = promoted(e.a.kind, e.b.kind)
    a, b = (to_kind(go(x), x.kind, both) for x in (e.a, e.b))
    if e.op == "+":
        out = a + b
    elif e.op == "-":
        out = a - b
    elif e.op == "*":
        out = a * b
    elif e.op == "%":
        out = F.when(b == 0, F.lit(0).cast("bigint")).otherwise(a % b) if both in ("int", "long") else a % b
    elif e.op == "/" and both in ("int", "long"):
        out = F.when(b == 0, F.lit(0).cast("bigint")).otherwise(_div(a, b))
    elif e.op == "/":
        out = _float_divide(a, b, both)
    else:
        return _compared(e.op, a, b, both in ("float", "double"))
    return wrapped(out) if both == "int" and e.op in "+-*" else out


def _log(a: Column) -> Column:
    # Spark has NULL at and below 0; its NaN is greater than all numbers
    return F.when(a > 0, F.log(a)).when(a == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _compared(op: str, a: Column, b: Column, floats: bool) -> Column:
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    if not floats:
        return out
    if op == "!=":  # Spark's NaN equals itself and is greater than all numbers
        return out | F.isnan(a)
    return out & ~F.isnan(b if op in ("<", "<=") else a)


def _div(a: Column, b: Column) -> Column:
    # towards zero: what the remainder leaves is a multiple, so the quotient is exact
    return F.call_function("div", a, b)


def _float_divide(a: Column, b: Column, kind: str) -> Column:
    a, b = a.cast("double"), b.cast("double")
    infinite = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, infinite).otherwise(a / b).cast(PRIMITIVES[kind])


def truth(e: Expr, go: Callable[[Expr], Column]) -> Column:
    return go(e) if e.kind == "bool" else go(e) != F.lit(0)


def converted(value: np.ndarray, kind: str) -> np.ndarray:
    """``to_kind`` of arrays."""
    if kind in ("int", "long") and value.dtype.kind == "f":
        big, small = value >= 2.0**63, value < -(2.0**63)
        whole = np.where(np.isnan(value) | big | small, 0, value).astype("int64")
        value = np.where(big, np.int64(2**63 - 1), np.where(small, np.int64(-(2**63)), whole))
    return value.astype(NUMPY[kind])


def array(e: Expr, read: Callable[[Get], np.ndarray], axes: list[np.ndarray]):
    """Lower to numpy over whole arrays: both branches of a condition are evaluated."""
    go = lambda x: array(x, read, axes)
    as_ = lambda x, kind: converted(np.asarray(go(x)), kind)
    if isinstance(e, Const):
        return np.asarray(e.value, NUMPY[e.kind])
    if isinstance(e, Coord):
        return (axes[e.dim] * e.sign + e.offset).astype("int32") if e.sign else np.asarray(e.offset, "int32")
    if isinstance(e, Get):
        return read(e)
    if isinstance(e, Cast):
        return as_(e.a, e.kind)
    if isinstance(e, When):
        return np.where(np.asarray(go(e.condition)).astype(bool), as_(e.then, e.kind), as_(e.otherwise, e.kind))
    if isinstance(e, Call):
        names = {"acos": "arccos", "pow": "power"}
        return getattr(np, names.get(e.name, e.name))(*(go(a) for a in e.args))
    if e.op in ("and", "or"):
        a, b = (np.asarray(go(x)).astype(bool) for x in (e.a, e.b))
        return a & b if e.op == "and" else a | b
    both = promoted(e.a.kind, e.b.kind)
    a, b = as_(e.a, both), as_(e.b, both)
    if e.op == "/" and both in ("int", "long"):
        some = np.where(b == 0, 1, b)
        whole = a // some
        whole += (whole < 0) & (whole * some != a)  # floored below zero: one up
        return np.where(b == 0, 0, whole).astype(NUMPY[both])
    if e.op == "%" and both in ("int", "long"):
        return np.fmod(a, np.where(b == 0, 1, b))
    done = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": np.fmod, "<": np.less, "<=": np.less_equal,
            ">": np.greater, ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal}[e.op]
    return done(a, b)
