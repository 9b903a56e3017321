"""Cell types, extents and domains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("x", "y", "z")
PRIMITIVES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
NUMPY = {"int": "int32", "long": "int64", "float": "float32", "double": "float64"}
MAX_MEMBER_RANK = 5


@dataclass(frozen=True)
class Member:
    """A member of a struct cell: a scalar type and the extents of an array, () for a scalar."""

    kind: str
    shape: tuple[int, ...] = ()


@dataclass(frozen=True)
class GridType:
    """Rank and cell type; a primitive cell is the one member ``v``."""

    rank: int
    members: dict[str, Member] = field(hash=False)
    primitive: bool = True

    @staticmethod
    def of(rank: int, cell: str | dict[str, str | tuple]) -> GridType:
        """``cell``: int, long, float or double, or {member: kind or (kind, extents...)}."""
        if not 1 <= rank <= len(AXES):
            raise ValueError(f"rank {rank} is not 1, 2 or 3")
        if isinstance(cell, str):
            if cell not in PRIMITIVES:
                raise ValueError(f"unknown cell type {cell}")
            return GridType(rank, {"v": Member(cell)})
        if not cell:
            raise ValueError("a struct cell needs a member")
        members = {}
        for name, kind in cell.items():
            kind, *shape = (kind,) if isinstance(kind, str) else kind
            if kind not in ("float", "double"):
                raise ValueError(f"member {name} is {kind}; struct members are float or double")
            if len(shape) > MAX_MEMBER_RANK:
                raise ValueError(f"member {name} has more than {MAX_MEMBER_RANK} array dimensions")
            if name in AXES[:rank] and name != "v":
                name = f"m_{name}"
            members[name] = Member(kind, tuple(shape))
        return GridType(rank, members, primitive=False)

    def schema(self) -> T.StructType:
        fields = [T.StructField(a, T.IntegerType(), False) for a in AXES[: self.rank]]
        for name, m in self.members.items():
            kind: T.DataType = PRIMITIVES[m.kind]
            for _ in m.shape:
                kind = T.ArrayType(kind, False)
            fields.append(T.StructField(name, kind, False))
        return T.StructType(fields)


class Domain:
    """A half-open box: one (min, max) a dimension."""

    def __init__(self, *ranges: tuple[int, int]):
        if not 1 <= len(ranges) <= len(AXES):
            raise ValueError("a domain has 1 to 3 dimensions")
        self.ranges = tuple((int(a), int(b)) for a, b in ranges)

    @property
    def rank(self) -> int:
        return len(self.ranges)

    def predicate(self, names: tuple[str, ...] = AXES) -> Column:
        out = F.lit(True)
        for name, (low, high) in zip(names, self.ranges, strict=False):
            out &= (F.col(name) >= low) & (F.col(name) < high)
        return out

    def face(self, dim: int, width: int, upper: bool) -> Domain:
        """The ``width`` outermost layers of one side."""
        ranges = list(self.ranges)
        low, high = ranges[dim]
        ranges[dim] = (max(low, high - width), high) if upper else (low, min(high, low + width))
        return Domain(*ranges)

    def shrink(self, width: int) -> Domain:
        return Domain(*((a + width, max(a + width, b - width)) for a, b in self.ranges))

    def grow(self, widths: list[tuple[int, int]], dims: tuple[int, ...]) -> Domain:
        """The box that reads at these least and greatest offsets can touch, within ``dims``."""
        return Domain(*((max(0, a + lo), min(n, b + hi)) for (a, b), (lo, hi), n in zip(self.ranges, widths, dims, strict=True)))

    def __repr__(self) -> str:
        return f"Domain{self.ranges}"
