"""What a kernel may call: conditions, casts and the mathematical functions."""

from __future__ import annotations

from ..plans.expr import Binary, Call, Cast, Const, Expr, When, lift


def when(condition: Expr, then, otherwise) -> Expr:
    """``condition ? then : otherwise``; reads in a branch may lie outside where it isn't taken."""
    return When(lift(condition), lift(then), lift(otherwise))


def f32(value: float) -> Expr:
    """A float constant (a bare Python float is a double)."""
    return Const(float(value), "float")


def cast(value, kind: str) -> Expr:
    return Cast(lift(value), kind)


def _unary(name: str, single: bool):
    def call(value) -> Expr:
        out = Call(name, (Cast(lift(value), "double"),))
        return Cast(out, "float") if single else out

    call.__name__ = name + "f" * single
    call.__doc__ = f"{name}, in double precision" + (", given as float." if single else ".")
    return call


exp, expf = _unary("exp", False), _unary("exp", True)
log, logf = _unary("log", False), _unary("log", True)
sqrt, sqrtf = _unary("sqrt", False), _unary("sqrt", True)
cos, cosf = _unary("cos", False), _unary("cos", True)
sin, sinf = _unary("sin", False), _unary("sin", True)
acos, acosf = _unary("acos", False), _unary("acos", True)
fabs, fabsf = _unary("abs", False), _unary("abs", True)


def pow(base, power) -> Expr:  # noqa: A001
    """base to the power, in double precision."""
    return Call("pow", (Cast(lift(base), "double"), Cast(lift(power), "double")))


def powf(base, power) -> Expr:
    return Cast(pow(base, power), "float")


def logical_and(a, b) -> Expr:
    return Binary("and", lift(a), lift(b))


def logical_or(a, b) -> Expr:
    return Binary("or", lift(a), lift(b))
