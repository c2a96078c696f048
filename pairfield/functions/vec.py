"""Vector and scalar maths as Column expressions; three flat columns stand for a vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


class Vec:
    """Three Columns with component-wise arithmetic."""

    def __init__(self, x, y, z):
        self.parts = tuple(c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))

    @classmethod
    def of(cls, prefix: str = "") -> Vec:
        return cls(*(F.col(prefix + a) for a in AXES))

    def _with(self, other, f) -> Vec:
        them = other.parts if isinstance(other, Vec) else (other,) * 3
        return Vec(*(f(a, b) for a, b in zip(self.parts, them, strict=True)))

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: a / b)

    def __neg__(self):
        return Vec(*(-a for a in self.parts))

    def dot(self, o: Vec) -> Column:
        a, b, c = (p * q for p, q in zip(self.parts, o.parts, strict=True))
        return a + b + c

    def norm_squared(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm_squared())

    def inverse_norm(self) -> Column:
        """Null for the zero vector."""
        return F.try_divide(F.lit(1.0), self.norm())

    def inverse_norm_squared(self) -> Column:
        """Null for the zero vector."""
        return F.try_divide(F.lit(1.0), self.norm_squared())

    def __getitem__(self, i: int) -> Column:
        return self.parts[i]

    def _every(self, o: Vec, f) -> Column:
        a, b, c = (f(p, q) for p, q in zip(self.parts, o.parts, strict=True))
        return a & b & c

    def equals(self, o: Vec) -> Column:
        return self._every(o, lambda a, b: a == b)

    def __le__(self, o: Vec) -> Column:
        return self._every(o, lambda a, b: a <= b)

    def __ge__(self, o: Vec) -> Column:
        return self._every(o, lambda a, b: a >= b)

    def __lt__(self, o: Vec) -> Column:
        return self._every(o, lambda a, b: a < b)

    def __gt__(self, o: Vec) -> Column:
        return self._every(o, lambda a, b: a > b)

    def to_string(self) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(", ", *[c.cast("string") for c in self.parts]), F.lit("}"))

    def largest(self) -> Column:
        return F.greatest(*self.parts)

    def least(self) -> Column:
        return F.least(*self.parts)

    def any(self, test) -> Column:
        a, b, c = map(test, self.parts)
        return a | b | c

    def all(self, test) -> Column:
        a, b, c = map(test, self.parts)
        return a & b & c

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + a) for c, a in zip(self.parts, AXES, strict=True)]


def rsqrt(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.sqrt(x))


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def hypot3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def fma(x: Column, y: Column, z: Column) -> Column:
    """Two roundings; Spark has no fused form."""
    return x * y + z


def fmod(x: Column, y: Column) -> Column:
    return F.try_mod(x, y)


def remainder(x: Column, y: Column) -> Column:
    return x - y * F.rint(F.try_divide(x, y))


def copysign(x: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(x)).otherwise(F.abs(x))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def isinf(x: Column) -> Column:
    return (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))


def isfinite(x: Column) -> Column:
    return ~(isinf(x) | F.isnan(x))


def signbit(x: Column) -> Column:
    """Whether the sign is negative, also of -0.0, which the text form tells from 0.0."""
    return F.startswith(x.cast("string"), F.lit("-"))


def sincos(x: Column) -> Column:
    return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))
