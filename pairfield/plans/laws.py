"""Pair laws: the force on the first of two particles, r pointing from the first to the second.

A law is a small immutable value. Central laws give ``scale``: one SQL expression over r2 (squared distance, never 0) and
the particles' columns with suffixes _a and _b, so it stays inside generated code; the force is scale * r. Other laws give
``vector``, three expressions that may also use dx, dy and dz. ``symmetry`` says what the second particle gets: the
opposite (antisymmetric), the same (symmetric), or what the law says with both exchanged (nonsymmetric).

A law names in ``fields`` the particles' columns that it reads beside id, type and position: attributes of the user's own
as well as masses, charges or velocities. Pair joins carry exactly the fields of the laws that they serve, and what a law
reads without naming it, or what a table does not have, is an error before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from math import sqrt

NO_CUTOFF = 1.0e150


#: What every pair carries.
PLACE = ("id", "type", "x", "y", "z")


class MixingError(ValueError):
    """Two laws that have no rule for a mixed pair."""


class FieldError(ValueError):
    """A law reads a column that it does not name, or names one that the particles do not have."""


@dataclass(frozen=True)
class Law:
    cutoff: float | None = None

    #: Class attributes, not parameters: what the second particle gets, and whether particles in one place interact.
    symmetry = "antisymmetric"
    central = True
    at_zero = False
    #: The particles' columns that the law reads beside ``PLACE``.
    fields = ()
    #: The one column whose product over both particles is a factor of the scale, which else depends on r2 alone; None where it is not so.
    product = None

    @property
    def smooth(self) -> float | None:
        """The scale is analytic in r2 but for r2 <= -smooth^2; None where that is not known."""
        return None

    @property
    def reach(self) -> float:
        return NO_CUTOFF if self.cutoff is None else self.cutoff

    def scale(self) -> str:
        raise NotImplementedError

    def vector(self) -> tuple[str, str, str]:
        return tuple(f"({self.scale()} * d{a})" for a in "xyz")

    def energy(self) -> str | None:
        return None

    def with_cutoff(self, cutoff: float) -> Law:
        return replace(self, cutoff=cutoff)

    def mix(self, other: Law) -> Law:
        if type(self) is not type(other):
            raise MixingError(f"{type(self).__name__} and {type(other).__name__}")
        return self._mixed(other)

    def _mixed(self, other: Law) -> Law:
        if self != other:
            raise MixingError("different parameters")
        return self

    def _longer(self, other: Law) -> float | None:
        return None if None in (self.cutoff, other.cutoff) else max(self.cutoff, other.cutoff)


@dataclass(frozen=True)
class NoForce(Law):
    cutoff: float | None = 0.0

    def scale(self) -> str:
        return "0e0"

    def _mixed(self, other: Law) -> Law:
        return NoForce()


@dataclass(frozen=True)
class Gravity(Law):
    g: float = 1.0
    fields = ("mass",)

    def scale(self) -> str:
        return f"({self.g!r}e0 * mass_a * mass_b / (r2 * sqrt(r2)))"

    def _mixed(self, other: Gravity) -> Law:
        if abs(self.g - other.g) > 1e-9:
            raise MixingError("gravitational constants differ")
        return Gravity(self._longer(other), self.g)


@dataclass(frozen=True)
class Coulomb(Law):
    k: float = 1.0
    fields = ("charge",)

    def scale(self) -> str:
        return f"({self.k!r}e0 * charge_a * charge_b / (r2 * sqrt(r2)))"

    def _mixed(self, other: Coulomb) -> Law:
        if abs(self.k - other.k) > 1e-9:
            raise MixingError("Coulomb constants differ")
        return Coulomb(self._longer(other), self.k)


@dataclass(frozen=True)
class Harmonic(Law):
    k: float = 1.0
    r0: float = 0.0

    def scale(self) -> str:
        return f"({self.k!r}e0 * (sqrt(r2) - {self.r0!r}e0) / sqrt(r2))"

    def _mixed(self, other: Harmonic) -> Law:
        return Harmonic(self._longer(other), 2 * self.k * other.k / (self.k + other.k), (self.r0 + other.r0) / 2)


@dataclass(frozen=True)
class LennardJones(Law):
    epsilon: float = 1.0
    sigma: float = 1.0

    @property
    def reach(self) -> float:
        return 3 * self.sigma if self.cutoff is None or self.cutoff < 0 else self.cutoff

    def scale(self) -> str:
        s6 = self.sigma**6
        return f"(-({48 * self.epsilon * s6 * s6!r}e0 / (r2 * r2 * r2) - {24 * self.epsilon * s6!r}e0) / (r2 * r2 * r2 * r2))"

    def energy(self) -> str:
        s6 = self.sigma**6
        return f"({4 * self.epsilon * s6 * s6!r}e0 / (r2 * r2 * r2 * r2 * r2 * r2) - {4 * self.epsilon * s6!r}e0 / (r2 * r2 * r2))"

    def _mixed(self, other: LennardJones) -> Law:
        return LennardJones(sqrt(self.reach * other.reach), sqrt(self.epsilon * other.epsilon), (self.sigma + other.sigma) / 2)


@dataclass(frozen=True)
class SoftGravity(Law):
    g: float = 1.0
    soft: float = 0.1
    fields = ("mass",)
    product = "mass"

    @property
    def smooth(self) -> float:
        return abs(self.soft)

    def scale(self) -> str:
        q = f"(r2 + {self.soft * self.soft!r}e0)"
        return f"(-{self.g!r}e0 * mass_a * mass_b / ({q} * sqrt({q})))"


@dataclass(frozen=True)
class Constant(Law):
    """The same force on every first particle (of two, the one of the lower type, then of the lower id)."""

    force: tuple[float, float, float] = (0.0, 0.0, 0.0)
    central = False
    at_zero = True

    def vector(self) -> tuple[str, str, str]:
        return tuple(f"{float(f)!r}e0" for f in self.force)

    def _mixed(self, other: Constant) -> Law:
        return replace(self, cutoff=self._longer(other), force=tuple(x + y for x, y in zip(self.force, other.force, strict=True)))


@dataclass(frozen=True)
class SymmetricConstant(Constant):
    """A constant force that both particles get alike."""

    symmetry = "symmetric"


@dataclass(frozen=True)
class Drag(Law):
    """Pulls on the difference of two velocities, as much as the pair is near."""

    gamma: float = 1.0
    central = False
    fields = ("vx", "vy", "vz")

    def vector(self) -> tuple[str, str, str]:
        near = "1e0" if self.cutoff is None else f"(1e0 - sqrt(r2) / {float(self.cutoff)!r}e0)"
        return tuple(f"({float(self.gamma)!r}e0 * {near} * (v{a}_b - v{a}_a))" for a in "xyz")

    def _mixed(self, other: Drag) -> Law:
        return Drag(self._longer(other), sqrt(self.gamma * other.gamma))


@dataclass(frozen=True)
class Custom(Law):
    """Any SQL over the pair: three components, how the second particle takes part, and the fields that it reads."""

    parts: tuple[str, str, str] = ("0e0", "0e0", "0e0")
    kind: str = "antisymmetric"
    reads: tuple[str, ...] = ()
    central = False

    @property
    def symmetry(self) -> str:
        return self.kind

    @property
    def fields(self) -> tuple[str, ...]:
        return self.reads

    def vector(self) -> tuple[str, str, str]:
        return self.parts


def columns_of(laws: Iterable[Law], have: Iterable[str]) -> tuple[str, ...]:
    """The columns that pairs of these laws carry; raises for fields that a law does not name or that ``have`` lacks."""
    have, out = set(have), dict.fromkeys(PLACE)
    for law in laws:
        if isinstance(law, NoForce):
            continue
        text = " ".join(law.vector())
        unnamed = {m for m in re.findall(r"\b([A-Za-z_]\w*)_[ab]\b", text)} - set(PLACE) - set(law.fields)
        if unnamed:
            raise FieldError(f"{type(law).__name__} reads {sorted(unnamed)} without naming them")
        if missing := set(law.fields) - have:
            raise FieldError(f"{type(law).__name__} reads {sorted(missing)}, which the particles do not have")
        out |= dict.fromkeys(law.fields)
    return tuple(out)


def law_table(given: dict[tuple[int, int], Law], types: list[int]) -> dict[tuple[int, int], Law]:
    """A law for each unordered type pair: given ones, else mixed from the two self-interactions."""
    known = {tuple(sorted(k)): v for k, v in given.items()}
    if len(known) != len(given):
        raise ValueError("a type pair is given twice")
    for t in types:
        if (t, t) not in known:
            raise ValueError(f"type {t} has no self-interaction")
    for t in {t for k in known for t in k} - set(types):
        raise ValueError(f"unknown type {t}")
    return {(a, b): known.get((a, b)) or known[a, a].mix(known[b, b]) for a in types for b in types if a <= b}


def distinct_laws(table: dict[tuple[int, int], Law]) -> dict[Law, list[tuple[int, int]]]:
    """Equal laws as one, with the pairs that use them."""
    out: dict[Law, list[tuple[int, int]]] = {}
    for pair, law in table.items():
        out.setdefault(law, []).append(pair)
    return out


def of_types(pairs: list[tuple[int, int]]) -> str:
    return " OR ".join(f"(type_a = {a} AND type_b = {b})" + ("" if a == b else f" OR (type_a = {b} AND type_b = {a})") for a, b in pairs)


def active(table: dict[tuple[int, int], Law]) -> dict[tuple[int, int], Law]:
    return {pair: law for pair, law in table.items() if not isinstance(law, NoForce)}


def within(law: Law) -> str:
    """A condition on r2, if the law has a cutoff."""
    return "" if law.reach > 1e100 else f" AND r2 <= {law.reach * law.reach!r}e0"


def scale_by_type(table: dict[tuple[int, int], Law]) -> str:
    """One SQL expression for central laws: the pair's law by its types, 0 beyond that law's cutoff. Equal laws share a branch."""
    cases = [f"WHEN ({of_types(pairs)}){within(law)} THEN {law.scale()}" for law, pairs in distinct_laws(active(table)).items()]
    return f"(CASE {' '.join(cases)} ELSE 0e0 END)" if cases else "0e0"
