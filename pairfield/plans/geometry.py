"""Boxes and domains: plain values on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spec import SpecError

Triple = tuple[float, float, float]


@dataclass(frozen=True)
class Box:
    """Closed on both ends."""

    low: Triple
    high: Triple

    @classmethod
    def from_domain(cls, domain: Domain) -> Box:
        if domain.origin is None or domain.extent is None:
            raise SpecError("the domain is not complete")
        return cls(domain.min_corner(), domain.max_corner())

    @property
    def extent(self) -> Triple:
        return tuple(h - a for a, h in zip(self.low, self.high, strict=True))

    def volume(self) -> float:
        return prod(self.extent)

    def contains(self, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
        test = F.lit(True)
        for c, a, h in zip((x, y, z), self.low, self.high, strict=True):
            test = test & (F.col(c) if isinstance(c, str) else c).between(float(a), float(h))
        return test

    def intersection(self, other: Box) -> Box | None:
        """What both hold; touching boxes share a face, disjoint ones nothing."""
        low = tuple(map(max, self.low, other.low))
        high = tuple(map(min, self.high, other.high))
        return None if any(a > h for a, h in zip(low, high, strict=True)) else Box(low, high)


@dataclass(frozen=True)
class Domain:
    """An origin and an extent, either of which may be left open; negative extents count backwards."""

    origin: Triple | None = None
    extent: Triple | None = None

    @classmethod
    def from_center_and_size(cls, center: Triple, size: Triple) -> Domain:
        return cls(tuple(c - s / 2 for c, s in zip(center, size, strict=True)), tuple(size))

    @classmethod
    def from_min_max(cls, low: Triple, high: Triple) -> Domain:
        return cls(tuple(low), tuple(h - a for a, h in zip(low, high, strict=True)))

    def _corners(self) -> list[tuple[float, float]]:
        if self.origin is None or self.extent is None:
            raise SpecError("the domain is not complete")
        return [tuple(sorted((o, o + e))) for o, e in zip(self.origin, self.extent, strict=True)]

    def min_corner(self) -> Triple:
        return tuple(a for a, _ in self._corners())

    def max_corner(self) -> Triple:
        return tuple(h for _, h in self._corners())

    def volume(self) -> float:
        return prod(h - a for a, h in self._corners())
