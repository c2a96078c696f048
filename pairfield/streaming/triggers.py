"""Triggers over the clock, with and, or, not; all of them can also mark a table of (step, time) rows.

Most tests look at one moment and are a column. ``periodically`` depends on when it last fired, so over a table it is a chain:
each moment links to the first one a period later, and the moments on the chain from the first are found by pointer jumping,
in as many rounds as the number of firings has binary digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Moment:
    time: float
    step: int


class Trigger:
    def __init__(self, test: Callable[[Moment], bool], column: Column | Callable[[], Column] | None = None, over: Callable[[DataFrame], tuple[DataFrame, Column]] | None = None):
        self.test, self._column, self._over = test, column, over

    def __call__(self, m: Moment) -> bool:
        return bool(self.test(m))

    def column(self) -> Column:
        """The same test over columns step and time."""
        if self._column is None:
            raise TypeError("this trigger depends on other moments than the row's own; use mark()")
        return self._column()

    def over(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """df, perhaps with further columns, and the test as a column of it."""
        return self._over(df) if self._over else (df, self.column())

    def mark(self, df: DataFrame, name: str = "fires") -> DataFrame:
        """A table of moments (step, time) with a boolean column: whether the trigger fires, if it is asked at all of them in order."""
        out, test = self.over(df)
        return out.select(*df.columns, test.alias(name))

    def _with(self, o: Trigger, test: Callable[[Moment], bool], both: Callable[[Column, Column], Column]) -> Trigger:
        def over(df: DataFrame) -> tuple[DataFrame, Column]:
            df, a = self.over(df)
            df, b = o.over(df)
            return df, both(a, b)

        stateless = self._column is not None and o._column is not None
        return Trigger(test, (lambda: both(self.column(), o.column())) if stateless else None, over)

    def __and__(self, o: Trigger) -> Trigger:
        return self._with(o, lambda m: self(m) and o(m), lambda a, b: a & b)

    def __or__(self, o: Trigger) -> Trigger:
        return self._with(o, lambda m: self(m) or o(m), lambda a, b: a | b)

    def __invert__(self) -> Trigger:
        def over(df: DataFrame) -> tuple[DataFrame, Column]:
            df, a = self.over(df)
            return df, ~a

        return Trigger(lambda m: not self(m), (lambda: ~self.column()) if self._column is not None else None, over)


def every(n: int, offset: int = 0) -> Trigger:
    if n == 0:
        raise ValueError("n must not be 0")
    return Trigger(lambda m: (m.step + offset) % n == 0, lambda: (F.col("step") + offset) % n == 0)


def after(step: int) -> Trigger:
    return Trigger(lambda m: m.step >= step, lambda: F.col("step") >= step)


def between(start: int, end: int) -> Trigger:
    return Trigger(lambda m: start <= m.step < end, lambda: (F.col("step") >= start) & (F.col("step") < end))


def at_step(step: int) -> Trigger:
    return Trigger(lambda m: m.step == step, lambda: F.col("step") == step)


def after_time(t: float) -> Trigger:
    return Trigger(lambda m: m.time >= t, lambda: F.col("time") >= t)


def between_time(a: float, b: float) -> Trigger:
    return Trigger(lambda m: a <= m.time < b, lambda: (F.col("time") >= a) & (F.col("time") < b))


def always() -> Trigger:
    return Trigger(lambda m: True, lambda: F.lit(True))


def never() -> Trigger:
    return Trigger(lambda m: False, lambda: F.lit(False))


def when(test: Callable[[Moment], bool]) -> Trigger:
    return Trigger(test)


#: Points of a level of ``following`` that stand for one point of the next.
STEP = 1024


def following(points: DataFrame, width: float, distance: float) -> DataFrame:
    """(time, next): for each of the distinct times, the first that comes ``distance`` or more later; null for none.

    Times and what is looked for meet in buckets of a width, in a window by time. What finds nothing in its bucket looks among the first
    times of all buckets, in buckets ``STEP`` times as wide, and so on until one bucket holds everything.
    """
    points = cut(points.select("time").distinct())
    wanted, found = points.select("time", (F.col("time") + F.lit(float(distance))).alias("at")), None
    while True:
        bucket = lambda c, w=width: F.floor(F.col(c) / F.lit(float(w)))
        both = points.select(bucket("time").alias("bucket"), F.col("time").alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast("double").alias("time"))
        both = both.unionByName(wanted.select(bucket("at").alias("bucket"), "at", F.lit(0).alias("is_point"), "time"))
        # from the latest on: the last point that has gone by is the first that follows
        back = Window.partitionBy("bucket").orderBy(F.desc("at"), F.desc("is_point")).rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("next", F.last(F.when(F.col("is_point") == 1, F.col("at")), ignorenulls=True).over(back)).filter("is_point = 0").select("time", "at", "next")
        got = cut(got)
        hits = got.filter("next IS NOT NULL").select("time", "next")
        found = hits if found is None else found.unionByName(hits)
        wanted = got.filter("next IS NULL").select("time", "at")
        buckets = points.select(bucket("time").alias("bucket")).distinct().limit(2).count()
        if buckets < 2 or wanted.isEmpty():
            return found.unionByName(wanted.select("time", F.lit(None).cast("double").alias("next")))
        points = cut(points.groupBy(bucket("time").alias("bucket")).agg(F.min("time").alias("time")).select("time"))
        width *= STEP


def firings(moments: DataFrame, period: float, offset: float = 0.0) -> DataFrame:
    """The times at which ``periodically`` fires: the first at the offset or later, then each first a period or more after the last."""
    links = cut(following(moments, period, period).filter("next IS NOT NULL"))
    reached = cut(moments.filter(F.col("time") >= F.lit(float(offset))).agg(F.min("time").alias("time")).filter("time IS NOT NULL"))
    while True:
        onward = reached.join(links, "time").select(F.col("next").alias("time"))
        after = cut(reached.unionByName(onward).distinct())
        if after.count() == reached.count():
            return after
        reached = after
        links = cut(links.join(links.select(F.col("time").alias("next"), F.col("next").alias("far")), "next").select("time", F.col("far").alias("next")))


def periodically(period: float, offset: float = 0.0) -> Trigger:
    """Fires once ``period`` has passed since it last fired; asked once per step. Over a table the test is time >= last + period, and of
    several steps of one time the first fires."""
    if period <= 0:
        raise ValueError("the period must be positive")
    last = [offset - period]

    def test(m: Moment) -> bool:
        if m.time - last[0] >= period:
            last[0] = m.time
            return True
        return False

    def over(df: DataFrame) -> tuple[DataFrame, Column]:
        name = f"__fires_{len(df.columns)}"
        moments = df.groupBy(F.col("time").cast("double").alias("time")).agg(F.min("step").alias("step"))
        fired = moments.join(firings(moments.select("time"), period, offset), "time").select(F.col("time").alias("__time"), F.col("step").alias("__step"), F.lit(True).alias(name))
        out = df.join(fired, (F.col("time").cast("double") == F.col("__time")) & (F.col("step") == F.col("__step")), "left").drop("__time", "__step")
        return out, F.coalesce(F.col(name), F.lit(False))

    return Trigger(test, None, over)
