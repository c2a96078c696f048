"""Kernels over single particles: masked maps, read-only views, folds and access by id.

A kernel names the columns it reads and writes; it gets only those and may give only these, so what it touches is known
before it runs. All are Column expressions and stay in generated code; rows outside the state mask keep their values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import cut, ship
from .forces import ALL, ALIVE, in_state


@dataclass(frozen=True)
class Kernel:
    """``body`` maps the read columns (name to Column) to new values of written ones."""

    reads: tuple[str, ...]
    writes: tuple[str, ...]
    body: Callable[[dict[str, Column]], dict[str, Column]]

    def __call__(self, df: DataFrame) -> dict[str, Column]:
        if missing := set(self.reads) - set(df.columns):
            raise ValueError(f"no such columns: {sorted(missing)}")
        out = self.body({c: F.col(c) for c in self.reads})
        if undeclared := set(out) - set(self.writes):
            raise ValueError(f"writes to undeclared columns: {sorted(undeclared)}")
        return out


def kernel(reads: Iterable[str], writes: Iterable[str] = ()) -> Callable:
    """Decorator: a function of a dict of Columns as a Kernel."""
    return lambda body: Kernel(tuple(reads), tuple(writes), body)


def for_each_particle(df: DataFrame, k: Kernel, state: int = ALL) -> DataFrame:
    """df with the kernel's columns changed where the row's state has a bit of the mask. All values read are those before."""
    on = in_state(state)
    return df.withColumns({c: F.when(on, v).otherwise(F.col(c)) if c in df.columns else F.when(on, v) for c, v in k(df).items()})


def for_each_particle_view(df: DataFrame, k: Kernel, state: int = ALL) -> DataFrame:
    """What a kernel that writes nothing computes, one row (id, ...) per particle of the mask."""
    if k.writes:
        raise ValueError("a view must not write")
    found = k.body({c: F.col(c) for c in k.reads})
    return df.filter(in_state(state)).select("id", *[v.alias(c) for c, v in found.items()])


#: Folds that Spark combines on each task before the shuffle.
FOLDS = {"plus": F.sum, "min": F.min, "max": F.max, "any": F.bool_or, "all": F.bool_and, "product": F.product}


def reduce(df: DataFrame, value: Column | str, fold: str | Callable[[Column], Column] = "plus", initial: float | None = None, state: int = ALIVE) -> DataFrame:
    """One row ``value``: the fold over the particles of the mask; ``initial`` for none, and combined with the result of a named fold."""
    one = F.expr(value) if isinstance(value, str) else value
    total = (FOLDS[fold] if isinstance(fold, str) else fold)(one)
    if initial is not None:
        first = F.lit(initial)
        joined = {"plus": lambda t: t + first, "product": lambda t: t * first, "min": lambda t: F.least(t, first), "max": lambda t: F.greatest(t, first)}.get(fold if isinstance(fold, str) else "", lambda t: t)
        total = F.coalesce(joined(total), first)
    return df.filter(in_state(state)).agg(total.alias("value"))


def flags(df: DataFrame, tests: dict[str, tuple[str, str]], state: int = ALIVE) -> DataFrame:
    """One row: by name, whether any, all or none of the particles of the mask pass a test."""
    folds = {"any": F.bool_or, "all": F.bool_and, "none": lambda c: ~F.bool_or(c)}
    return df.filter(in_state(state)).agg(*[folds[kind](F.expr(test)).alias(name) for name, (kind, test) in tests.items()])


@dataclass(frozen=True)
class Reducer:
    """A fold of one's own. ``step`` takes a state and an Arrow batch of the columns that it reads; ``merge`` takes two states and
    must be associative and commutative, with ``initial`` changing nothing. A state is a tuple of what ``schema`` says."""

    reads: tuple[str, ...]
    schema: str
    initial: tuple
    step: Callable[[tuple, pa.RecordBatch], tuple]
    merge: Callable[[tuple, tuple], tuple]


#: States that a task merges.
FAN = 64


def reduce_with(df: DataFrame, r: Reducer, state: int = ALIVE, fan: int = FAN) -> DataFrame:
    """One row: the state over the particles of the mask. Each task folds its own rows batch by batch and leaves one state; states are
    merged ``fan`` at a time until one is left, so no row of a particle is shuffled and no task sees more than ``fan`` states."""
    if fan < 2:
        raise ValueError("a merge takes two states at least")
    spark = df.sparkSession
    fields = StructType.fromDDL(r.schema).fields
    names, arrow = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def row(of: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(of, arrow, strict=True)], names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = r.initial
        for batch in batches:
            now = r.step(now, batch) if batch.num_rows else now
        yield row(now)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = r.initial
        for batch in batches:
            for other in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                now = r.merge(now, other)
        yield row(now)

    ship(spark)
    states = cut(df.filter(in_state(state)).select(*r.reads).mapInArrow(fold, r.schema))
    n = states.count()
    if not n:
        return spark.createDataFrame([r.initial], r.schema)
    while n > 1:
        n = ceil(n / fan)
        states = cut((states.repartition(n) if n > 1 else states.coalesce(1)).mapInArrow(merge, r.schema))
    return states


def size(df: DataFrame, state: int = ALL) -> DataFrame:
    """One row n: the particles of the mask."""
    return df.filter(in_state(state)).agg(F.count("*").alias("n"))


def id_range(df: DataFrame) -> DataFrame:
    """One row min_id, max_id; max_id is exclusive."""
    return df.agg(F.min("id").alias("min_id"), (F.max("id") + 1).alias("max_id"))


def view_id(df: DataFrame, id_: int) -> Row:
    """The particle of an id."""
    found = df.filter(F.col("id") == id_).first()
    if found is None:
        raise KeyError(id_)
    return found


def at_id(df: DataFrame, id_: int, **values: float) -> DataFrame:
    """df with columns of one particle set."""
    return df.withColumns({c: F.when(F.col("id") == id_, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
