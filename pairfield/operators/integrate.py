"""Time steps: velocity Verlet and the fourth-order Yoshida composition, with a run loop and triggered monitors."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from ..session import cut
from ..streaming.triggers import Moment, Trigger
from . import boundaries as B
from . import kernels
from .forces import ALIVE, ALL, drift, half_kick, inside

#: The weights of the three sub-steps.
YOSHIDA = (1.3512071919596578, -1.7024143839193153, 1.3512071919596578)


@dataclass(frozen=True)
class Context:
    """What a component gets to see of a system: the clock, the box and the particles, to read and not to change."""

    df: DataFrame
    time: float
    step: int
    low: dict = field(default_factory=dict)
    high: dict = field(default_factory=dict)

    def size(self, state: int = ALL) -> int:
        return kernels.size(self.df, state).first()["n"]

    def id_range(self) -> tuple[int, int]:
        """Least id, and one more than the largest."""
        row = kernels.id_range(self.df).first()
        return row["min_id"], row["max_id"]

    def at_id(self, id_: int) -> Row:
        return kernels.view_id(self.df, id_)

    def region(self, low, high) -> DataFrame:
        """The living particles of a closed box."""
        return self.df.filter(inside(low, high))

    def reduce(self, value, fold="plus", initial: float | None = None, state: int = ALIVE):
        return kernels.reduce(self.df, value, fold, initial, state).first()["value"]


@dataclass
class System:
    """A particle table with its forces, and the clock."""

    df: DataFrame
    force: Callable[[DataFrame], DataFrame]
    walls: dict = field(default_factory=dict)
    low: dict = field(default_factory=dict)
    high: dict = field(default_factory=dict)
    fields: list[Callable[[DataFrame, float], DataFrame]] = field(default_factory=list)
    controllers: list[tuple[Trigger, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    time: float = 0.0
    step: int = 0
    #: Repulsive walls push after the pair forces of a step, which else would overwrite theirs.
    walls_push: bool = True

    def context(self) -> Context:
        return Context(self.df, self.time, self.step, dict(self.low), dict(self.high))

    def update_forces(self) -> None:
        self.df = self.force(self.df)

    def apply_boundary_conditions(self) -> None:
        if self.walls:
            self.df = B.apply(self.df, self.walls, self.low, self.high)

    def apply_walls(self) -> None:
        """Only the repulsive faces, over the forces as they stand."""
        push = {f: b for f, b in self.walls.items() if b.kind == "repulsive"}
        if push and self.walls_push:
            self.df = B.apply(self.df, push, self.low, self.high)

    def apply_force_fields(self) -> None:
        for f in self.fields:
            self.df = f(self.df, self.time)

    def apply_controllers(self) -> None:
        for trigger, c in self.controllers:
            if trigger(Moment(self.time, self.step)):
                self.df = c(self.df)

    def verlet(self, dt: float) -> None:
        self.df = cut(drift(half_kick(self.df, dt), dt))  # the pair join reads it twice
        self.apply_boundary_conditions()
        self.update_forces()
        self.apply_walls()
        self.apply_force_fields()
        self.df = half_kick(self.df, dt)
        self.apply_controllers()

    def yoshida(self, dt: float) -> None:
        for w in YOSHIDA:
            self.verlet(w * dt)


def steps_of(duration: float, dt: float) -> int:
    return int(duration / dt)


def run(system: System, dt: float, steps: int, method: str | Callable[[System, float], None] = "verlet", monitors: Iterable = ()) -> System:
    """Forces once without fields, then the steps; triggers are asked once per step, after the clock has moved.

    Monitors see the system as a ``Context``. A monitor is a pair (trigger, function) or an object with ``trigger``, ``record`` and perhaps ``init``,
    ``before_step`` and ``finalize``. ``method`` is a stage of the system or a function of one's own. A system that has run
    before goes on with its clock.
    """
    if dt <= 0:
        raise ValueError("dt must be positive")
    step = method if callable(method) else lambda s, h: getattr(s, method)(h)
    call = lambda m, name, *a: getattr(m, name, lambda *_: None)(*a)
    monitors = list(monitors)
    for m in monitors:
        call(m, "init", dt, system.time, system.time + dt * steps, system.step, steps)
    system.update_forces()
    for _ in range(steps):
        for m in monitors:
            call(m, "before_step", system.context())
        step(system, dt)
        system.df = cut(system.df)
        system.time, system.step = system.time + dt, system.step + 1
        for m in monitors:
            trigger, record = m if isinstance(m, tuple) else (m.trigger, m.record)
            if trigger(Moment(system.time, system.step)):
                record(system.context())
    for m in monitors:
        call(m, "finalize")
    return system


def run_for_duration(system: System, dt: float, duration: float, **more) -> System:
    return run(system, dt, steps_of(duration, dt), **more)
