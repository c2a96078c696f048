"""Monitors of a run: what ``integrate.run`` calls at its start, before and after steps, and at its end."""

from __future__ import annotations

import sys
import time as clock
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from ..streaming.triggers import Trigger, always
from . import files, snapshots


class Monitor:
    """The life of a monitor; only ``record`` must be there."""

    def __init__(self, trigger: Trigger | None = None):
        self.trigger = trigger or always()

    def init(self, dt: float, start: float, end: float, first: int, steps: int) -> None:
        self.dt, self.start, self.end, self.first, self.steps = dt, start, end, first, steps

    def before_step(self, system) -> None:
        pass

    def record(self, system) -> None:
        raise NotImplementedError

    def finalize(self) -> None:
        pass


class ParquetOutput(Monitor):
    """Frames as partitions of one Parquet folder; the sink for large tables."""

    def __init__(self, trigger: Trigger, folder: str):
        super().__init__(trigger)
        self.folder = folder

    def record(self, system) -> None:
        files.write_parquet(system.df, self.folder, system.step, system.time)


class BinaryOutput(Monitor):
    """A folder of binary parts a frame."""

    def __init__(self, trigger: Trigger, folder: str, base: str):
        super().__init__(trigger)
        self.folder, self.base = folder, base

    def record(self, system) -> None:
        snapshots.write_snapshot(system.df, f"{self.folder}/{self.base}_{system.step:05}.bin", system.step)


class XYZOutput(Monitor):
    """A folder of text parts a frame; a frame that is there already is written anew."""

    def __init__(self, trigger: Trigger, folder: str):
        super().__init__(trigger)
        self.folder = folder

    def record(self, system) -> None:
        files.write_xyz(system.df, self.folder, system.step, system.time)


class VTPOutput(Monitor):
    """A frame of pieces each time, and at the end the collection that names them with their times."""

    def __init__(self, trigger: Trigger, folder: str, base: str, fields: tuple[str, ...] = ("velocity", "force", "type", "id")):
        super().__init__(trigger)
        self.folder, self.base, self.fields, self.frames = folder, base, fields, []

    def record(self, system) -> None:
        self.frames.append((system.time, files.write_vtp(system.df, self.folder, self.base, system.step, self.fields)))

    def finalize(self) -> None:
        files.write_pvd(self.folder, self.base, self.frames)


class TerminalOutput(Monitor):
    """Prints the particles by id, as many as ``rows``."""

    def __init__(self, trigger: Trigger, rows: int = 20, out=None):
        super().__init__(trigger)
        self.rows, self.out = rows, out or sys.stdout

    def record(self, system) -> None:
        print(f"step {system.step}, time {system.time:g}", file=self.out)
        for r in system.df.orderBy("id").limit(self.rows).collect():
            print(", ".join(f"{k}={v}" for k, v in r.asDict().items()), file=self.out)


class ProgressBar(Monitor):
    WIDTH = 50

    def __init__(self, trigger: Trigger | None = None, out=None):
        super().__init__(trigger)
        self.out = out or sys.stderr

    def record(self, system) -> None:
        done = (system.step - self.first) / max(self.steps, 1)
        print(f"\r[{'=' * int(done * self.WIDTH):<{self.WIDTH}}] {100 * done:3.0f} %", end="", file=self.out, flush=True)

    def finalize(self) -> None:
        print(file=self.out)


@dataclass
class Timing:
    """Seconds by step, and what they say; mups: millions of particle updates per second of stepping."""

    seconds: list[float] = field(default_factory=list)
    updates: int = 0
    wall: float = 0.0

    def summary(self) -> dict[str, float]:
        s = sorted(self.seconds)
        if not s:
            return {"steps": 0}
        return {"steps": len(s), "wall": self.wall, "total": sum(s), "mean": fmean(s), "median": s[len(s) // 2], "min": s[0], "max": s[-1], "std_dev": pstdev(s), "steps_per_second": 1 / fmean(s), "mups": self.updates / sum(s) / 1e6}


class Benchmark(Monitor):
    """Times every step from before it until its rows stand in the checkpoint."""

    def __init__(self):
        super().__init__()
        self.result = Timing()

    def init(self, *clock_of_run) -> None:
        super().init(*clock_of_run)
        self.began = clock.perf_counter()

    def before_step(self, system) -> None:
        self.step_began = clock.perf_counter()

    def record(self, system) -> None:
        self.result.seconds.append(clock.perf_counter() - self.step_began)
        self.result.updates += system.df.count()

    def finalize(self) -> None:
        self.result.wall = clock.perf_counter() - self.began
