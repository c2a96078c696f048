"""Sums of central forces of finite reach where places are dense, without making the pairs.

Cells by counts (``leaves``) are looked at as a tree. Two cells that are apart are left out; two that have many rows meet through
nodes where the law is smooth over them: the rows' weights go to a Chebyshev lattice in each cell, the lattices meet, and the
rows read their force from it. That gives all pairs of both; those beyond the reach are taken off again row by row, from leaves
that are not within it as wholes. The lattices are as fine as the law's nearest singular place asks for, so what they give is
the sum of the pairs up to about ``TOLERANCE``, which is what rounding leaves of a long sum. All else is split down to leaves,
which meet row by row as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.laws import Law
from ..session import cut, ship
from .pairs import AXES, CELL_ROWS, HALVINGS, _met_by, half_stencil, leaves
from .tiles import FUNCTIONS, OTHERS, ROWS, over_arrays

#: What the lattices may leave out, as a part of a law's values, and the most nodes along an axis.
TOLERANCE, MOST_NODES = 1e-13, 64
#: Pairs of leaves above which cells are split in any case.
MOST_LEAVES = 1 << 23


@dataclass(frozen=True)
class Costs:
    """What a pair of nodes, and a row's way to or from a node, cost in pairs of rows, and the pairs of rows up to which cells do not meet
    by nodes; nodes of a lattice that go to a task at once, and leaves whose rows are taken to or from a lattice in one task."""

    node: float = 0.4
    move: float = 0.025
    few: int = 1 << 20
    chunk: int = 4096
    leaves: int = 64


COSTS = Costs()

_MEETINGS = "a long, b long, beyond boolean, rep_a string, rep_b string, p_a array<int>, p_b array<int>, low_a array<double>, low_b array<double>, high_a array<double>, high_b array<double>, leaves_a array<long>, leaves_b array<long>, ox double, oy double, oz double, pairs double"
_D = pa.list_(pa.float64())
_MEETINGS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("beyond", pa.bool_()), ("rep_a", pa.string()), ("rep_b", pa.string()), ("p_a", pa.list_(pa.int32())), ("p_b", pa.list_(pa.int32())), *[(c, _D) for c in ("low_a", "low_b", "high_a", "high_b")], ("leaves_a", pa.list_(pa.int64())), ("leaves_b", pa.list_(pa.int64())), *[(f"o{a}", pa.float64()) for a in "xyz"], ("pairs", pa.float64())])


class _Cell:
    """A cell of the tree: its leaves, bounds and number of rows."""

    def __init__(self, at: dict[str, np.ndarray], own: np.ndarray, level: int):
        self.at, self.own, self.level = at, own, level
        self.n = float(at["n"][own].sum())
        self.low, self.high = at["low"][own].min(axis=0), at["high"][own].max(axis=0)
        self.finite = bool(np.isfinite(at["weight"][own]).all())
        # cells of one level that hold leaves of that level are not split any further
        self.last = bool(at["level"][own[0]] == level)
        self._parts = None

    @property
    def name(self) -> str:
        first = self.own[0]
        return f"{self.level}:" + ":".join(str(int(k) >> int(self.at["level"][first] - self.level)) for k in self.at["key"][first])

    def parts(self) -> list[_Cell]:
        if self._parts is None:
            shift = (self.at["level"][self.own] - self.level - 1)[:, None]
            _, of = np.unique(self.at["key"][self.own] >> shift, axis=0, return_inverse=True)
            of = of.ravel()
            self._parts = [_Cell(self.at, self.own[of == i], self.level + 1) for i in range(of.max() + 1)]
        return self._parts


def nodes(half: float, away: float, beside: float) -> int:
    """How many nodes an axis needs over [-half, half] for a function that is singular from ``away`` + ``beside`` i on."""
    if half == 0:
        return 1
    u, v = away / half, beside / half
    a = (sqrt((u - 1) ** 2 + v * v) + sqrt((u + 1) ** 2 + v * v)) / 2
    grows = log(a + sqrt(max(a * a - 1, 0.0)))
    if grows * MOST_NODES < log(1 / TOLERANCE):
        return MOST_NODES + 1
    return 2 * ceil((log(1 / TOLERANCE) / grows + 1) / 2)


def _orders(a: _Cell, b: _Cell, o: np.ndarray, smooth: float) -> tuple[list[int], list[int]]:
    """Nodes by axis for a and b: as a function of one coordinate of one of two rows, the law is singular where r2 = -smooth^2."""
    low, high = b.low + o, b.high + o
    gap = np.maximum(0.0, np.maximum(low - a.high, a.low - high))
    half_a, half_b = (a.high - a.low) / 2, (high - low) / 2
    middle = np.abs((low + high) / 2 - (a.low + a.high) / 2)
    out: tuple[list[int], list[int]] = ([], [])
    for x in range(3):
        beside = sqrt(smooth * smooth + sum(float(gap[y]) ** 2 for y in range(3) if y != x))
        for p, own, other in ((out[0], half_a, half_b), (out[1], half_b, half_a)):
            p.append(nodes(float(own[x]), max(0.0, float(middle[x] - other[x])), beside))
    return out


def _beyond(a: _Cell, b: _Cell, same: bool, o: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of a and of b, pair by pair, of which not all rows are surely within the cutoff."""
    span = 0.0
    for x in range(3):
        low_a, high_a, low_b, high_b = a.at["low"][a.own, x], a.at["high"][a.own, x], b.at["low"][b.own, x] + o[x], b.at["high"][b.own, x] + o[x]
        span = span + np.maximum(high_b[None, :] - low_a[:, None], high_a[:, None] - low_b[None, :]) ** 2
    some = ~(span <= cutoff * cutoff * (1 - 1e-9))
    return np.nonzero(np.triu(some) if same else some)


def _way(a: _Cell, b: _Cell, same: bool, o: np.ndarray, cutoff: float, smooth: float | None, costs: Costs) -> tuple[float, tuple | None]:
    """What it costs that two cells meet, in pairs of rows, and how: (nodes of a, nodes of b, leaves that are then taken off), or None
    where rows meet as they are."""
    gap = np.maximum(0.0, np.maximum(b.low + o - a.high, a.low - b.high - o))
    if (gap * gap).sum() > cutoff * cutoff * (1 + 1e-9):
        return 0.0, None
    rows = a.n * b.n / (2 if same else 1)
    if smooth is None or not (a.finite and b.finite) or a.n * b.n <= costs.few or len(a.own) * len(b.own) > MOST_LEAVES:
        return rows, None
    p, q = _orders(a, b, o, smooth)
    if max(*p, *q) > MOST_NODES:
        return rows, None
    m, n = float(np.prod(p)), float(np.prod(q))
    cost = costs.node * m * n / (2 if same else 1) + costs.move * (m * a.n + (0 if same else n * b.n))
    if cost >= rows:
        return rows, None
    off = _beyond(a, b, same, o, cutoff)
    cost += float((a.at["n"][a.own[off[0]]].astype(float) * b.at["n"][b.own[off[1]]]).sum())
    return (cost, (p, q, off)) if cost < rows else (rows, None)


def _met(a: _Cell, b: _Cell, same: bool, o: np.ndarray, cutoff: float, smooth: float | None, costs: Costs = COSTS) -> Iterator[tuple]:
    """Pairs of cells that together have each pair of rows within the cutoff once: (a, b, how they meet)."""
    stack = [(a, b, same)]
    while stack:
        a, b, same = stack.pop()
        cost, way = _way(a, b, same, o, cutoff, smooth, costs)
        if cost == 0:
            continue
        if a.last and b.last:
            yield a, b, way
            continue
        if same:
            parts = a.parts()
            split = [(x, y, x is y) for i, x in enumerate(parts) for y in parts[i:]]
        elif b.last or (not a.last and (a.high - a.low).max() >= (b.high - b.low).max()):
            split = [(x, b, False) for x in a.parts()]
        else:
            split = [(a, y, False) for y in b.parts()]
        if way is not None and cost <= sum(_way(*s, o, cutoff, smooth, costs)[0] for s in split):
            yield a, b, way
        else:
            stack += split


def _walk(cutoff: float, smooth: float | None, costs: Costs) -> Callable:
    """The function for ``mapInArrow``: pairs of coarse cells with their leaves in, what meets out."""

    def cell(rows: pa.StructArray) -> _Cell:
        at = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in rows.type.names}
        at |= {"key": np.stack([at[f"k{x}"] for x in AXES], axis=1), "low": np.stack([at[f"low_{x}"] for x in AXES], axis=1), "high": np.stack([at[f"high_{x}"] for x in AXES], axis=1)}
        return _Cell(at, np.arange(len(rows)), 0)

    def leaves_alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (batch.column(batch.schema.get_field_index(f"leaves_{s}")).flatten() for s in "ab")
        have = {"a": a.field("leaf"), "b": b.field("leaf"), "beyond": pa.array(np.zeros(len(a), bool)), **{f"o{x}": batch.column(batch.schema.get_field_index(f"o{x}")) for x in AXES}, "pairs": pc.cast(pc.multiply(a.field("n"), b.field("n")), pa.float64())}
        return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(len(a), f.type)) for f in _MEETINGS_ARROW], schema=_MEETINGS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # most coarse cells are a leaf each
            single = pc.and_(*[pc.equal(pc.list_value_length(batch.column(batch.schema.get_field_index(f"leaves_{s}"))), 1) for s in "ab"])
            yield leaves_alone(batch.filter(single))
            batch = batch.filter(pc.invert(single))
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            out: list[dict] = []
            for row in range(batch.num_rows):
                same = at["own"][row].as_py()
                a = cell(at["leaves_a"][row].values)
                b = a if same else cell(at["leaves_b"][row].values)
                carried = {f"o{x}": at[f"o{x}"][row].as_py() for x in AXES}
                o = np.array(list(carried.values()))
                for one, two, way in _met(a, b, same, o, cutoff, smooth, costs):
                    at_a, at_b = (np.indices((len(one.own), len(two.own))).reshape(2, -1)) if way is None else way[2]
                    if way is None and one is two:
                        at_a, at_b = np.triu_indices(len(one.own))
                    at_a, at_b = one.own[at_a], two.own[at_b]
                    made = one.at["n"][at_a].astype(float) * two.at["n"][at_b]
                    out += [{"a": x, "b": y, "beyond": way is not None, **carried, "pairs": n} for x, y, n in zip(one.at["leaf"][at_a].tolist(), two.at["leaf"][at_b].tolist(), made.tolist(), strict=True)]
                    if way is not None:
                        p, q, _ = way
                        sides = {f"{k}_{s}": v for s, c, n in (("a", one, p), ("b", two, q)) for k, v in (("rep", f"{c.name}|" + ":".join(map(str, n))), ("p", n), ("low", c.low.tolist()), ("high", c.high.tolist()), ("leaves", c.at["leaf"][c.own].tolist()))}
                        out.append({**sides, **carried, "pairs": float(np.prod(p)) * float(np.prod(q))})
                if len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, _MEETINGS_ARROW)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _MEETINGS_ARROW)

    return run


def meetings(tiles: DataFrame, cutoff: float, smooth: float | None, box: tuple[float | None, ...], costs: Costs = COSTS) -> DataFrame:
    """What meets: leaves a and b (``beyond``: only what is beyond the cutoff, to be taken off), or lattices rep_a and rep_b, how far b is carried around periodic axes, and how many ``pairs`` of rows or
    nodes that makes."""
    meta = tiles.select(*[f"c{a}" for a in AXES], F.struct("leaf", F.size("rows").cast("long").alias("n"), F.col("level").cast("long").alias("level"), *[F.col(f"k{a}").cast("long").alias(f"k{a}") for a in AXES], "weight", *[f"{m}{a}" for a in AXES for m in ("low_", "high_")]).alias("leaf"))
    cells = meta.groupBy(*[f"c{a}" for a in AXES]).agg(F.collect_list("leaf").alias("leaves"), *[f(f"leaf.{m}{a}").alias(f"{m}{a}") for a in AXES for m, f in (("low_", F.min), ("high_", F.max))])
    home = cells.select(*[f"c{a}" for a in AXES], F.col("leaves").alias("leaves_a"), *[F.col(f"{m}{a}").alias(f"{m}{a}_a") for a in AXES for m in ("low_", "high_")])
    offsets = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"o{a}") for o, a in zip(offset, AXES, strict=True)]) for offset in half_stencil(1)])
    visit = cells.select("*", F.explode(offsets).alias("o"))
    moved, carried = [], []
    for a, length in zip(AXES, box, strict=True):
        n = None if length is None else int(length // cutoff)
        to = F.col(f"c{a}") + F.col(f"o.o{a}")
        moved.append((to if n is None else F.pmod(to, F.lit(n))).alias(f"c{a}"))
        carried.append((F.lit(0.0) if n is None else F.lit(-float(length)) * F.floor(to / F.lit(n)).cast("double")).alias(f"o{a}"))
    own = (F.col("o.ox") == 0) & (F.col("o.oy") == 0) & (F.col("o.oz") == 0)
    visit = visit.select(F.col("leaves").alias("leaves_b"), own.alias("own"), *moved, *carried, *[F.col(f"{m}{a}").alias(f"{m}{a}_b") for a in AXES for m in ("low_", "high_")])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"low_{x}_b") + F.col(f"o{x}") - F.col(f"high_{x}_a"), F.col(f"low_{x}_a") - F.col(f"high_{x}_b") - F.col(f"o{x}")), 2) for x in AXES), F.lit(0.0))
    met = _met_by(home, visit, [f"c{a}" for a in AXES]).filter(gap <= cutoff * cutoff * (1 + 1e-9))
    return met.select("leaves_a", "leaves_b", "own", *[f"o{a}" for a in AXES]).mapInArrow(_walk(cutoff, smooth, costs), _MEETINGS)


def _scale(expression, r2, fields: dict):
    return eval(expression, {"__builtins__": {}, **FUNCTIONS}, {"r2": r2, **fields})  # noqa: S307  the tree has been checked


def _by_rows(text: str, cutoff: float, fields: tuple[str, ...]) -> Callable:
    """The function for ``mapInArrow``: pairs of leaves in, (id, fx, fy, fz) sums of both out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expression = compile(text, "law", "eval")
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for row in range(batch.num_rows):
                a, b = ({c: x.to_numpy(zero_copy_only=False) for c, x in zip(v.type.names, v.flatten(), strict=True)} for v in (at[c][row].values for c in ("rows_a", "rows_b")))
                o = [at[f"o{x}"][row].as_py() for x in AXES]
                same = at["a"][row].as_py() == at["b"][row].as_py()
                off = at["beyond"][row].as_py()
                fa, fb = (np.zeros((len(t["id"]), 3)) for t in (a, b))
                with np.errstate(all="ignore"):
                    for m in range(0, len(fb), OTHERS):
                        j = slice(m, m + OTHERS)
                        for k in range(0, len(fa), ROWS):
                            i = slice(k, k + ROWS)
                            d = [(b[f"i{x}"][j] + s)[None, :] - a[f"i{x}"][i][:, None] for x, s in zip(AXES, o, strict=True)]
                            r2 = d[0] * d[0]
                            r2 += d[1] * d[1]
                            r2 += d[2] * d[2]
                            on = r2 > cutoff * cutoff if off else (r2 > 0) & (r2 <= cutoff * cutoff)
                            if not on.any():
                                continue
                            scale = _scale(expression, r2, {f"{c}_a": a[c][i][:, None] for c in fields} | {f"{c}_b": b[c][j] for c in fields})
                            scale = np.where(on, -scale if off else scale, 0.0)
                            for n, x in enumerate(d):
                                x *= scale
                                fa[i, n] += x.sum(axis=1)
                                if not same:  # a leaf with itself meets each pair from both sides
                                    fb[j, n] -= x.sum(axis=0)
                for t, f in ((a, fa),) if same else ((a, fa), (b, fb)):
                    some = f.any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(t["id"][some], pa.int64()), *[pa.array(f[some, n]) for n in range(3)]], ["id", "fx", "fy", "fz"])

    return run


def _lattice(p: list[int], low: list[float], high: list[float]) -> list[np.ndarray]:
    """The nodes' places along each axis."""
    return [(u + v) / 2 + (v - u) / 2 * np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n)) for n, u, v in zip(p, low, high, strict=True)]


def _shares(x: np.ndarray, n: int, low: float, high: float) -> np.ndarray:
    """What each node of an axis is to each place: the polynomials that are 1 at one node and 0 at the others."""
    if n == 1:
        return np.ones((len(x), 1))
    t = np.arccos(np.clip((2 * x - low - high) / (high - low), -1.0, 1.0))
    k = np.arange(n)
    weights = np.cos(np.outer(k, (2 * k + 1) * np.pi / (2 * n))) * (np.where(k == 0, 1.0, 2.0) / n)[:, None]
    return np.cos(np.outer(t, k)) @ weights


def _first(table: pa.Table, column: str):
    return table.column(column)[0].as_py()


def _leaves_of(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    for chunk in table.column("rows").chunks:
        for rows in chunk:
            yield {c: v.to_numpy(zero_copy_only=False) for c, v in zip(rows.values.type.names, rows.values.flatten(), strict=True)}


def _ways(rows: dict[str, np.ndarray], p: list[int], low: list[float], high: list[float], smooth: float) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """What each node is to a leaf's rows, by axis: straight from the lattice, or (second part) by a lattice of the leaf's own where that is
    less work."""
    at = [rows[f"i{a}"] for a in AXES]
    own_low, own_high = [float(v.min()) for v in at], [float(v.max()) for v in at]
    q = [nodes((v - u) / 2, 0.0, smooth) for u, v in zip(own_low, own_high, strict=True)]
    n, m = len(at[0]), int(np.prod(p))
    if max(q) <= MOST_NODES and n * int(np.prod(q)) + q[0] * m < n * m:
        own = _lattice(q, own_low, own_high)
        return [_shares(x, k, u, v) for x, k, u, v in zip(at, q, own_low, own_high, strict=True)], [_shares(x, k, u, v) for x, k, u, v in zip(own, p, low, high, strict=True)]
    return [_shares(x, k, u, v) for x, k, u, v in zip(at, p, low, high, strict=True)], None


def _to_nodes(field: str, smooth: float, chunk: int) -> Callable:
    """For ``applyInArrow``: rows of a lattice's leaves in, their weights at the nodes out, chunk by chunk."""

    def run(table: pa.Table) -> pa.Table:
        p, low, high = (_first(table, c) for c in ("p", "low", "high"))
        total = np.zeros(p)
        for rows in _leaves_of(table):
            (x, y, z), own = _ways(rows, p, low, high, smooth)
            given = np.zeros((x.shape[1], y.shape[1] * z.shape[1]))
            for k in range(0, len(x), 512):
                i = slice(k, k + 512)
                given += (x[i] * rows[field][i][:, None]).T @ (y[i][:, :, None] * z[i][:, None, :]).reshape(len(x[i]), -1)
            if own is not None:
                given = np.matmul(np.matmul(own[1].T, (own[0].T @ given).reshape(p[0], y.shape[1], z.shape[1])), own[2])
            total += given.reshape(p)
        flat, step, rep = total.ravel(), _step(p, chunk), _first(table, "rep")
        chunks = range(0, len(flat), step)
        return pa.table({"rep": [rep] * len(chunks), "chunk": pa.array(range(len(chunks)), pa.int32()), "w": pa.array([flat[c : c + step] for c in chunks], _D)})

    return run


def _added(*columns: str) -> Callable:
    """For ``applyInArrow``: the sums of a chunk's arrays."""

    def run(table: pa.Table) -> pa.Table:
        sums = {c: np.sum([v.values.to_numpy() for v in table.column(c)], axis=0) for c in columns}
        return pa.table({"rep": [_first(table, "rep")], "chunk": pa.array([_first(table, "chunk")], pa.int32()), **{c: pa.array([v], _D) for c, v in sums.items()}})

    return run


def _step(p: list[int], chunk: int) -> int:
    """Nodes of a chunk: whole lines along z."""
    return max(1, chunk // p[2]) * p[2]


def _by_nodes(text: str, field: str, chunk: int) -> Callable:
    """The function for ``mapInArrow``: chunks of two lattices in, what each gives to the nodes of the other out."""

    def lines(p, low, high, n: int, o=(0.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places x and y of a chunk's lines, and z along all of them."""
        x, y, z = (v + s for v, s in zip(_lattice(p, low, high), o, strict=True))
        per = _step(p, chunk) // p[2]
        i, j = np.divmod(np.arange(n * per, min((n + 1) * per, p[0] * p[1])), p[1])
        return x[i], y[j], z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expression = compile(text, "law", "eval")
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for row in range(batch.num_rows):
                get = lambda c: at[c][row].as_py()  # noqa: E731, B023
                a = lines(get("p_a"), get("low_a"), get("high_a"), get("chunk_a"))
                b = lines(get("p_b"), get("low_b"), get("high_b"), get("chunk_b"), [get(f"o{x}") for x in AXES])
                same = get("rep_a") == get("rep_b") and get("chunk_a") == get("chunk_b")
                middle = [v.mean() for v in a]
                a, b = ([v - m for v, m in zip(s, middle, strict=True)] for s in (a, b))
                (na, nb), (ka, kb) = (len(a[2]), len(b[2])), (len(a[0]), len(b[0]))
                beside = (b[2][None, :] - a[2][:, None]) ** 2
                # sums of a weight and of its places, so that of a pair only the scale is made
                every = [np.stack([np.repeat(x, len(z)), np.repeat(y, len(z)), np.tile(z, len(x)), np.ones(len(x) * len(z))]) for x, y, z in (a, b)]
                wa, wb = ((at[w][row].values.to_numpy() * v).T for w, v in zip(("w_a", "w_b"), every, strict=True))
                fa, fb = np.zeros((ka * na, 4)), np.zeros((kb * nb, 4))
                step_a, step_b = max(1, ROWS // na), max(1, OTHERS // nb)
                with np.errstate(all="ignore"):
                    for k in range(0, ka, step_a):
                        i, ia = slice(k, k + step_a), slice(k * na, (k + step_a) * na)
                        across = sum((y[None, :] - x[i][:, None]) ** 2 for x, y in zip(a[:2], b[:2], strict=True))
                        for m in range(0, kb, step_b):
                            j = slice(m * nb, (m + step_b) * nb)
                            r2 = (across[:, None, m : m + step_b, None] + beside[None, :, None, :]).reshape(len(fa[ia]), len(fb[j]))
                            scale = _scale(expression, r2, {f"{field}_a": 1.0, f"{field}_b": 1.0})
                            fa[ia] += scale @ wb[j]
                            if not same:
                                fb[j] += scale.T @ wa[ia]
                for s, f, x in (("a", fa, every[0]),) if same else (("a", fa, every[0]), ("b", fb, every[1])):
                    g = f[:, :3] - f[:, 3:] * x[:3].T
                    yield pa.RecordBatch.from_arrays([pa.array([get(f"rep_{s}")]), pa.array([get(f"chunk_{s}")], pa.int32()), *[pa.array([g[:, n]], _D) for n in range(3)]], ["rep", "chunk", "gx", "gy", "gz"])

    return run


def _from_nodes(field: str, smooth: float) -> Callable:
    """For a cogrouped ``applyInArrow``: rows of a lattice's leaves and what its nodes get in, (id, fx, fy, fz) of the rows out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, low, high = (_first(left, c) for c in ("p", "low", "high"))
        order = np.argsort(right.column("chunk").to_numpy())
        given = [np.concatenate([right.column(f"g{a}")[int(n)].values.to_numpy() for n in order]).reshape(p[0], -1) for a in AXES]
        ids, out = [], []
        for rows in _leaves_of(left):
            (x, y, z), own = _ways(rows, p, low, high, smooth)
            got = np.zeros((3, len(x)))
            for n, g in enumerate(given):
                if own is not None:
                    g = np.matmul(np.matmul(own[1], (own[0] @ g).reshape(-1, p[1], p[2])), own[2].T).reshape(x.shape[1], -1)
                for k in range(0, len(x), 512):
                    i = slice(k, k + 512)
                    along = np.matmul((x[i] @ g).reshape(len(x[i]), y.shape[1], z.shape[1]), z[i][:, :, None])[:, :, 0]
                    got[n, i] = (along * y[i]).sum(axis=1) * rows[field][i]
            ids.append(rows["id"])
            out.append(got)
        forces = np.concatenate(out, axis=1)
        return pa.table({"id": pa.array(np.concatenate(ids), pa.int64()), **{f"f{a}": forces[n] for n, a in enumerate(AXES)}})

    return run


def dense_forces(df: DataFrame, law: Law, columns: tuple[str, ...], box: tuple[float | None, ...] = (None, None, None), limit: int = CELL_ROWS, halvings: int = HALVINGS, costs: Costs = COSTS) -> DataFrame:
    """(id, fx, fy, fz) partial sums of a law that ``over_arrays`` takes. A periodic axis has at least three reaches."""
    spark, cutoff, text = df.sparkSession, law.reach, over_arrays(law)
    # what has no place, or lacks what the law reads, gives and gets nothing
    there = [F.abs(F.col(a)) < 1e300 for a in AXES] + [F.col(c).isNotNull() for c in law.fields]
    for c in there:
        df = df.filter(c)
    ship(spark)
    tiles = leaves(df, cutoff, ("id", *law.fields), box, limit, halvings).withColumn("leaf", F.monotonically_increasing_id())
    weight = F.lit(0.0) if law.product is None else F.aggregate("rows", F.lit(0.0), lambda s, r: s + F.abs(r[law.product]))
    tiles = cut(tiles.withColumn("weight", weight))
    met = cut(meetings(tiles, cutoff, law.smooth if law.product else None, box, costs))
    carried = [f"o{a}" for a in AXES]
    tasks = max(64, 8 * spark.sparkContext.defaultParallelism)

    side = lambda s: tiles.select(F.col("leaf").alias(s), F.col("rows").alias(f"rows_{s}"))
    rows = _met_by(_met_by(met.filter("a IS NOT NULL").select("a", "b", "beyond", *carried), side("a"), "a"), side("b"), "b")
    out = rows.repartition(tasks, "a", "b").mapInArrow(_by_rows(text, cutoff, law.fields), "id long, fx double, fy double, fz double")
    through = met.filter("a IS NULL")
    if law.product is None or through.isEmpty():
        return out

    reps = through.select(F.inline(F.array(*[F.struct(*[F.col(f"{c}_{s}").alias(c) for c in ("rep", "p", "low", "high", "leaves")]) for s in "ab"]))).dropDuplicates(["rep"])
    of = reps.select("rep", "p", "low", "high", F.ceil(F.size("leaves") / costs.leaves).cast("int").alias("parts"), F.posexplode("leaves").alias("n", "leaf"))
    of = cut(_met_by(of.withColumn("part", F.expr("n % parts")).drop("n", "parts"), tiles.select("leaf", "rows"), "leaf"))
    weights = of.groupBy("rep", "part").applyInArrow(_to_nodes(law.product, law.smooth, costs.chunk), "rep string, chunk int, w array<double>")
    weights = cut(weights.groupBy("rep", "chunk").applyInArrow(_added("w"), "rep string, chunk int, w array<double>"))

    last = lambda s: F.ceil(F.col(f"p_{s}")[0] * F.col(f"p_{s}")[1] / F.greatest(F.lit(1), F.floor(F.lit(costs.chunk) / F.col(f"p_{s}")[2]))).cast("int") - 1
    pairs = through.withColumn("chunk_a", F.explode(F.sequence(F.lit(0), last("a")))).withColumn("chunk_b", F.explode(F.sequence(F.lit(0), last("b"))))
    pairs = pairs.filter("rep_a <> rep_b OR chunk_a <= chunk_b").drop("a", "b", "beyond", "leaves_a", "leaves_b")
    for s in "ab":
        pairs = _met_by(pairs, weights.toDF(f"rep_{s}", f"chunk_{s}", f"w_{s}"), [f"rep_{s}", f"chunk_{s}"])
    got = pairs.repartition(tasks, "rep_a", "rep_b", "chunk_a", "chunk_b").mapInArrow(_by_nodes(text, law.product, costs.chunk), "rep string, chunk int, gx array<double>, gy array<double>, gz array<double>")
    got = got.groupBy("rep", "chunk").applyInArrow(_added("gx", "gy", "gz"), "rep string, chunk int, gx array<double>, gy array<double>, gz array<double>")
    dealt = _met_by(got, reps.select("rep", F.explode(F.sequence(F.lit(0), F.ceil(F.size("leaves") / costs.leaves).cast("int") - 1)).alias("part")), "rep")
    read = of.groupBy("rep", "part").cogroup(dealt.groupBy("rep", "part")).applyInArrow(_from_nodes(law.product, law.smooth), "id long, fx double, fy double, fz double")
    return out.unionByName(read)
