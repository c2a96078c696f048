"""Sums of central forces of unlimited reach, or of a reach of which a periodic axis has not three, tile by tile.

A law without a cutoff meets every pair, so what counts is that pairs never become rows: two tiles of about two thousand
particles come together in a task, which evaluates the law over blocks of them as arrays and gives one sum a particle and
tile. Of each pair of tiles both get their sums at once, equal and opposite. Only particles of types that a law joins meet.

The law's own SQL is what is evaluated; laws whose SQL has more than arithmetic and the functions below stay with Spark.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.laws import Law
from ..session import ship
from .pairs import tiles_by_hash

#: SQL functions that have the same meaning over arrays.
FUNCTIONS = {"sqrt": np.sqrt, "exp": np.exp, "ln": np.log, "power": np.power, "abs": np.abs, "greatest": np.maximum, "least": np.minimum}
_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.USub)
#: Rows of one tile and of the other that meet at once, so that arrays of pairs stay in the processor's cache.
ROWS, OTHERS = 64, 1024
#: Rows of a small table's tile and of a large one's, and how many small tiles there are at most: the rows that are shuffled are the table's
#: times the number of tiles, and so are a large table's over again unless its tiles grow.
SMALL_TILE, LARGE_TILE, MOST_SMALL = 2048, 16384, 32


def over_arrays(law: Law) -> str | None:
    """The law's scale as an expression over arrays, or None where it is more than arithmetic."""
    if not law.central or law.symmetry != "antisymmetric" or law.at_zero:
        return None
    text = law.scale()
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError:
        return None
    names = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    fields = {f"{c}_{s}" for c in law.fields for s in "ab"} | {"r2"}
    known = all(isinstance(n, _NODES) for n in ast.walk(tree)) and names <= set(FUNCTIONS)
    return text.strip() if known and {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} <= fields | names else None


def _apart(a: dict, b: dict, ia: np.ndarray, ib: np.ndarray, cutoff: float, box: tuple[float | None, ...], rows: int, others: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ia and ib in order of the axis along which the rows lie farthest apart, and which of their blocks, by the blocks' bounds, are beyond
    the cutoff of one another."""
    seen = [[v if length is None else v - length * np.floor(v / length) for v in (a[c][ia], b[c][ib])] for c, length in zip("xyz", box, strict=True)]
    axis = max(range(3), key=lambda n: np.ptp(seen[n][0]))
    orders = [np.argsort(v, kind="stable") for v in seen[axis]]
    gap = 0.0
    for (x, y), length in zip(seen, box, strict=True):
        low_a, high_a, low_b, high_b = (f.reduceat(v[o], np.arange(0, len(o), step)) for v, o, step in ((x, orders[0], rows), (y, orders[1], others)) for f in (np.minimum, np.maximum))
        moved = [np.maximum(0.0, np.maximum(low_b[None, :] + m - high_a[:, None], low_a[:, None] - high_b[None, :] - m)) for m in ((0.0,) if length is None else (-length, 0.0, length))]
        gap = gap + np.minimum.reduce(moved) ** 2
    return ia[orders[0]], ib[orders[1]], gap > cutoff * cutoff * (1 + 1e-9)


def _kernel(parts: list[tuple[str, float | None, tuple[tuple[int, int], ...] | None]], fields: tuple[str, ...], box: tuple[float | None, ...]) -> Callable:
    """The function for ``mapInArrow``: tiles in, (id, fx, fy, fz) sums out."""
    rows, others = ROWS, OTHERS

    def sums(a: dict, b: dict, expression, cutoff: float | None, fa: np.ndarray, fb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
        """Adds what the rows ia of a and ib of b give to one another."""
        apart = None
        if cutoff is not None:
            ia, ib, apart = _apart(a, b, ia, ib, cutoff, box, rows, others)
        for m in range(0, len(ib), others):
            j = ib[m : m + others]
            bx = [b[c][j] for c in "xyz"]
            fields_b = {f"{c}_b": b[c][j] for c in fields}
            for k in range(0, len(ia), rows):
                if apart is not None and apart[k // rows, m // others]:
                    continue
                i = ia[k : k + rows]
                d = [v[None, :] - a[c][i][:, None] for c, v in zip("xyz", bx, strict=True)]
                for x, length in zip(d, box, strict=True):
                    if length is not None:
                        x -= length * np.floor(x / length + 0.5)
                r2 = d[0] * d[0]
                r2 += d[1] * d[1]
                r2 += d[2] * d[2]
                on = r2 > 0 if cutoff is None else (r2 > 0) & (r2 <= cutoff * cutoff)
                if not on.any():
                    continue
                scale = eval(expression, {"__builtins__": {}, **FUNCTIONS}, {"r2": r2, **fields_b, **{f"{c}_a": a[c][i][:, None] for c in fields}})  # noqa: S307  the tree has been checked
                if not on.all():
                    scale = np.where(on, scale, 0.0)
                ones_a, ones_b = np.ones(len(i)), np.ones(len(j))
                for n, x in enumerate(d):
                    x *= scale
                    fa[i, n] += x @ ones_b
                    fb[j, n] -= ones_a @ x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(compile(text, "law", "eval"), cutoff, pairs) for text, cutoff, pairs in parts]
        for batch in batches:
            for row in range(batch.num_rows):
                p, q = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("p", "q"))
                a, b = ({c: np.ascontiguousarray(v) for c, v in zip(tile.type.names, (x.to_numpy(zero_copy_only=False) for x in tile.flatten()), strict=True)} for tile in (batch.column(batch.schema.get_field_index(c))[row].values for c in ("rows_a", "rows_b")))
                fa, fb = (np.zeros((len(t["id"]), 3)) for t in (a, b))
                with np.errstate(all="ignore"):
                    for expression, cutoff, pairs in compiled:
                        for s, t in pairs or [(None, None)]:
                            for one, other in {(s, t), (t, s)}:
                                ia, ib = (np.arange(len(x["id"])) if of is None else np.flatnonzero(x["type"] == of) for x, of in ((a, one), (b, other)))
                                if len(ia) and len(ib):
                                    sums(a, b, expression, cutoff, fa, fb, ia, ib)
                if p == q:
                    fb *= 0  # a tile with itself meets each pair from both sides
                for t, f in ((a, fa), (b, fb)) if p != q else ((a, fa),):
                    yield pa.RecordBatch.from_arrays([pa.array(t["id"], pa.int64()), *[pa.array(f[:, n]) for n in range(3)]], ["id", "fx", "fy", "fz"])

    return run


def tiles_of(n: int) -> int:
    """How many tiles n rows are dealt into."""
    return max(8, min(ceil(n / SMALL_TILE), max(MOST_SMALL, ceil(n / LARGE_TILE))))


def tile_forces(df: DataFrame, laws: dict[Law, list[tuple[int, int]] | None], columns: tuple[str, ...], box: tuple[float | None, ...] = (None, None, None)) -> DataFrame:
    """(id, fx, fy, fz) partial sums of laws with the type pairs that they join, or None for all pairs."""
    fields = tuple(dict.fromkeys(f for law in laws for f in law.fields))
    parts = [(over_arrays(law), None if law.reach > 1e100 else law.reach, pairs and tuple(pairs)) for law, pairs in laws.items()]
    tiles = tiles_by_hash(df, columns, tiles_of(df.count()))
    ship(df.sparkSession)
    return tiles.mapInArrow(_kernel(parts, fields, box), "id long, fx double, fy double, fz double")
