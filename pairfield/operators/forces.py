"""Force sums per particle, and what is computed from a particle table by projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.laws import Law, NoForce, active, columns_of, distinct_laws, law_table, of_types, scale_by_type, within
from .dense import dense_forces
from .pairs import Search, binned, bins_of, bonded, both_ways, direct
from .tiles import over_arrays, tile_forces

ALIVE, DEAD, PASSIVE, STATIONARY, INVALID = 1, 2, 4, 8, 128
EXERTING, MOVABLE, ALL = ALIVE | STATIONARY, ALIVE | PASSIVE, 15


def summed(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """df with fx, fy, fz: the sum of (id, fx, fy, fz) rows; 0 where there are none. Spark sums partially before the shuffle."""
    if not parts:
        return df.withColumns({f"f{a}": F.lit(0.0) for a in "xyz"})
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy("id").agg(*[F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"])
    # as many rows as particles: never through the driver
    out = df.drop("fx", "fy", "fz").join(total.hint("merge"), "id", "left")
    return out.withColumns({f"f{a}": F.coalesce(f"f{a}", F.lit(0.0)) for a in "xyz"})


def _both(pairs: DataFrame, on_a: list[Column], on_b: list[Column]) -> DataFrame:
    """(id, fx, fy, fz): what a pair gives to each of its particles, from one row."""
    row = lambda name, f: F.struct(F.col(name).alias("id"), *[c.alias(f"f{a}") for c, a in zip(f, "xyz", strict=True)])
    return pairs.select(F.inline(F.array(row("id_a", on_a), row("id_b", on_b))))


def by_scale(pairs: DataFrame, scale: str) -> DataFrame:
    """Central forces of unordered pairs, equal and opposite."""
    s = pairs.filter("r2 > 0").withColumn("s", F.expr(scale))
    parts = [F.col("s") * F.col(f"d{a}") for a in "xyz"]
    return _both(s, parts, [-c for c in parts])


def by_law(pairs: DataFrame, law: Law) -> DataFrame:
    """What one law gives for unordered pairs, by its symmetry; the first of a pair has the lower type, then the lower id."""
    if not law.at_zero:
        pairs = pairs.filter("r2 > 0")
    if law.symmetry == "nonsymmetric":
        each = both_ways(pairs)
        return each.select(F.col("id_a").alias("id"), *[F.expr(v).alias(f"f{a}") for v, a in zip(law.vector(), "xyz", strict=True)])
    turned = F.lit(False) if law.central else (F.col("type_b") < F.col("type_a")) | ((F.col("type_a") == F.col("type_b")) & (F.col("id_b") < F.col("id_a")))
    return _one_way(pairs, law, turned)


def _one_way(pairs: DataFrame, law: Law, turned: Column) -> DataFrame:
    if not law.central:
        swap = [c for c in pairs.columns if c[-2:] in ("_a", "_b")]
        other = lambda c: c[:-1] + ("b" if c[-1] == "a" else "a")
        pairs = pairs.withColumn("__t", turned).select(*[F.when(F.col("__t"), F.col(other(c))).otherwise(F.col(c)).alias(c) for c in swap], *[F.when(F.col("__t"), -F.col(f"d{a}")).otherwise(F.col(f"d{a}")).alias(f"d{a}") for a in "xyz"], "r2")
    parts = pairs.select("id_a", "id_b", *[F.expr(v).alias(f"g{a}") for v, a in zip(law.vector(), "xyz", strict=True)])
    on_a = [F.col(f"g{a}") for a in "xyz"]
    return _both(parts, on_a, on_a if law.symmetry == "symmetric" else [-c for c in on_a])


def around(law: Law, box) -> bool:
    """Whether a periodic axis has fewer than three cells of the law's reach, so that no grid serves."""
    return any(length is not None and length < 3 * law.reach for length in box)


def _type_parts(df: DataFrame, table: dict[tuple[int, int], Law], box, search: Search) -> list[DataFrame]:
    """Force rows of a table of laws. Laws of finite reach share a join in which each reach has cells of its own; those of unlimited
    reach meet in tiles. Either has only the types that it concerns."""
    parts, laws = [], active(table)
    near, far = ({k: v for k, v in laws.items() if (v.reach > 1e100) == far} for far in (False, True))
    of_laws = lambda own: df.filter(F.col("type").isin(sorted({t for pair in own for t in pair})))
    wide = {k: v for k, v in near.items() if around(v, box)}
    arrays = {law: pairs for law, pairs in distinct_laws(far | wide).items() if over_arrays(law)}
    if arrays:
        parts.append(tile_forces(of_laws([p for pairs in arrays.values() for p in pairs]), arrays, columns_of(arrays, df.columns), box))
        near, far = ({k: v for k, v in own.items() if k not in wide and k not in far or v not in arrays} for own in (near, far))
    for own in (near, far):
        if not own:
            continue
        columns, reach = columns_of(own.values(), df.columns), max(v.reach for v in own.values())
        if reach > 1e100:
            pairs = direct(of_laws(own), None, columns, box, directed=False)
        elif search.kind == "cells" and search.per_cutoff == 1 and len({v.reach for v in own.values()}) > 1:
            pairs = binned(of_laws(own), bins_of({k: v.reach for k, v in own.items()}), columns, box, directed=False)
        else:
            pairs = search.pairs(of_laws(own), reach, columns, box)
        central = {k: v for k, v in own.items() if v.central}
        if central:
            parts.append(by_scale(pairs, scale_by_type(central)))
        for law, of in distinct_laws({k: v for k, v in own.items() if not v.central}).items():
            parts.append(by_law(pairs.filter(f"({of_types(of)}){within(law)}"), law))
    return parts


def _bond_parts(df: DataFrame, bonds: DataFrame, law: Law | dict[int, Law]) -> list[DataFrame]:
    """One law for all bonds, or by the number in the bonds' column ``law``. src is the first of a pair."""
    if isinstance(law, Law):
        return [_bond_part(bonded(df, bonds.select("src", "dst"), columns_of([law], df.columns), directed=False), law)]
    pairs = bonded(df, bonds.select("src", "dst", "law"), columns_of(law.values(), df.columns), directed=False)
    return [_bond_part(pairs.filter(F.col("law") == n).drop("law"), own) for n, own in sorted(law.items()) if not isinstance(own, NoForce)]


def _bond_part(pairs: DataFrame, law: Law) -> DataFrame:
    if law.central and law.symmetry == "antisymmetric":
        return by_scale(pairs, law.scale())
    if law.symmetry == "nonsymmetric":
        return by_law(pairs, law)
    return _one_way(pairs if law.at_zero else pairs.filter("r2 > 0"), law, F.lit(False))


def pair_forces(df: DataFrame, law: Law | dict[tuple[int, int], Law], types: list[int] | None = None, box=(None, None, None), bonds: DataFrame | None = None, bond_law: Law | dict[int, Law] | None = None, strict_states: bool = False, search: Search = Search()) -> DataFrame:
    """df with the net force of a law for all pairs, or of one per type pair, and of bonds beside it.

    By default every state exerts and receives. With ``strict_states`` dead particles take no part and passive ones
    receive only. ``search`` says how laws of finite reach find their pairs.
    """
    acting = df.filter(in_state(ALL & ~DEAD)) if strict_states else df
    if strict_states:
        # a passive particle may not act: its part of a pair is computed, the other's is left out
        return _strict(df, acting, law, types, box, bonds, bond_law, search)
    return summed(df, *_parts(acting, law, types, box, bonds, bond_law, search))


def _parts(df, law, types, box, bonds, bond_law, search) -> list[DataFrame]:
    if isinstance(law, NoForce):
        parts = []
    elif isinstance(law, Law):
        columns = columns_of([law], df.columns)
        if (law.reach > 1e100 or around(law, box)) and over_arrays(law):
            parts = [tile_forces(df, {law: None}, columns, box)]
        elif search.kind == "adaptive" and over_arrays(law):
            parts = [dense_forces(df, law, columns, box, search.rows)]
        else:
            pairs = direct(df, None, columns, box, directed=False) if law.reach > 1e100 else search.pairs(df, law.reach, columns, box)
            parts = [by_scale(pairs, law.scale()) if law.central and law.symmetry == "antisymmetric" else by_law(pairs, law)]
    else:
        parts = _type_parts(df, law_table(law, types), box, search)
    if bonds is not None:
        parts += _bond_parts(df, bonds, bond_law)
    return parts


def _strict(df, acting, law, types, box, bonds, bond_law, search) -> DataFrame:
    exerting = acting.filter(in_state(EXERTING))
    passive = acting.filter(~in_state(EXERTING))
    among = _parts(exerting, law, types, box, bonds, bond_law, search)
    # forces on passive rows: all pairs of both kinds, less those of passive rows with each other
    keep = lambda parts: [x.join(passive.select("id").hint("merge"), "id", "left_semi") for x in parts]  # noqa: E731  not through the driver
    minus = lambda parts: [x.withColumns({f"f{a}": -F.col(f"f{a}") for a in "xyz"}) for x in parts]
    return summed(df, *among, *keep(_parts(acting, law, types, box, bonds, bond_law, search)), *minus(_parts(passive, law, types, box, bonds, bond_law, search)))


def in_state(mask: int):
    return F.col("state").cast("int").bitwiseAND(F.lit(mask)) != 0


def inside(low, high):
    """In the closed box, and alive and nothing else."""
    test = F.col("state") == ALIVE
    for a, lo, hi in zip("xyz", low, high, strict=True):
        test = test & F.col(a).between(float(lo), float(hi))
    return test


def half_kick(df: DataFrame, dt: float) -> DataFrame:
    move = in_state(MOVABLE)
    return df.withColumns({f"v{a}": F.when(move, F.col(f"v{a}") + F.lit(dt / 2) * F.col(f"f{a}") / F.col("mass")).otherwise(F.col(f"v{a}")) for a in "xyz"})


def drift(df: DataFrame, dt: float) -> DataFrame:
    move = in_state(MOVABLE)
    old = df.withColumns({f"o{a}": F.when(move, F.col(a)).otherwise(F.col(f"o{a}")) if f"o{a}" in df.columns else F.col(a) for a in "xyz"})
    return old.withColumns({a: F.when(move, F.col(a) + F.lit(dt) * F.col(f"v{a}")).otherwise(F.col(a)) for a in "xyz"})


def uniform_field(df: DataFrame, force: tuple[float, float, float]) -> DataFrame:
    return df.withColumns({f"f{a}": F.col(f"f{a}") + F.lit(float(f)) for a, f in zip("xyz", force, strict=True)})


def local_field(df: DataFrame, force, low, high, time: float, begin: float, end: float) -> DataFrame:
    """Adds the force inside the closed box while begin <= time < end."""
    if not begin <= time < end:
        return df
    within = F.col("x").between(float(low[0]), float(high[0])) & F.col("y").between(float(low[1]), float(high[1])) & F.col("z").between(float(low[2]), float(high[2]))
    return df.withColumns({f"f{a}": F.when(within, F.col(f"f{a}") + F.lit(float(f))).otherwise(F.col(f"f{a}")) for a, f in zip("xyz", force, strict=True)})
