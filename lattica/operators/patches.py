"""Patches of periodic grids as token rows, and back.

A sample is a row with task_id, grid array<int>[3], offset array<int>[3], shape array<int>[3], lattice
array<double>[6], atoms array<int>, coords array<double>[3 n] and patch array<double>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.formulas import draw
from lattica.functions.vocabulary import Vocabulary


def patch_indices(p: int, grid: Column, offset: Column) -> Column:
    """Flat indices of a p^3 patch with periodic wrap, in x-major order."""
    n = p * p * p
    axis = lambda i, step: F.pmod(F.get(offset, F.lit(i)) + step, F.get(grid, F.lit(i)))

    def flat(j: Column) -> Column:
        x, y, z = axis(0, F.floor(j / (p * p))), axis(1, F.pmod(F.floor(j / p), F.lit(p))), axis(2, F.pmod(j, F.lit(p)))
        return ((x * F.get(grid, F.lit(1)) + y) * F.get(grid, F.lit(2)) + z).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), flat)


def extract(grids: DataFrame, p: int) -> DataFrame:
    """Add ``patch``: the cells of the wrapped cube at ``offset``; a gather inside the row, without a shuffle."""
    return grids.withColumn("patch", F.transform(patch_indices(p, F.col("grid"), F.col("offset")), lambda i: F.get(F.col("density"), i).cast("double"))).withColumn("shape", F.array(*[F.lit(p)] * 3))


def random_offsets(grids: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """``m`` rows for each grid with a drawn ``offset``; the draw depends on seed, task, number and axis alone."""
    rows = grids.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k"))
    return rows.withColumn("offset", F.array(*[draw(F.get("grid", F.lit(a)), F.lit(seed), F.col("task_id"), F.col("k"), F.lit(a)).cast("int") for a in range(3)]))


def random_centres(grids: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """``m`` centres a grid, each axis drawn over the whole side: (…, k, cx, cy, cz), decided by seed, grid and k alone."""
    rows = grids.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k"))
    return rows.withColumns({f"c{a}": draw(F.col(f"n{a}"), F.lit(seed), F.col("task_id"), F.col("k"), F.lit(a)) for a in "xyz"})


def high_corner(grid: Column, offset: Column, shape: Column) -> Column:
    """The wrapped last cell on each axis; below the offset where the patch crosses the boundary."""
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.pmod(F.get(offset, i) + F.get(shape, i) - 1, F.get(grid, i)))


def to_patch_frame(coords: Column, grid: Column, offset: Column) -> Column:
    """Fractional coordinates seen from the patch's corner, in [0, 1)."""
    return F.transform(coords, lambda c, i: F.pmod(c - F.get(offset, F.pmod(i, F.lit(3))) / F.get(grid, F.pmod(i, F.lit(3))), F.lit(1.0)))


def _block(v: Vocabulary, name: str, body: Column) -> list[Column]:
    return [F.array(F.lit(v.special(f"{name}_START"))), body, F.array(F.lit(v.special(f"{name}_END")))]


def tokenize(samples: DataFrame, v: Vocabulary, default_shape: int | None = None) -> DataFrame:
    """Add ``input_ids``.

    Without ``default_shape``: the long layout, with shape, offset and high corner. With it: the short
    layout in the patch's own frame, which names the shape only where it differs from the default.
    """
    whole = lambda c: F.transform(c, v.whole)
    coded = lambda c, codec, offset: F.flatten(F.transform(c, lambda x: codec.tokens(x, offset)))
    lattice = F.array(*v.lattice_bins([F.get("lattice", F.lit(i)) for i in range(6)]))
    coords = F.col("coords") if default_shape is None else to_patch_frame(F.col("coords"), F.col("grid"), F.col("offset"))
    parts = [F.array(F.lit(v.special("BOS"))), *_block(v, "GRID", whole(F.col("grid"))), *_block(v, "LATTICE", whole(lattice)), *_block(v, "ATOMS", F.transform("atoms", v.atom)), *_block(v, "POS", coded(coords, v.position, v.position_offset))]
    shape = _block(v, "SHAPE", whole(F.col("shape")))
    if default_shape is None:
        parts += [*shape, *_block(v, "OFFSET", whole(F.col("offset"))), *_block(v, "HI", whole(high_corner(F.col("grid"), F.col("offset"), F.col("shape"))))]
    else:
        usual = F.forall("shape", lambda s: s == default_shape)
        parts.append(F.when(usual, F.array().cast("array<int>")).otherwise(F.concat(*shape)))
    parts += [*_block(v, "DENS", coded(F.col("patch"), v.density, v.density_offset)), F.array(F.lit(v.special("EOS")))]
    return samples.withColumn("input_ids", F.concat(*parts).cast("array<int>"))


def block(ids: Column, v: Vocabulary, name: str) -> Column:
    """What stands between a block's start and end; null where either is missing."""
    start, end = (F.array_position(ids, v.special(f"{name}_{x}")).cast("int") for x in ("START", "END"))
    return F.when((start > 0) & (end > start), F.slice(ids, start + 1, end - start - 1))


def _with_blocks(rows: DataFrame, v: Vocabulary, names) -> DataFrame:
    """Add the ids without padding and each block as columns of their own, so that lambdas over them do not find them anew for each element."""
    return rows.withColumn("_ids", F.filter("input_ids", lambda t: t != v.special("PAD"))).withColumns({f"_{n}": block(F.col("_ids"), v, n) for n in names})


def _coded_block(name: str, codec, offset: int) -> Column:
    """Values of a block of coded numbers; empty for an empty block, null for a missing one."""
    body, k = F.col(f"_{name}"), len(codec.bits)
    value = F.transform(F.sequence(F.lit(0), F.floor(F.size(body) / k).cast("int") - 1), lambda i: codec.from_tokens([F.get(body, i * k + j) for j in range(k)], offset))
    return F.when(F.size(body) > 0, value).when(F.size(body) == 0, F.array().cast("array<double>"))


def detokenize(rows: DataFrame, v: Vocabulary, default_shape: int | None = None) -> DataFrame:
    """Add grid, lattice, atoms, coords, shape, offset, patch and ``error`` (null if the row is well formed).

    Padding at the end is ignored. A malformed row keeps its place, with the first fault that is found.
    """
    names = ("GRID", "LATTICE", "ATOMS", "POS", "SHAPE", "OFFSET", "HI", "DENS")
    rows = _with_blocks(rows, v, names if default_shape is None else [n for n in names if n not in ("OFFSET", "HI")])
    ids = F.col("_ids")
    whole = lambda name: F.transform(f"_{name}", lambda t: t - v.int_offset)
    coded = _coded_block
    out = rows.withColumns({
        "grid": whole("GRID"),
        "lattice": F.transform(whole("LATTICE"), lambda b, i: b * F.when(i < 3, 0.05).otherwise(0.2)),
        "atoms": F.transform("_ATOMS", lambda t: t - v.atom_offset + 1),
        "coords": coded("POS", v.position, v.position_offset),
        "patch": coded("DENS", v.density, v.density_offset),
    })
    if default_shape is None:
        out = out.withColumns({"shape": whole("SHAPE"), "offset": whole("OFFSET"), "_hi": whole("HI")})
    else:
        out = out.withColumns({"shape": F.coalesce(whole("SHAPE"), F.array(*[F.lit(default_shape)] * 3)), "offset": F.array(*[F.lit(0)] * 3)}).withColumn("_hi", high_corner(F.col("grid"), F.col("offset"), F.col("shape")))
    product = lambda c: reduce(lambda a, b: a * b, [F.get(c, F.lit(i)) for i in range(3)])
    faults = [
        (F.coalesce(F.get(ids, F.lit(0)), F.lit(-1)) != v.special("BOS"), "no BOS"),
        (F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit(-1)) != v.special("EOS"), "no EOS"),
        (F.coalesce(F.size("grid"), F.lit(-1)) != 3, "grid"),
        (F.coalesce(F.size("lattice"), F.lit(-1)) != 6, "lattice"),
        (F.col("atoms").isNull() | ~F.forall("atoms", lambda z: z.between(1, 118)), "atoms"),
        (F.col("coords").isNull() | (F.size("coords") != 3 * F.size("atoms")), "positions"),
        (F.coalesce(F.size("shape"), F.lit(-1)) != 3, "shape"),
        (F.coalesce(F.size("offset"), F.lit(-1)) != 3, "offset"),
        (~F.coalesce(F.col("_hi") == high_corner(F.col("grid"), F.col("offset"), F.col("shape")), F.lit(False)), "high corner"),
        (F.col("patch").isNull() | (F.size("patch") != product(F.col("shape"))), "density"),
    ]
    error = reduce(lambda c, f: c.when(f[0], f[1]), faults, F)
    return out.withColumn("error", error).drop("_hi", "_ids", *[f"_{n}" for n in names])


def pad_right(ids: Column, length: int) -> Column:
    """Zeros up to ``length``; a longer row stays as it is."""
    return F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def preamble(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """(task_id, nx, ny, nz, n_atoms, n_electrons, lattice, offset) from token rows, one for each material; offset is null in the short layout."""
    ids = F.col("input_ids")
    grid, atoms, bins, offset = (block(ids, v, n) for n in ("GRID", "ATOMS", "LATTICE", "OFFSET"))
    lattice = F.transform(bins, lambda t, i: (t - v.int_offset) * F.when(i < 3, 0.05).otherwise(0.2))
    out = rows.select(
        "task_id",
        *[(F.get(grid, F.lit(i)) - v.int_offset).cast("long").alias(f"n{a}") for i, a in enumerate("xyz")],
        F.size(atoms).cast("long").alias("n_atoms"),
        F.aggregate(atoms, F.lit(0).cast("long"), lambda a, t: a + t - v.atom_offset + 1).alias("n_electrons"),
        lattice.alias("lattice"),
        F.transform(offset, lambda t: t - v.int_offset).alias("offset"),
    )
    return out.dropDuplicates(["task_id"])


def render_blocks(rows: DataFrame, v: Vocabulary, keys: list[str], ends: int = 6) -> DataFrame:
    """(keys, block, shown): every block of a row as text, numbers where a block holds numbers.

    Positions stand in groups of nine, an atom each; of the density the count and ``ends`` ids at either end; of the padding the count. Blocks that a row lacks are left out.
    """
    ids = F.col("input_ids")
    text = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), " ")
    whole = lambda name: text(F.transform(block(ids, v, name), lambda t: t - v.int_offset))
    pos, dens = block(ids, v, "POS"), block(ids, v, "DENS")
    nine = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(pos) / 9).cast("int") - 1)), lambda i: text(F.slice(pos, i * 9 + 1, 9)))
    few = F.when(F.size(dens) <= 2 * ends, text(dens)).otherwise(F.concat(text(F.slice(dens, 1, ends)), F.lit(" .. "), text(F.slice(dens, -ends, ends))))
    shown = {
        "GRID": whole("GRID"),
        "ATOMS": text(F.transform(block(ids, v, "ATOMS"), lambda t: t - v.atom_offset + 1)),
        "POS": F.when(pos.isNotNull(), F.array_join(nine, " | ")),
        **{n: whole(n) for n in ("SHAPE", "OFFSET", "HI")},
        "DENS": F.concat(F.size(dens).cast("string"), F.lit(": "), few),
        "PAD": F.size(F.filter(ids, lambda t: t == v.special("PAD"))).cast("string"),
    }
    listed = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("block"), c.alias("shown")) for n, c in shown.items()])).alias("_b"))
    return listed.select(*keys, "_b.block", "_b.shown").where("shown is not null")


def tiles(grids: DataFrame, p: int) -> DataFrame:
    """Full coverage: patches at stride p, and on each axis one that ends at the edge and gives only the cells not yet covered.

    Adds ox, oy, oz (corners) and sx, sy, sz (first own cell within the patch). Sides shorter than ``p`` are an error.
    """
    out = grids
    for a in "xyz":
        n = F.when(F.col(f"n{a}") >= p, F.col(f"n{a}").cast("int")).otherwise(F.raise_error(F.lit("a side is shorter than the patch")).cast("int"))
        steps = F.transform(F.sequence(F.lit(0), n - p, F.lit(p)), lambda s: F.struct(s.alias("o"), F.lit(0).alias("s")))
        tail = F.when(n % p != 0, F.array(F.struct((n - p).alias("o"), (p - n % p).alias("s")))).otherwise(F.array().cast("array<struct<o:int,s:int>>"))
        out = out.select("*", F.explode(F.concat(steps, tail)).alias("_t")).withColumns({f"o{a}": F.col("_t.o"), f"s{a}": F.col("_t.s")}).drop("_t")
    return out


def stitch(cells: DataFrame) -> DataFrame:
    """Packed grids from (task_id, flat, rho) where each cell is given once; ``n_cells`` and ``most`` tell gaps and overlaps."""
    one = cells.groupBy("task_id", "flat").agg(F.first("rho").alias("rho"), F.count("*").alias("times"))
    g = one.groupBy("task_id").agg(F.count("*").alias("n_cells"), F.max("times").alias("most"), F.array_sort(F.collect_list(F.struct("flat", "rho"))).alias("v"))
    return g.select("task_id", "n_cells", "most", F.transform("v", lambda x: x["rho"]).alias("density"))


def render(rows: DataFrame, vocabulary: DataFrame, head: int = 12) -> DataFrame:
    """The first ``head`` tokens of each row as words, through the vocabulary dimension."""
    each = rows.select("task_id", F.posexplode(F.slice("input_ids", 1, head)).alias("at", "token_id"))
    named = each.join(F.broadcast(vocabulary), "token_id", "left")  # a few ten thousand rows
    text = F.concat_ws("_", F.coalesce("region", F.lit("unknown")), F.coalesce("index", "token_id").cast("string"))
    words = named.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("at", text.alias("word")))).alias("w"))
    return words.select("task_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("shown"))


def ball_points(spark, r2_max: int) -> DataFrame:
    """Lattice points with dx^2 + dy^2 + dz^2 <= r2_max and their place in the order (r2, dy, dx, dz)."""
    reach = int(r2_max**0.5)
    axis = lambda name: spark.range(-reach, reach + 1).select(F.col("id").alias(name))
    r2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    points = axis("dx").crossJoin(axis("dy")).crossJoin(axis("dz")).withColumn("r2", r2).where(F.col("r2") <= r2_max)  # bounded by the radius, a parameter
    rows = points.groupBy().agg(F.array_sort(F.collect_list(F.struct("r2", "dy", "dx", "dz"))).alias("p"))
    return rows.select(F.posexplode("p").alias("place", "p")).select(F.col("place").cast("long").alias("place"), "p.dx", "p.dy", "p.dz", "p.r2")


def extract_ball(voxels: DataFrame, centres: DataFrame, points: DataFrame) -> DataFrame:
    """Cells of the ball around each centre that lie inside the grid: (task_id, place, rho).

    ``centres``: (task_id, cx, cy, cz, nx, ny, nz). Points outside the grid are left out, not wrapped.
    """
    at = centres.join(F.broadcast(points))  # the points are bounded by the radius
    inside = F.lit(True)
    for a in "xyz":
        at = at.withColumn(f"i{a}", F.col(f"c{a}") + F.col(f"d{a}"))
        inside &= (F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < F.col(f"n{a}"))
    return at.where(inside).join(voxels, ["task_id", "ix", "iy", "iz"]).select("task_id", "place", "ix", "iy", "iz", "rho")


def tokenize_ball(samples: DataFrame, v: Vocabulary) -> DataFrame:
    """Token rows of balls: grid, atoms, coords, r2_max, center, bounds and patch columns give ``input_ids``."""
    whole = lambda c: F.transform(c, v.whole)
    coded = lambda c, codec, offset: F.flatten(F.transform(c, lambda x: codec.tokens(x, offset)))
    parts = [F.array(F.lit(v.special("BOS"))), *_block(v, "GRID", whole(F.col("grid"))), *_block(v, "ATOMS", F.transform("atoms", v.atom)), *_block(v, "POS", coded(F.col("coords"), v.position, v.position_offset)), *_block(v, "RADIUS", F.array(v.whole(F.col("r2_max")))), *_block(v, "CENTER", whole(F.col("center"))), *_block(v, "BOUNDS", whole(F.col("bounds"))), *_block(v, "DENS", coded(F.col("patch"), v.density, v.density_offset)), F.array(F.lit(v.special("EOS")))]
    return samples.withColumn("input_ids", F.concat(*parts).cast("array<int>"))


def detokenize_ball(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """Add grid, atoms, coords, r2_max, center, bounds, patch and ``error`` (null if well formed, else the first fault) of ball rows."""
    names = ("GRID", "ATOMS", "POS", "RADIUS", "CENTER", "BOUNDS", "DENS")
    whole = lambda name: F.transform(f"_{name}", lambda t: t - v.int_offset)
    out = _with_blocks(rows, v, names).withColumns({
        "grid": whole("GRID"),
        "atoms": F.transform("_ATOMS", lambda t: t - v.atom_offset + 1),
        "coords": _coded_block("POS", v.position, v.position_offset),
        "r2_max": F.get(whole("RADIUS"), F.lit(0)),
        "center": whole("CENTER"),
        "bounds": whole("BOUNDS"),
        "patch": _coded_block("DENS", v.density, v.density_offset),
    })
    sized = lambda c, n: F.coalesce(F.size(c), F.lit(-1)) != n
    faults = [
        (F.coalesce(F.get("_ids", F.lit(0)), F.lit(-1)) != v.special("BOS"), "no BOS"),
        (F.coalesce(F.try_element_at("_ids", F.lit(-1)), F.lit(-1)) != v.special("EOS"), "no EOS"),
        (sized("grid", 3), "grid"),
        (F.col("atoms").isNull() | ~F.forall("atoms", lambda z: z.between(1, 118)), "atoms"),
        (F.col("coords").isNull() | (F.size("coords") != 3 * F.size("atoms")), "positions"),
        (F.coalesce(F.col("r2_max"), F.lit(-1)) < 0, "radius"),
        (sized("center", 3), "center"),
        (sized("bounds", 6), "bounds"),
        (F.col("patch").isNull(), "density"),
    ]
    out = out.withColumn("error", reduce(lambda c, f: c.when(f[0], f[1]), faults, F))
    return out.drop("_ids", *[f"_{n}" for n in names])
