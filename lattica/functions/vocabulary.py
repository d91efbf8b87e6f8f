"""Token vocabularies: contiguous ranges of ids for specials, atoms, whole numbers, positions and densities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.quantize import LogCodec

# Block names in id order; each block has a start and an end id, padding and line breaks have one.
CUBE_SPECIALS = ["PAD", "BOS", "EOS", "ATOMS_START", "ATOMS_END", "POS_START", "POS_END", "GRID_START", "GRID_END", "SHAPE_START", "SHAPE_END", "OFFSET_START", "OFFSET_END", "HI_START", "HI_END", "DENS_START", "DENS_END", "NL", "LATTICE_START", "LATTICE_END"]
BALL_SPECIALS = ["PAD", "BOS", "EOS", "ATOMS_START", "ATOMS_END", "POS_START", "POS_END", "GRID_START", "GRID_END", "RADIUS_START", "RADIUS_END", "CENTER_START", "CENTER_END", "BOUNDS_START", "BOUNDS_END", "DENS_START", "DENS_END", "NL"]
ATOMS, INTS = 118, 1024
LENGTH_STEP, ANGLE_STEP = 0.05, 0.2


@dataclass(frozen=True)
class Vocabulary:
    specials: tuple[str, ...] = tuple(CUBE_SPECIALS)
    position: LogCodec = field(default_factory=lambda: LogCodec.three_bytes(-4.0, 0.0))
    density: LogCodec = field(default_factory=lambda: LogCodec.two_tokens(-4.13, 4.97))

    @classmethod
    def ball(cls) -> Vocabulary:
        return cls(tuple(BALL_SPECIALS))

    def special(self, name: str) -> int:
        return self.specials.index(name)

    @property
    def atom_offset(self) -> int:
        return len(self.specials)

    @property
    def int_offset(self) -> int:
        return self.atom_offset + ATOMS

    @property
    def position_offset(self) -> int:
        return self.int_offset + INTS

    @property
    def density_offset(self) -> int:
        return self.position_offset + sum(self.position.vocab_sizes)

    @property
    def size(self) -> int:
        return self.density_offset + sum(self.density.vocab_sizes)

    def regions(self) -> list[tuple[str, int, int]]:
        """(region, first id, number of ids), in order."""
        return [("special", 0, self.atom_offset), ("atom", self.atom_offset, ATOMS), ("int", self.int_offset, INTS), ("position", self.position_offset, self.density_offset - self.position_offset), ("density", self.density_offset, self.size - self.density_offset)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(token_id, region, index): one row for each id; a small dimension."""
        regions = spark.createDataFrame(self.regions(), "region string, first long, n long")
        return regions.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("index"), "first").select((F.col("first") + F.col("index")).alias("token_id"), "region", "index")

    def export(self) -> dict[str, int]:
        """Word to id, for word-level tokenizers."""
        names = [f"[{s}]" for s in self.specials]
        for region, _, n in self.regions()[1:]:
            names += [f"{region}_{i}" for i in range(n)]
        return {name: i for i, name in enumerate(names)}

    def atom(self, z: Column) -> Column:
        return F.when(z.between(1, ATOMS), (z - 1 + self.atom_offset).cast("int")).otherwise(F.raise_error(F.concat(F.lit("atomic number out of range: "), z.cast("string"))))

    def whole(self, n: Column) -> Column:
        return F.when((n >= 0) & (n < INTS), (n + self.int_offset).cast("int")).otherwise(F.raise_error(F.concat(F.lit("number out of range: "), n.cast("string"))))

    def lattice_bins(self, lattice: list[Column]) -> list[Column]:
        """Bins of (a, b, c, alpha, beta, gamma), rounded half to even."""
        return [F.rint(x / (LENGTH_STEP if i < 3 else ANGLE_STEP)).cast("long") for i, x in enumerate(lattice)]


def lattice_fits(lattice: list[Column]) -> Column:
    """Whether all six bins have an id; a length that rounds up to 1024 has none."""
    ok = F.lit(True)
    for i, x in enumerate(lattice):
        ok &= (x >= 0) & (F.rint(x / (LENGTH_STEP if i < 3 else ANGLE_STEP)) < INTS)
    return ok
