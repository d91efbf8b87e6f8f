"""Text volumetric files: lattice, species, coordinates, then a grid in Fortran order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources.scratch import checkpointed

SCHEMA = "path string, nx int, ny int, nz int, density array<double>, lattice array<double>, species array<string>, counts array<int>, coords array<double>"


def parse(text: str) -> dict:
    """The parts of one file; the density is turned to x-major order."""
    lines = text.splitlines()
    scale = float(lines[1])
    lattice = [scale * float(x) for row in lines[2:5] for x in row.split()]
    species, counts = lines[5].split(), [int(x) for x in lines[6].split()]
    n = sum(counts)
    coords = [float(x) for row in lines[8 : 8 + n] for x in row.split()[:3]]
    at = 8 + n
    while not lines[at].strip():
        at += 1
    shape = [int(x) for x in lines[at].split()]
    values: list[float] = []
    for row in lines[at + 1 :]:
        if len(values) >= int(np.prod(shape)):
            break
        values += map(float, row.split())
    grid = np.array(values[: int(np.prod(shape))]).reshape(shape, order="F")
    return {"nx": shape[0], "ny": shape[1], "nz": shape[2], "density": grid.ravel(), "lattice": lattice, "species": species, "counts": counts, "coords": coords}


def read_chgcar(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; a file is one task's unit of memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"path": p, **parse(bytes(c).decode())} for p, c in zip(f.path, f.content, strict=True)], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_voxels(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    """(path, nx, ny, nz, flat, ix, iy, iz, rho) of every grid point, from files of any size: each split of a file is one task's work.

    Spark's text source cuts a file at any line. Lines and numbers are counted in each split; sums over
    the splits before (a row for each split) give every line its number and every value its place in the
    file, and so in the grid. Values beyond the grid's size, such as what follows it, are left out.

    With ``title``, a pattern of first lines, a file may hold many volumes, one after another, each from a
    line that matches it to the next; what its first group holds is then another column, ``title``.
    Equal titles stand for different volumes; lines before the first title belong to none.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("parts"), (F.when(F.col("value").rlike(title), F.regexp_extract("value", title, 1)) if title else F.lit(None).cast("string")).alias("title"))
    file = Window.partitionBy("path", "split").orderBy("at")
    here = Window.partitionBy("path", "split", "nth").orderBy("at")  # the nth volume that begins in the split; 0: the one that goes on
    counted = text.withColumn("nth", F.count("title").over(file)).withColumn("line", F.row_number().over(here)).withColumn("upto", F.sum(F.size("parts")).over(here))
    counted = checkpointed(counted.drop("at"))
    begun = F.when(F.col("nth") > 0, F.struct("split", "nth", "title"))
    sums = counted.groupBy("path", "split", "nth").agg(F.max("line").alias("lines"), F.max("upto").alias("values"), F.max("title").alias("title")).withColumn("begun", begun)
    splits = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    open_ = sums.groupBy("path", "split").agg(F.max("begun").alias("begun")).select("path", "split", F.last("begun", ignorenulls=True).over(splits).alias("open"))
    none = F.struct(F.lit(0).cast("long").alias("split"), F.lit(0).cast("long").alias("nth"), F.lit(None).cast("string").alias("title"))
    of = sums.join(open_, ["path", "split"]).withColumn("of", F.coalesce("begun", "open", none)).where("of.nth > 0" if title else "true").withColumn("volume", F.concat_ws(":", "path", "of.split", "of.nth"))
    before = Window.partitionBy("volume").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    shift = of.select("path", "split", "nth", "volume", F.col("of.title").alias("title"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines"), F.coalesce(F.sum("values").over(before), F.lit(0)).alias("values"))
    placed = counted.drop("title").join(shift, ["path", "split", "nth"]).select("volume", "path", "title", "parts", (F.col("lines") + F.col("line") - 1).alias("line"), (F.col("values") + F.col("upto") - F.size("parts")).alias("place"))
    atoms = placed.where("line = 6").select("volume", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x.try_cast("long")).alias("atoms"))
    sized = placed.join(atoms, "volume").where((F.col("line") >= F.col("atoms") + 8) & (F.size("parts") > 0)).groupBy("volume").agg(F.min_by(F.struct("parts", "place"), "line").alias("head"))
    side = lambda i: F.get("head.parts", F.lit(i)).try_cast("int")
    shape = sized.select("volume", side(0).alias("nx"), side(1).alias("ny"), side(2).alias("nz"), (F.col("head.place") + F.size("head.parts")).alias("start"))
    named = ["path", "title"] if title else ["path"]
    rows = placed.join(shape, "volume").where("place >= start").select(*named, "nx", "ny", "nz", (F.col("place") - F.col("start")).alias("first"), F.posexplode("parts").alias("i", "text"))
    nx, ny, nz, rank = F.col("nx"), F.col("ny"), F.col("nz"), F.col("rank")
    cells = rows.withColumn("rank", F.col("first") + F.col("i")).where(rank < nx.cast("long") * ny * nz)
    cells = cells.withColumns({"ix": rank % nx, "iy": F.floor(rank / nx) % ny, "iz": F.floor(rank / (nx * ny))})
    return cells.select(*named, "nx", "ny", "nz", ((F.col("ix") * ny + F.col("iy")) * nz + F.col("iz")).alias("flat"), "ix", "iy", "iz", F.col("text").try_cast("double").alias("rho"))
