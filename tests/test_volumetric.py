"""A volumetric text file in many splits equals the whole file parsed at once."""

import numpy as np

from lattica.sources import chgcar


def test_splits_of_one_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name, shape, species in (("A", (7, 5, 9), "2 3"), ("B", (2, 3, 4), "1")):
        n = sum(map(int, species.split()))
        grid = rng.normal(size=shape)
        values = [f"{v:.11E}" for v in grid.ravel(order="F")]
        body = "\n".join(" ".join(values[i : i + 5]) for i in range(0, len(values), 5))
        atoms = "\n".join(" 0.1 0.2 0.3" for _ in range(n))
        (tmp_path / name).write_text(f"x\n 1.0\n 4 0 0\n 0 4 0\n 0 0 4\n C O\n {species}\nDirect\n{atoms}\n \n {shape[0]} {shape[1]} {shape[2]}\n{body}\naugmentation occupancies 1 2\n 0.1 0.2\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "A")).rdd.getNumPartitions() > 8
        rows = chgcar.read_voxels(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for file in ("A", "B"):
        want = chgcar.parse((tmp_path / file).read_text())
        got = rows[rows.path.str.endswith(f"/{file}")].sort_values("flat")
        assert got.rho.tolist() == want["density"].tolist() and (got.nx.iloc[0], got.ny.iloc[0], got.nz.iloc[0]) == (want["nx"], want["ny"], want["nz"])
        assert ((got.ix * got.ny + got.iy) * got.nz + got.iz == got.flat).all()


def test_many_volumes_in_split_files(spark, tmp_path):
    """Splits cut volumes anywhere; two volumes share a title, one goes on over many splits, and a file begins without a title."""
    rng, want = np.random.default_rng(3), []
    for file in ("A", "B"):
        body = "no volume\n 5 5 5\n" if file == "B" else ""
        for title, shape in (("1", (2, 3, 4)), ("2", (9, 5, 7)), ("2", (2, 2, 2)), ("3", (1, 1, 1))):
            grid = rng.normal(size=shape)
            values = [f"{v:.11E}" for v in grid.ravel(order="F")]
            lines = "\n".join(" ".join(values[i : i + 5]) for i in range(0, len(values), 5))
            text = f"volume {title}\n 1.0\n 4 0 0\n 0 4 0\n 0 0 4\n C\n 1\nDirect\n 0 0 0\n\n {shape[0]} {shape[1]} {shape[2]}\n{lines}\naugmentation 1 2\n"
            want += [(file, title, *shape, i, v) for i, v in enumerate(chgcar.parse(text)["density"].tolist())]
            body += text
        (tmp_path / file).write_text(body)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size in (97, 500, 100_000):
            spark.conf.set(name, str(size))
            rows = chgcar.read_voxels(spark, str(tmp_path), title=r"^volume (\d+)$").collect()
            assert sorted((r.path[-1], r.title, r.nx, r.ny, r.nz, r.flat, r.rho) for r in rows) == sorted(want)
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_embeddings_share_text_files(spark, tmp_path, monkeypatch):
    """The number of files follows from Spark's tasks, not from the grids."""
    from lattica.plans import fields

    monkeypatch.setattr(fields, "new_path", lambda spark, name: str(tmp_path / name))
    assert fields.volumetric_text(spark, "/root/testdata/sf0.001").count() > 0
    assert len(list((tmp_path / "volumes").rglob("part-*"))) <= 8
