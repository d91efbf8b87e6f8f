"""Zarr v3 groups with a density array, read through Spark's binary file source, so any store that Spark reaches will do."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "task_id string, nx int, ny int, nz int, density array<double>, structure string, error string"


def _decode(meta: dict, chunks: dict[str, bytes]) -> np.ndarray:
    """The whole array of one group from its chunks, missing ones filled."""
    shape, chunk = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
    order = next((c for c in meta["codecs"] if c["name"] == "bytes"), {}).get("configuration", {}).get("endian", "little")
    kind = np.dtype(meta["data_type"]).newbyteorder("<" if order == "little" else ">")
    squeezed = any(c["name"] == "zstd" for c in meta["codecs"])
    out = np.full(shape, meta.get("fill_value") or 0, kind)
    for place in np.ndindex(*[-(-n // c) for n, c in zip(shape, chunk, strict=True)]):
        if (body := chunks.get("c/" + "/".join(map(str, place)))) is None:
            continue
        if squeezed:
            body = pa.decompress(body, int(np.prod(chunk)) * kind.itemsize, "zstd", asbytes=True)
        at = tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(place, chunk, shape, strict=True))
        out[at] = np.frombuffer(body, kind).reshape(chunk)[tuple(slice(0, s.stop - s.start) for s in at)]
    return out


def read_zarr(spark: SparkSession, path: str, array: str = "charge_density_total") -> DataFrame:
    """One row per ``*.zarr`` group: task_id, shape, density in x-major order, the structure as JSON text.

    The id is the metadata's task_id, else the folder's stem. A group that cannot be read gives a row
    with ``error`` and no density. One group is one task's unit of memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    parts = files.select(F.regexp_extract("path", r"^(.*\.zarr)/", 1).alias("group"), F.regexp_extract("path", r"\.zarr/(.*)$", 1).alias("name"), "content").where("group <> ''")

    def assemble(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(frame["name"], frame["content"], strict=True))
        stem = key[0].rsplit("/", 1)[-1].removesuffix(".zarr")
        row = {"task_id": stem, "nx": None, "ny": None, "nz": None, "density": None, "structure": None, "error": None}
        try:
            attrs = json.loads(held["zarr.json"]).get("attributes", {})
            about = json.loads(attrs["metadata"]) if isinstance(attrs.get("metadata"), str) else attrs.get("metadata") or {}
            row["task_id"] = about.get("task_id", stem)
            row["structure"] = attrs["structure"] if isinstance(attrs.get("structure"), str) else json.dumps(attrs.get("structure"))
            grid = _decode(json.loads(held[f"{array}/zarr.json"]), {n.removeprefix(f"{array}/"): c for n, c in held.items()})
            row["nx"], row["ny"], row["nz"] = grid.shape
            row["density"] = grid.astype(float).ravel()
        except (KeyError, ValueError, OSError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([row])

    return parts.groupBy("group").applyInPandas(assemble, SCHEMA)
