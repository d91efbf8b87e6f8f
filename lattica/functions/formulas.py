"""Scalar formulas: sequence lengths, coverage, token counts, labels, categories, hashing draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metals by symbol rule, halogens, chalcogens.
HALOGENS = ("F", "Cl", "Br", "I")
CHALCOGENS = ("S", "Se", "Te")
NON_METALS = ("H", "He", "B", "C", "N", "O", "F", "Ne", "Si", "P", "S", "Cl", "Ar", "Ge", "As", "Se", "Br", "Kr", "Sb", "Te", "I", "Xe", "At", "Rn", "Ts", "Og")
# Job states by code; a code without a name becomes UNKNOWN_<code>.
JOB_STATES = {1: "PENDING", 2: "BUILDING", 3: "RUNNING", 4: "SUCCEEDED", 5: "FAILED", 6: "KILLED", 7: "WORKER_FAILED", 8: "UNSCHEDULABLE"}


def cube_length(n_atoms: Column, p: int, tokens_per_voxel: int = 2, overhead: int = 36) -> Column:
    """Tokens of a cube patch row: overhead + 10 a + k p^3; null where the number of atoms is null."""
    return (F.lit(overhead) + 10 * n_atoms.cast("long") + F.lit(tokens_per_voxel * p**3)).cast("long")


def ball_length(n_atoms: Column, voxels: int, tokens_per_voxel: int = 2, overhead: int = 29) -> Column:
    return (F.lit(overhead) + 10 * n_atoms.cast("long") + F.lit(tokens_per_voxel * voxels)).cast("long")


def shell_counts(r2_max: int) -> list[int]:
    """V(0), V(1), ..., V(r2_max): lattice points with x^2 + y^2 + z^2 <= n, by enumeration."""
    reach = math.isqrt(r2_max)
    per = [0] * (r2_max + 1)
    square: dict[int, int] = {}
    for x in range(-reach, reach + 1):
        square[x * x] = square.get(x * x, 0) + 1
    for a, na in square.items():
        for b, nb in square.items():
            for c, nc in square.items():
                if a + b + c <= r2_max:
                    per[a + b + c] += na * nb * nc
    out, total = [], 0
    for n in per:
        total += n
        out.append(total)
    return out


def hit_chance(patch: int, voxels: Column, draws: int) -> Column:
    """Chance that a voxel lies in at least one of ``draws`` random patches."""
    return 1 - F.pow(1 - F.least(F.lit(1.0), F.lit(float(patch**3)) / voxels), F.lit(draws))


def expected_coverage(patch: int, voxels: Column, draws: int) -> Column:
    return F.lit(float(draws * patch**3)) / voxels


def token_counts(n: Column, k: Column, per_value: int = 3) -> dict[str, Column]:
    """Tokens of each representation of n values, k of them kept."""
    return {"direct": n * per_value, "cutoff": k * (per_value + 3), "fourier": k * (2 * per_value + 3), "delta": n * (1 + 3 * per_value)}


def parse_config_label(label: Column) -> tuple[Column, Column]:
    """(scheme, fraction) of labels such as ``cutoff-top-25pct``; scheme alone and null where there is no fraction."""
    pattern = r"^(.+?)-(\d+(?:\.\d+)?)pct$"
    share = F.nullif(F.regexp_extract(label, pattern, 2), F.lit("")).cast("double") / 100
    return F.when(label.rlike(pattern), F.regexp_extract(label, pattern, 1)).otherwise(label), share


def config_label(scheme: str, fraction: Column) -> Column:
    """A label such as ``cutoff-top-2.5pct``: the percentage in its shortest form."""
    return F.concat(F.lit(f"{scheme}-"), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(fraction * 100, 4)), "0+$", ""), r"\.$", ""), F.lit("pct"))


def expand_label(short: Column, prefix: str, plain: str, whole: str = "train-") -> Column:
    """A short label in full: whole ones stay, ``plain`` is the prefix alone, others follow it."""
    return F.when(short.startswith(whole), short).when(short == plain, F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}-"), short))


def category(symbols: Column) -> Column:
    """Material category of an array of element symbols; the first rule that holds decides, and an empty set counts as all metals."""
    among = lambda names: F.arrays_overlap(symbols, F.array(*map(F.lit, names)))
    oxygen, halogen, chalcogen = F.array_contains(symbols, "O"), among(HALOGENS), among(CHALCOGENS)
    return (
        F.when((F.size(symbols) == 0) | ~among(NON_METALS), "intermetallic")
        .when(halogen & oxygen, "oxyhalide")
        .when(halogen, "halide")
        .when(chalcogen & oxygen, "oxychalcogenide")
        .when(chalcogen, "chalcogenide")
        .when(oxygen, "oxide")
        .otherwise("other")
    )


def state_name(code: Column) -> Column:
    pairs = [x for k, v in JOB_STATES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), code.cast("int")), F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def draw(n: Column | int, *parts: Column) -> Column:
    """A whole number in [0, n) decided by the parts alone, whatever the partitioning: the first 28 bits of their md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))
