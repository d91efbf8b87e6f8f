"""Run telemetry: histories, running maxima, counter jumps, latest and best values, job states, trajectories."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lattica.functions.formulas import state_name
from lattica.operators.scans import count_so_far, first_of, greatest_so_far, row_before, scan


def project_history(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows where any key without a leading underscore has a value."""
    named = [F.col(k).isNotNull() for k in keys if not k.startswith("_")]
    return rows.select(*keys).where(reduce(lambda a, b: a | b, named))


def running_max(rows: DataFrame, run: str, order: list[str], value: str) -> DataFrame:
    """(run, order, value, so_far, …), nulls of value or time (the first of ``order``) dropped."""
    return scan(rows.where(F.col(value).isNotNull() & F.col(order[0]).isNotNull()), run, order, so_far=greatest_so_far(run, F.col(value)))


def jumps(rows: DataFrame, run: str, order: list[str], counter: str) -> DataFrame:
    """Rows where a counter exceeds its last non-null value, ``before``."""
    known = scan(rows.where(F.col(counter).isNotNull()), run, order, before=row_before(run, F.col(counter)))
    return known.withColumn("before", F.col("before.value")).where(F.col(counter) > F.col("before"))


def running_count(rows: DataFrame, run: str, order: list[str], condition: Column | None = None, name: str = "upto") -> DataFrame:
    """The number of rows up to each, or of those that meet a condition."""
    return scan(rows, run, order, **{name: count_so_far(run, F.lit(True) if condition is None else condition)})


def poll(rows: DataFrame, run: str, order: list[str], total: str) -> DataFrame:
    """delta since the last poll (0 at first, never negative), elapsed hours, and the total's hourly rate (0 within half a minute); the time is the first of ``order``."""
    at = F.col(order[0]).cast("double")
    known = scan(rows, run, order, _last=row_before(run, F.col(total)), _began=first_of(run, at))
    out = known.withColumn("delta", F.greatest(F.lit(0), F.col(total) - F.coalesce("_last.value", total))).withColumn("hours", (at - F.col("_began")) / 3600)
    return out.withColumn("per_hour", F.when(F.col("hours") * 60 <= 0.5, 0.0).otherwise(F.col(total) / F.col("hours"))).drop("_last", "_began")


def latest(rows: DataFrame, run: str, step: str, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(run).agg(F.max_by(value, step).alias("latest"), F.max(step).alias("at"))


def best(rows: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Smallest value and its step; the first step wins a tie."""
    m = rows.where(F.col(value).isNotNull()).groupBy(run).agg(F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s"))).alias("m"))
    return m.select(run, F.col("m.s").alias("best_step"), F.col("m.v").alias("best_value"))


def by_step(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two metrics on their keys."""
    return a.join(b, keys, "full_outer")


def job_table(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs with the largest preemption and failure counts of their tasks; a job without tasks has zeros."""
    worst = tasks.groupBy("job_id").agg(F.max("preemption_count").alias("_p"), F.max("failure_count").alias("_f"))
    return jobs.join(worst, "job_id", "left").select("job_id", state_name(F.col("state")).alias("state"), F.coalesce("_p", F.lit(0)).cast("long").alias("preemptions"), F.coalesce("_f", F.lit(0)).cast("long").alias("failures"))


def trajectories(rows: DataFrame, keys: list[str], step: str, values: list[str], size: int = 10_000) -> DataFrame:
    """Parallel arrays by key, in step order, in blocks of at most ``size`` steps (``block`` counts them from 0): a table function that holds one block of one key."""
    kinds = [rows.schema[c].dataType.simpleString() for c in (step, *values)]
    names = [f"{c}s" for c in (step, *values)]
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "block int", *(f"{n} array<{t}>" for n, t in zip(names, kinds, strict=True))])
    given = rows.select(*keys, step, *values)
    at = len(keys)

    class Blocks:
        def __init__(self):
            self.key, self.held, self.block = (), [], 0

        def _made(self) -> tuple:
            made = (*self.key, self.block, *(list(c) for c in zip(*self.held, strict=True)))
            self.held, self.block = [], self.block + 1
            return made

        def eval(self, row: Row) -> Iterator[tuple]:
            self.key = tuple(row[:at])
            self.held.append(tuple(row[at:]))
            if len(self.held) == size:
                yield self._made()

        def terminate(self) -> Iterator[tuple]:
            if self.held:
                yield self._made()

    return F.udtf(Blocks, returnType=schema)(given.asTable().partitionBy(*keys).orderBy(step))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def curves(rows: DataFrame, metric: str) -> DataFrame:
    """Median, smallest and largest metric and mean tokens by scheme and fraction, non-finite values left out."""
    return rows.where(finite(F.col(metric))).groupBy("scheme", "fraction").agg(F.count("*").alias("n"), F.avg("tokens").alias("mean_tokens"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("median"), F.min(metric).alias("low"), F.max(metric).alias("high"))


def ordered_categories(rows: DataFrame) -> DataFrame:
    """(category, samples, place): materials of each category, the largest first, ties by name. The order runs over categories alone."""
    n = rows.groupBy("category").agg(F.countDistinct("task_id").alias("samples"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("samples"), "category")).cast("long"))


def category_medians(rows: DataFrame, metric: str) -> DataFrame:
    """(category, samples, place, median) of a metric."""
    medians = rows.groupBy("category").agg(F.percentile(metric, F.lit(0.5)).alias("median"))
    return ordered_categories(rows).join(medians, "category")


def by_category(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of several metrics by category and configuration, with the categories' sizes and order."""
    means = rows.groupBy("category", "scheme", "fraction").agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    return means.join(ordered_categories(rows), "category")


def cost(chips: Column, hours: Column, preemptible: Column) -> Column:
    """Chip-hours at the published rates per chip: 1.15 preemptible, 2.83 on demand."""
    return chips * hours * F.when(preemptible, 1.15).otherwise(2.83)


def markdown_lines(df: DataFrame) -> DataFrame:
    """(line) of a pipe table for each row: nulls are empty, bars in a value are escaped, a line end with the blanks around it becomes one space."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " "), F.lit(""))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report of at most ``most`` rows as a pipe table; more are an error, told by one row beyond."""
    rows = [r.line for r in markdown_lines(df).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write markdown_lines instead")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "| " + " | ".join(["---"] * len(df.columns)) + " |", *rows])
