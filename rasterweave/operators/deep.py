"""Deep pixels: ordering, compositing, counting and checking of sample lists.

Samples are rows (y, x, z, zback, a, colours ..., tie-breakers). A pixel's samples are put in
order by (z, zback, tie-breakers), which has to be total: a table has no order to be stable in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("y", "x")
COLOURS = ("r", "g", "b")
#: Lines of a block whose totals are added up by themselves.
LINES = 1024


def depth_sorted(samples: DataFrame, values: Sequence[str], ties: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One row for each pixel with `samples`: an array of structs by ascending (z, zback, ties). zback null counts as z."""
    item = F.struct("z", F.coalesce("zback", "z").alias("zback"), *ties, *[v for v in values if v not in ("z", "zback")])
    return samples.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("samples"))


def over(samples: Column, values: Sequence[str] = COLOURS, alpha: str = "a") -> Column:
    """Front-to-back over of premultiplied values: a fold that adds (1 - alpha so far) x sample until alpha is one.

    Gives a struct of values and alpha; alpha is clamped to [0, 1] at the end, values are not.
    No samples give zeros.
    """
    fields = [*values, alpha]
    zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])

    def step(c: Column, s: Column) -> Column:
        rest = 1 - c[alpha]
        return F.when(c[alpha] >= 1, c).otherwise(F.struct(*[(c[f] + rest * s[f]).alias(f) for f in fields]))

    def finish(c: Column) -> Column:
        return F.struct(*[c[f].alias(f) for f in values], F.least(F.greatest(c[alpha], F.lit(0.0)), F.lit(1.0)).alias(alpha))

    return F.aggregate(samples, zero, step, finish)


#: The extension point: a name and a function from a sorted array of samples to a struct.
COMPOSITORS: dict[str, Callable[[Column], Column]] = {"over": over, "volumetric": over}


def register_compositor(name: str, function: Callable[[Column], Column]) -> None:
    """Make a compositing rule known by name; function builds the expression from the sorted samples."""
    COMPOSITORS[name] = function


def composite(samples: DataFrame, ties: Sequence[str], values: Sequence[str] = COLOURS, key: Sequence[str] = KEY, rule: str | None = None) -> DataFrame:
    """One row for each pixel: the composite of its samples. One shuffle, on the pixel.

    `over` is associative, but a pixel's samples have to meet for their order; a pixel that
    holds most of a table's samples can be folded in depth runs by composite_runs.
    """
    kept = [*dict.fromkeys([*values, "a"])]
    sorted_ = depth_sorted(samples, kept, ties, key)
    folded = COMPOSITORS[rule](F.col("samples")) if rule else over(F.col("samples"), [v for v in kept if v != "a"])
    return sorted_.select(*key, folded.alias("c")).select(*key, "c.*")


def composite_runs(samples: DataFrame, ties: Sequence[str], run: Column, values: Sequence[str] = COLOURS, key: Sequence[str] = KEY) -> DataFrame:
    """composite for pixels with very many samples: run cuts depth into ranges (a number that rises with z); each is folded by itself and the results are put over one another.

    Equal to composite where no alpha is above one or below zero: over is associative on
    premultiplied colour and alpha then.
    """
    parts = depth_sorted(samples.withColumn("_run", run), [*values, "a"], ties, [*key, "_run"])
    parts = parts.select(*key, "_run", over(F.col("samples"), values).alias("c"))
    runs = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_run", "c"))).alias("runs"))
    return runs.select(*key, over(F.transform("runs", lambda s: s["c"]), values).alias("c")).select(*key, "c.*")


def merge_sources(sources: Sequence[DataFrame], grid: DataFrame | None, ties: Sequence[str], values: Sequence[str] = COLOURS, key: Sequence[str] = KEY, budget: int = 0) -> DataFrame:
    """Composite of several sources: the samples of all are gathered by pixel. With a grid, its pixels without samples are zeros.

    budget > 0: an error when there are more samples than that.
    """
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    if budget > 0:
        held = every.agg(F.count("*")).first()[0]
        if held > budget:
            raise ValueError(f"{held} samples are over the budget of {budget}")
    out = composite(every, [*ties, "src"] if "src" in every.columns else ties, values, key)
    if grid is None:
        return out
    return grid.select(*key).join(out, [*key], "left").select(*key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in [*values, "a"]])


def line_budget(samples: DataFrame, budget: int) -> DataFrame:
    """(y, n, over): the samples of each line, and whether they are more than a reader of single lines may hold."""
    return samples.groupBy("y").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > budget)


def sample_counts(samples: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return samples.groupBy(*key).agg(F.count("*").alias("n"))


def count_table(counts: DataFrame, per_line: bool = False) -> DataFrame:
    """counts (y, x, n) with packed: the running sum over the image, or over each line (as chunks store it).

    Over the image, lines are summed first, then blocks of LINES lines, so that no task
    orders all pixels or all lines: only blocks' totals meet in one.
    """
    line = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    packed = counts.withColumn("packed", F.sum("n").over(line))
    if per_line:
        return packed
    lines = counts.groupBy("y").agg(F.sum("n").alias("_n")).withColumn("_block", F.floor(F.col("y") / LINES))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("_block").agg(F.sum("_n").alias("_n")).select("_block", earlier(Window.orderBy("_block")).alias("_blocks"))
    within = lines.select("y", "_block", earlier(Window.partitionBy("_block").orderBy("y")).alias("_lines"))
    before = within.join(blocks, "_block").select("y", (F.col("_lines") + F.col("_blocks")).alias("_before"))
    return packed.join(before, "y").select("y", "x", "n", (F.col("packed") + F.col("_before")).alias("packed"))


def count_table_unpacked(packed: DataFrame) -> DataFrame:
    """(y, x, n) of a per-line running sum."""
    return packed.withColumn("n", F.col("packed") - F.coalesce(F.lag("packed").over(Window.partitionBy("y").orderBy("x")), F.lit(0))).select("y", "x", "n")


def state_violations(samples: DataFrame, order: Sequence[str], state: str, key: Sequence[str] = KEY) -> DataFrame:
    """The first sample of each pixel that breaks a declared state, samples being in stored order.

    sorted: z is not below the z before; nonoverlapping: z is not below the zback before; tidy:
    both; messy: nothing is asked.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    at = samples.select(*key, "z", F.coalesce("zback", "z").alias("zb"), *[o for o in order if o not in ("z",)])
    at = at.select(*key, (F.row_number().over(w) - 1).alias("sample"), "z", F.lag("z").over(w).alias("_z"), F.lag("zb").over(w).alias("_zb"))
    bad_sorted = (F.col("z") < F.col("_z")) if state in ("sorted", "tidy") else F.lit(False)
    bad_overlap = (F.col("z") < F.col("_zb")) if state in ("nonoverlapping", "tidy") else F.lit(False)
    found = at.where(bad_sorted | bad_overlap).withColumn("rule", F.when(bad_sorted, "sorted").otherwise("nonoverlapping"))
    return found.groupBy(*key).agg(F.min(F.struct("sample", "rule")).alias("f")).select(*key, "f.*")


def is_volumetric(z: Column, zback: Column) -> Column:
    return F.coalesce(zback, z) != z


def is_opaque(a: Column) -> Column:
    return a >= 1
