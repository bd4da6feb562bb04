"""How much data survives each confidence threshold, for all thresholds in one pass.

Thresholds are start + i * step as doubles, and a value survives if it is strictly greater.
Each row is reduced to the number of thresholds below its value; the curve is then a running
sum over at most a hundred counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapgrid.functions.clock import elapsed, grain
from trapgrid.plans.occupancy import (
    MASK_GRAINS,
    _need_time,
    _one_row,
    _unmasked,
    _whole_div,
    cells,
    end_cut,
    regular_codes,
)
from trapgrid.session import checkpointed

# Species groups of the image sweep (classifier code, None = every image).
SWEEP_SPECIES = {"all": None, "cattle": 1, "bobcat": 13, "deer": 15, "mountain_lion": 20, "pig": 22}
PIG = 22


def thresholds(start: float, step: float, n: int) -> list[float]:
    return [start + i * step for i in range(n)]


def thresholds_below(value: Column, start: float, step: float, n: int) -> Column:
    """How many of the n thresholds are below `value`; 0 if it is missing.

    Found by arithmetic and settled by comparing with the three nearest thresholds, so that
    the cost per row does not grow with n.
    """
    clean = F.when(value.isNotNull() & ~F.isnan(value), value)
    clipped = F.least(F.greatest(clean, F.lit(start - 2 * step)), F.lit(start + (n + 2) * step))
    near = F.floor((clipped - F.lit(start)) / F.lit(step)).cast("int")
    count = F.greatest(F.lit(0), F.least(F.lit(n), near - 1))
    for offset in (-1, 0, 1):
        i = near + offset
        below = (i >= 0) & (i < n) & (clean > F.lit(start) + i.cast("double") * F.lit(step))
        count = count + F.when(below, 1).otherwise(0)
    return F.when(clean.isNull(), 0).otherwise(count).cast("int")


def _grid(spark: SparkSession, n: int, names: list[str] | None = None) -> DataFrame:
    """(i) for the numbers below `n`, for each of the names if there are any. A few hundred rows."""
    numbers = spark.range(n).select(F.col("id").cast("int").alias("i"))
    return numbers if names is None else numbers.select(F.explode(F.array(*map(F.lit, names))).alias("species"), "i")


def _curve(counts: DataFrame, names: list[str] | None, start: float, step: float, n: int) -> DataFrame:
    """(species, threshold, kept, total) from counts per number of passed thresholds; without names for one curve.

    `counts` has at most n + 1 rows per name. Every name has all thresholds: where nothing was
    counted, 0 of 0 are kept and the share is missing.
    """
    group = [] if names is None else ["species"]
    spread = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    summed = spread.groupBy(*group, "i").agg(
        F.sum(F.when(F.col("k") > F.col("i"), F.col("n")).otherwise(0)).alias("kept"), F.sum("n").alias("total")
    )
    summed = _grid(counts.sparkSession, n, names).join(summed, [*group, "i"], "left").fillna(0, ["kept", "total"])
    threshold = F.lit(start) + F.col("i").cast("double") * F.lit(step)
    return summed.select(
        *group,
        threshold.alias("threshold"),
        "kept",
        "total",
        F.when(F.col("total") > 0, F.col("kept").cast("double") / F.col("total")).alias("prop_retained"),
    )


def image_retention(
    images: DataFrame,
    groups: dict[str, int | None] | None = None,
    start: float = 0.2,
    step: float = 0.01,
    n: int = 80,
) -> DataFrame:
    """Share of the images of each species group above each threshold."""
    groups = SWEEP_SPECIES if groups is None else groups
    counts = images.groupBy(
        F.col("GUESS1").alias("guess"), thresholds_below(F.col("CONFIDENCE1"), start, step, n).alias("k")
    ).agg(F.count("*").alias("n"))
    labels = [
        F.when(F.lit(True) if code is None else F.col("guess") == code, F.lit(name)) for name, code in groups.items()
    ]
    named = counts.withColumn("species", F.explode(F.array_compact(F.array(*labels))))
    return _curve(named.select("species", "k", "n"), list(groups), start, step, n)


def burst_retention(
    images: DataFrame, species: int = PIG, start: float = 0.5, step: float = 0.01, n: int = 51
) -> DataFrame:
    """Share of the bursts with a guess of the species whose best confidence is above each threshold.

    Images without a burst count as one burst.
    """
    bursts = images.where(F.col("GUESS1") == species).groupBy("cam_chk_burst").agg(F.max("CONFIDENCE1").alias("b_max"))
    counts = bursts.groupBy(thresholds_below(F.col("b_max"), start, step, n).alias("k")).agg(F.count("*").alias("n"))
    return _curve(counts, None, start, step, n)


def occupancy_sweep(
    images: DataFrame,
    deployments: DataFrame | None,
    species: int,
    time_int: str,
    baseline: float,
    start: float,
    step: float = 0.01,
    n: int = 49,
    time: str = "DateTimeOriginal",
) -> DataFrame:
    """Detections in the masked occupancy table lost at each threshold against `baseline`.

    Equals building the table once per threshold: a cell is 1 at t iff its best confidence is
    above t, and the mask is worked out for the columns that the table has at each t. Without
    `deployments` the table is not zero-completed, so its columns are the detections alone.
    """
    g = grain(time_int, MASK_GRAINS)
    _need_time(images, time)
    return sweep_of(cells(images, species, g, time), deployments, time_int, baseline, start, step, n)


def sweep_of(
    base: DataFrame, deployments: DataFrame | None, time_int: str, baseline: float, start: float, step: float = 0.01, n: int = 49
) -> DataFrame:
    """occupancy_sweep from the cells of a species and a grain."""
    g = grain(time_int, MASK_GRAINS)
    if start < baseline:
        raise ValueError("thresholds must not be below the baseline")
    # Kept in the shared folder: three aggregates below read the cells, the images only once.
    base = checkpointed(base)
    # The columns of the table at each level (0 = baseline): a calendar times the levels
    # bounds these rows and everything made of them.
    by_code = base.groupBy("code").agg(
        F.max("best").alias("best"), F.min("first_photo").alias("first"), F.max("last_photo").alias("last")
    )
    study = by_code.agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sort_array(F.collect_set(_whole_div(F.col("code")))).alias("years"),
    )
    shown = by_code.select("code", "best").where(F.col("best") > baseline)
    if deployments is not None:
        _need_time(deployments, "SetDate")
        period = study.withColumn("first_set", deployments.agg(F.min("SetDate")).scalar())
        regular = regular_codes(F.col("years"), F.col("first_set"), F.col("last"), g)
        always = period.select(F.explode(regular).alias("code"), F.lit(float("inf")).alias("best"))
        shown = shown.union(always).groupBy("code").agg(F.max("best").alias("best"))
    columns = shown.select("code", F.explode(F.sequence(F.lit(0), thresholds_below(F.col("best"), start, step, n))).alias("level"))
    ordered = Window.partitionBy("level").orderBy("code")
    columns = columns.withColumn("position", F.row_number().over(ordered) - 1)
    ends = columns.groupBy("level").agg(F.min("code").alias("head"), F.max("code").alias("tail"))
    ends = ends.agg(
        F.map_from_entries(F.collect_list(F.struct("level", _whole_div(F.col("head"))))).alias("first_years"),
        F.map_from_entries(F.collect_list(F.struct("level", "tail"))).alias("tails"),
    )
    at_position = columns.groupBy("position").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "code"))).alias("codes")
    )

    # One row per camera with its detections above the baseline.
    sites = base.groupBy("camID").agg(
        F.min("first_photo").alias("s"),
        F.max("last_photo").alias("e"),
        F.collect_list(F.when(F.col("best") > baseline, F.struct("code", "best"))).alias("hits"),
    )
    if deployments is not None:
        sites = deployments.select("camID").distinct().join(sites, "camID")
    sites = sites.where(F.size("hits") > 0).withColumns(
        {"study": _one_row(study.select("first", "last")), "columns": _one_row(ends)}
    )
    late = elapsed(F.col("s"), F.col("study.first"), g.name)
    sites = sites.withColumn("position", F.when(F.abs(late) > 1, F.rint(late).cast("int")))
    sites = sites.join(at_position, "position", "left").withColumns(
        {"start_yr": F.year("s"), "start_code": g.code(F.col("s"))}
    )

    def start_at(level: Column) -> Column:
        other_year = F.try_element_at("columns.first_years", level) != F.col("start_yr")
        place = F.coalesce(F.try_element_at("codes", level), F.try_element_at("columns.tails", level))
        cut = F.when(other_year, F.col("start_code")).otherwise(place)
        return F.when(F.col("position").isNotNull(), cut)

    sites = sites.select(
        "camID",
        "hits",
        F.transform(F.sequence(F.lit(0), F.lit(n)), start_at).alias("starts"),
        end_cut(F.col("e"), g, (F.col("e"), F.col("study.last"))).alias("end"),
    )
    hits = sites.select("starts", "end", F.inline("hits"))
    passed = F.lit(1) + thresholds_below(F.col("best"), start, step, n)
    hits = hits.withColumn("passed", passed)

    # Entries (k, n): n detections that count in the first k levels. A camera whose mask is
    # the same at all levels needs one entry per detection.
    def keeps(first_shown: Column) -> Column:
        return _unmasked(F.col("code"), first_shown, F.col("end"))

    same = F.size(F.array_distinct("starts")) == 1
    entry = F.array(F.struct(F.col("passed").alias("k"), F.lit(1).alias("n")))
    levels_kept = F.filter(F.sequence(F.lit(1), F.col("passed")), lambda k: keeps(F.get(F.col("starts"), k - 1)))
    pieces = F.flatten(
        F.transform(
            levels_kept,
            lambda k: F.array(
                F.struct(k.alias("k"), F.lit(1).alias("n")), F.struct((k - 1).alias("k"), F.lit(-1).alias("n"))
            ),
        )
    )
    none = F.array().cast("array<struct<k:int,n:int>>")
    entries = F.when(same, F.when(keeps(F.get("starts", F.lit(0))), entry).otherwise(none)).otherwise(pieces)
    counts = hits.select(F.inline(entries)).groupBy("k").agg(F.sum("n").alias("n"))

    # At most n + 2 counts from here on; every threshold has a row, also where nothing is seen.
    spread = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    totals = spread.groupBy("i").agg(F.sum(F.when(F.col("k") > F.col("i"), F.col("n")).otherwise(0)).alias("total"))
    totals = _grid(base.sparkSession, n + 1).join(totals, "i", "left").fillna(0, ["total"])
    at_base = totals.where(F.col("i") == 0).select("total").scalar()
    threshold = F.lit(start) + (F.col("i") - 1).cast("double") * F.lit(step)
    changed = F.col("base") - F.col("total")
    return (
        totals.where(F.col("i") > 0)
        .withColumn("base", at_base)
        .select(
            threshold.alias("threshold"),
            F.col("total").alias("occ_total"),
            changed.alias("occ_int_changed"),
            F.when(F.col("base") > 0, changed.cast("double") / F.col("base")).alias("prop_changed"),
        )
    )
