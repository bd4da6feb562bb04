"""A stored table of cells, from which occupancy tables and sweeps of any species, grain and threshold are made.

A cell is a camera, a species and a day (or hour): best confidence, first and last photo. Images are
read once, when their check is added. Cells merge by maximum and minimum, so that a coarser grain is
a roll-up, a new check is one more set of files, and a check that is added twice changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapgrid.functions.clock import grain
from trapgrid.plans.occupancy import _YEAR, MASK_GRAINS, _need_time, grid_of, grid_rows, occupancy_of, occupancy_rows, seen, spread
from trapgrid.plans.sweeps import sweep_of
from trapgrid.session import checkpointed

#: Grains that the cells of a store can be rolled up to, by the unit the store keeps.
UNITS = {"day": ("day", "week", "month"), "hour": ("hour", "day", "week", "month")}
_SCHEMA = "camID string, GUESS1 int, best double, first_photo timestamp_ntz, last_photo timestamp_ntz, check string, year int"


@dataclass(frozen=True)
class CellStore:
    """Cells of the checks that were added, as parquet below `path`, by check and year."""

    path: str
    unit: str = "day"

    def __post_init__(self) -> None:
        grain(self.unit, tuple(UNITS))

    def add(self, images: DataFrame, check: str, time: str = "DateTimeOriginal") -> None:
        """Adds the images of a check in one pass over them, in place of what the store had of that check.

        Photos without a camera or a time are in no cell. A job that fails while it replaces a check leaves the store without it
        until it is added again; other checks are not touched.
        """
        if not re.fullmatch(r"\w[\w.-]*", check):
            raise ValueError(f"a check is named by letters, digits, dots and signs, not {check!r}")
        _need_time(images, time)
        at, g = F.col(time).cast("timestamp_ntz"), grain(self.unit, tuple(UNITS))
        score = F.coalesce(F.when(~F.isnan("CONFIDENCE1"), F.col("CONFIDENCE1").cast("double")), F.lit(float("-inf")))
        made = (
            images.where(F.col("camID").isNotNull() & at.isNotNull())
            .groupBy("camID", F.col("GUESS1").cast("int").alias("GUESS1"), g.code(at).alias("code"))
            .agg(F.max(score).alias("best"), F.min(at).alias("first_photo"), F.max(at).alias("last_photo"))
        )
        made = made.withColumn("year", F.floor(F.col("code") / _YEAR).cast("int")).drop("code")
        made.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(f"{self.path.rstrip('/')}/check={check}")

    def rows(self, spark: SparkSession, year: int | None = None) -> DataFrame:
        """Stored rows of all checks; those of one year are a partition that is read alone."""
        kept = spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(self.path)
        return kept if year is None else kept.where(F.col("year") == year)

    def cells(self, spark: SparkSession, species: int, time_int: str, year: int | None = None) -> DataFrame:
        """The cells of `species` at a grain, over all checks; every camera's photos count for the first and last one."""
        g = grain(time_int, UNITS[self.unit])
        # All photos of a stored row fall into one interval of any coarser grain, that of its first photo.
        return (
            self.rows(spark, year)
            .groupBy("camID", g.code(F.col("first_photo")).alias("code"))
            .agg(
                F.max(F.when(F.col("GUESS1") == species, F.col("best"))).alias("best"),
                F.min("first_photo").alias("first_photo"),
                F.max("last_photo").alias("last_photo"),
            )
        )

    def detection_grid(self, spark: SparkSession, species: int, thresh: float | None, time_int: str, missing_site: int | None = 0, year: int | None = None) -> DataFrame:
        return grid_of(self.cells(spark, species, time_int, year), thresh, missing_site)

    def occupancy(
        self, spark: SparkSession, deployments: DataFrame, species: int, thresh: float | None, time_int: str, mask: bool = True, year: int | None = None
    ) -> DataFrame:
        return occupancy_of(self.cells(spark, species, time_int, year), deployments, thresh, time_int, mask)

    def occupancy_sweep(
        self, spark: SparkSession, deployments: DataFrame | None, species: int, time_int: str, baseline: float, start: float, step: float = 0.01, n: int = 49
    ) -> DataFrame:
        return sweep_of(self.cells(spark, species, time_int), deployments, time_int, baseline, start, step, n)

    def tables(self, spark: SparkSession, deployments: DataFrame, species: Iterable[int], thresh: float | None, time_ints: Iterable[str]) -> DataFrame:
        """(species, time_int, camID, year, interval, occ): the masked table of each species and grain, by month the detection grid.

        All tables come from one pass over the stored rows and the deployments, which leaves one row per camera in the shared folder.
        """
        species, grains = list(species), [grain(g, UNITS[self.unit]) for g in time_ints]
        if any(g.name in MASK_GRAINS for g in grains):
            _need_time(deployments, "SetDate")
        unit = F.to_date("first_photo")
        if any(g.name == "hour" for g in grains):
            unit = unit.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("first_photo"))
        made = self.rows(spark).groupBy("camID").agg(
            F.min("first_photo").alias("s"),
            F.max("last_photo").alias("e"),
            F.collect_set(F.year("first_photo")).alias("years"),
            *[F.collect_set(F.when((F.col("GUESS1") == n) & seen(thresh), unit)).alias(f"at{i}") for i, n in enumerate(species)],
        )
        sites = deployments.groupBy("camID").agg(F.min("SetDate").alias("SetDate"), F.lit(True).alias("listed"))
        kept = checkpointed(spread(made.join(sites, "camID", "full_outer")))
        lists = {c: kept.select(F.explode(c).alias(c)).distinct().agg(F.sort_array(F.collect_set(c))).scalar() for c in ("years", *[f"at{i}" for i in range(len(species))])}
        limits = kept.agg(F.min("s").alias("first"), F.max("e").alias("last"), F.min("SetDate").alias("first_set"))
        limits = checkpointed(limits.withColumns(lists))
        parts = []
        for i, n in enumerate(species):
            for g in grains:
                codes = F.array_distinct(F.transform(f"at{i}", g.code))
                rows = kept.withColumn("hits", codes)
                if g.name == "month":
                    table = grid_rows(rows.where("s is not null"), limits.select(codes).scalar())
                else:
                    table = occupancy_rows(rows.where("listed").select("camID", "s", "e", "hits"), limits.withColumn("found", codes), g)
                parts.append(table.select(F.lit(n).alias("species"), F.lit(g.name).alias("time_int"), "camID", "year", "interval", "occ"))
        return reduce(DataFrame.union, parts)
