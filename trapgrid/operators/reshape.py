"""Long and wide occupancy tables, and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapgrid.session import checkpointed


def interval_label(time_int: str) -> Column:
    """Name of a wide column, such as 2015_week_7."""
    return F.concat_ws("_", F.col("year"), F.lit(time_int), F.col("interval"))


def widen(occ: DataFrame, time_int: str) -> DataFrame:
    """One row per camera, one column per year and interval in calendar order.

    The long table is kept in the shared folder, so that its plan runs once; the column list comes from
    there, and a calendar bounds it (12, 53 or 366 per year).
    """
    occ = checkpointed(occ)
    intervals = occ.select("year", "interval").distinct().orderBy("year", "interval").collect()
    labels = [f"{r.year}_{time_int}_{r.interval}" for r in intervals]
    labelled = occ.select("camID", interval_label(time_int).alias("label"), "occ")
    return labelled.groupBy("camID").pivot("label", labels).agg(F.max("occ"))


def camera_lines(occ: DataFrame, time_int: str) -> DataFrame:
    """One CSV line per camera with the value of each interval in calendar order; the column's name is the header line.

    A camera's intervals are one array, which a calendar bounds (8,784 an hourly year); no column is made of any. Missing values and intervals that a camera
    lacks are NA; of several values of one interval the largest counts. A camera's name must be on one line.
    """
    occ = checkpointed(occ)
    intervals = occ.select("year", "interval").distinct().orderBy("year", "interval").collect()
    header = ",".join(["camID", *[f"{r.year}_{time_int}_{r.interval}" for r in intervals]])
    code = (F.col("year") * 10_000 + F.col("interval")).cast("int").alias("code")
    codes = occ.agg(F.collect_set(code)).scalar()
    cells = occ.groupBy("camID", code).agg(F.max("occ").cast("int").alias("occ"))
    sites = cells.groupBy("camID").agg(F.collect_list(F.struct("code", "occ")).alias("cells")).withColumn("codes", codes)
    rest = F.transform(F.array_except("codes", F.col("cells.code")), lambda c: F.struct(c.alias("code"), F.lit(None).cast("int").alias("occ")))
    fields = F.transform(F.array_sort(F.concat("cells", rest)), lambda c: F.coalesce(c["occ"].cast("string"), F.lit("NA")))
    broken = F.raise_error(F.concat(F.lit("a camera's name goes over several lines: "), "camID"))
    quoted = F.concat(F.lit('"'), F.replace("camID", F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.when(F.col("camID").rlike("[\r\n]"), broken).when(F.col("camID").rlike('[",]'), quoted).otherwise(F.coalesce("camID", F.lit("NA")))
    return sites.select(F.concat_ws(",", name, F.array_join(fields, ",")).alias(header))


def from_camera_lines(lines: DataFrame, header: list[str]) -> DataFrame:
    """(camID, year, interval, occ) from lines of a wide CSV table in `line`; `header` has its column names."""
    parts = [label.rsplit("_", 2) for label in header[1:]]
    codes = F.split(F.lit(",".join(str(int(y) * 10_000 + int(i)) for y, _, i in parts)), ",")
    quoted = F.col("line").startswith('"')
    name = F.when(quoted, F.regexp_extract("line", '^"((?:[^"]|"")*)"', 1)).otherwise(F.substring_index("line", ",", 1))
    rest = F.when(quoted, F.regexp_replace("line", '^"(?:[^"]|"")*",?', "")).otherwise(F.regexp_replace("line", "^[^,]*,?", ""))
    plain = F.when(quoted, F.replace(name, F.lit('""'), F.lit('"'))).otherwise(F.when(~name.isin("", "NA"), name))
    rows = lines.select(plain.alias("camID"), F.arrays_zip(codes.cast("array<int>").alias("code"), F.split(rest, ",").alias("value")).alias("cells"))
    long = rows.select("camID", F.inline("cells"))
    return long.select(
        "camID",
        F.floor(F.col("code") / 10_000).cast("int").alias("year"),
        (F.col("code") % 10_000).cast("int").alias("interval"),
        F.col("value").try_cast("int").alias("occ"),
    )


def lengthen(wide: DataFrame) -> DataFrame:
    """A wide occupancy table as (camID, year, interval, occ)."""
    columns = [c for c in wide.columns if c != "camID"]
    long = wide.unpivot("camID", columns, "label", "occ")
    parts = F.split("label", "_")
    return long.select(
        "camID", parts[0].cast("int").alias("year"), parts[2].cast("int").alias("interval"), "occ"
    )


def title_case_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.capitalize() for c in df.columns])
