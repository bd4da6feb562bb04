"""Tallies, coverage and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapgrid.functions.labels import study_label
from trapgrid.functions.text import recode
from trapgrid.operators.aggregates import distinct_count, frequency
from trapgrid.session import checkpointed


def class_names(categories: DataFrame) -> DataFrame:
    return categories.withColumn("className", recode(F.col("className"), {"Red Deer": "Elk"}))


def species_tally(results: DataFrame, categories: DataFrame, tag_label: str = "CA") -> DataFrame:
    """Count of each answer per study with class name and rank (by count, then answer).

    The window runs over counts: one row per study and class.
    """
    counts = (
        results.groupBy(study_label(F.col("imageID"), tag_label).alias("study"), "answer").agg(F.count("*").alias("n"))
    )
    names = class_names(categories).withColumnRenamed("Class_ID", "_class")
    named = counts.join(names, counts.answer.eqNullSafe(names["_class"]), "left").drop("_class")
    order = Window.partitionBy("study").orderBy(F.desc("n"), F.asc_nulls_last("answer"))
    return named.withColumn("order", F.row_number().over(order))


def camera_year_coverage(images: DataFrame, time: str = "DateTimeOriginal") -> DataFrame:
    """Photos per camera and year, zero cells included.

    The images are counted once; years, which a calendar bounds, and cells come from the kept counts.
    """
    counts = images.where(F.col(time).isNotNull()).groupBy("camID", F.year(time).alias("year")).agg(F.count("*").alias("n"))
    counts = checkpointed(counts)
    years = [r.year for r in counts.select("year").distinct().orderBy("year").collect()]
    wide = counts.groupBy("camID").pivot("year", years).agg(F.sum("n"))
    return wide.na.fill(0, [str(y) for y in years])


def length_table(df: DataFrame, column: str) -> DataFrame:
    """(length, n) of a text column."""
    lengths = df.select(F.char_length(column).alias("length"))
    return frequency(lengths, "length")


def quality_report(predictions: DataFrame, metadata: DataFrame, joined: DataFrame) -> DataFrame:
    """(check, column, value): missing values, rows without metadata (unmatched), with metadata but without
    a time (undated), duplicate file names, times that cannot be read, text lengths and rows per study,
    and the rows that a missing name on both sides has joined (nameless).

    `joined` is the left join of the two, with the parsed time in `photo_time` and `found`, which is
    true where there was metadata and missing elsewhere.
    """

    def rows(df: DataFrame, check: str, column, value) -> DataFrame:
        return df.select(F.lit(check).alias("check"), column.alias("column"), value.cast("long").alias("value"))

    def missing(df: DataFrame, columns: list[str], check: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.sum(f"missing_{c}").alias("n")) for c in columns])
        return rows(df.agg(pairs.alias("pairs")).select(F.inline("pairs")), check, F.col("column"), F.col("n"))

    def missing_per(df: DataFrame) -> list:
        return [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in df.columns]

    # Each input is read once; the reports below are made of these small tables.
    by_study = checkpointed(predictions.groupBy("study").agg(F.count("*").alias("n"), *missing_per(predictions)))
    unread = F.col("DateTimeOriginal").isNotNull() & F.col("photo_time").isNull()
    by_length = checkpointed(
        joined.groupBy(F.char_length("DateTimeOriginal").alias("length")).agg(
            F.count("*").alias("n"),
            F.count_if(unread).alias("unread"),
            F.count_if(F.col("found").isNull()).alias("unmatched"),
            F.count_if(F.col("found") & F.col("DateTimeOriginal").isNull()).alias("undated"),
            F.count_if(F.col("found") & F.col("FileName").isNull()).alias("nameless"),
        )
    )
    # One row: counts per column and the number of repeated names.
    whole = metadata.agg(*missing_per(metadata), (F.count("*") - distinct_count("FileName")).alias("twice"))
    whole = checkpointed(whole)
    sums = by_length.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unread", "unmatched", "undated", "nameless")])
    with_text = by_length.where(F.col("length").isNotNull())
    time_column = F.lit("DateTimeOriginal")
    parts = [
        missing(by_study, predictions.columns, "missing"),
        missing(whole, metadata.columns, "missing_metadata"),
        rows(sums, "unmatched", F.lit("FileName"), F.col("unmatched")),
        rows(sums, "undated", time_column, F.col("undated")),
        rows(sums, "nameless", F.lit("FileName"), F.col("nameless")),
        rows(sums, "unreadable", time_column, F.col("unread")),
        rows(whole, "duplicates", F.lit("FileName"), F.col("twice")),
        rows(with_text, "length", F.col("length").cast("string"), F.col("n")),
        rows(by_study.where(F.col("study").isNotNull()), "rows", F.col("study"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
