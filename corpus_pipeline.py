"""Documents to packed training sequences, in stages that are written and read again one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapgrid.llm import decontaminate, near_dedup, packing, quality, secret_scan
from trapgrid.llm.frames import free_name, stored
from trapgrid.llm.queries import read, tokenizer_path


def _with_size(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`change(docs)`, where n_chars, if it is a column, follows the texts that have changed."""
    if "n_chars" not in docs.columns:
        return change(docs)
    was, size = free_name(docs, "was"), F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = change(docs.withColumn(was, F.col("text")))
    return changed.withColumn("n_chars", F.when(F.col("text") != F.col(was), size).otherwise(F.col("n_chars"))).drop(was)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; n_chars, where it is a column, follows the new text.

    Null and empty texts go, ids do not matter, repeated rows are each judged, an empty table stays empty.
    """
    return _with_size(docs, quality.without_failing_lines)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of repeated rows with that id, one.

    Where no document of a group has an id, one of them stays. Different texts under one id all stay, as do documents
    without words. An empty table stays empty.
    """
    return near_dedup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than a twentieth of the words stand in passages of benchmark items."""
    name = free_name(docs, "hits")
    found = decontaminate.benchmark_hits(docs, read(spark, sf_dir, "benchmark"), name)
    return found.where(~decontaminate.is_contaminated(name)).drop(name)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with "[secret]" in the place of each secret; n_chars, where it is a column, follows the new text."""
    path = "source" if "source" in docs.columns else None
    secrets = stored(secret_scan.find_secrets(docs, path=path).where("is_secret"), "secrets")
    return _with_size(docs, lambda rows: secret_scan.without_secrets(rows, secrets))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, packed into sequences of at most 2048."""
    return packing.packed_pieces(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Tokenizer ids, sketches and a trained forest are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
