"""Checks as frames of violations, and the errors they raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdance.storage import materialize


class ValidationError(ValueError):
    """Input or result that breaks a rule."""


def assert_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raise with a few examples, in sorted order, if there is any violation."""
    found = violations.orderBy(*[F.col(f"`{c}`") for c in violations.columns]).limit(shown).collect()
    if found:
        raise ValidationError(f"{message}; examples: {[tuple(r) for r in found]}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def set_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` on one side only: ``(key, side)``."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def with_previous(sites: DataFrame, chrom: str = "chrom", pos: str = "pos_n", row: str = "row_index") -> DataFrame:
    """``(chrom, pos, row, prev_pos, prev_row)``: each row with the row before it on the same chromosome.

    Rows are cut into parts by their place in the file, whatever their
    chromosome, so a chromosome with most of the rows is read by many tasks.
    Inside a part the row before is the part's own; for the first row of a
    chromosome in a part it is that chromosome's last row in the parts before,
    taken from one summary row for each chromosome and part.
    """
    parts = sites.select(chrom, pos, row).repartitionByRange(row).withColumn("__part", F.spark_partition_id())
    # Written once: the cuts come from a sample, and both reads must see the same parts.
    parts = materialize(parts, "order-parts")
    own = Window.partitionBy("__part", chrom).orderBy(row)
    last = parts.groupBy("__part", chrom).agg(F.max(F.struct(F.col(row).alias("r"), F.col(pos).alias("p"))).alias("last"))
    carried = last.select("__part", F.col(chrom), F.lag("last").over(Window.partitionBy(chrom).orderBy("__part")).alias("carried"))
    here = parts.withColumn("prev", F.lag(F.struct(F.col(row).alias("r"), F.col(pos).alias("p"))).over(own))
    edge = here.where("prev is null").drop("prev").join(carried.where("carried is not null").withColumnRenamed("carried", "prev"), ["__part", chrom])
    both = here.where("prev is not null").unionByName(edge)
    return both.select(chrom, pos, row, F.col("prev.p").alias("prev_pos"), F.col("prev.r").alias("prev_row"))


def order_violations(sites: DataFrame, chrom: str = "chrom", pos: str = "pos_n", row: str = "row_index") -> DataFrame:
    """Rows that break a file's order: a position that does not rise inside its chromosome, or a chromosome that comes back."""
    why = F.when(F.col(pos) <= F.col("prev_pos"), "unsorted_or_duplicate").when(F.col(row) != F.col("prev_row") + 1, "noncontiguous_chromosome")
    return with_previous(sites, chrom, pos, row).withColumn("violation", why).where("violation is not null").select(chrom, pos, row, "violation")


def chromosome_overlaps(sites: DataFrame, chrom: str = "chrom", row: str = "row_index") -> DataFrame:
    """Chromosomes whose rows mix with another's: row ranges per chromosome, of which there are few, must not overlap."""
    spans = sites.groupBy(chrom).agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"))
    before = F.max("last_row").over(Window.orderBy("first_row").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("before", before).where("first_row <= before").drop("before")


def unsorted_positions(sites: DataFrame, chrom: str = "chrom", pos: str = "pos_n", row: str = "row_index") -> DataFrame:
    """Rows whose position does not rise over the row before on the same chromosome."""
    return with_previous(sites, chrom, pos, row).where(F.col(pos) <= F.col("prev_pos")).select(chrom, pos, row)
