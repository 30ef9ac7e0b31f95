"""Anchors and invariants over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchor_checks(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """``observed(Item, Observed)`` against ``expected(Item, Expected)``, both doubles.

    Whole expected numbers must be met exactly, others within 1e-8; an item
    that nothing observes is NOT_IMPLEMENTED, which counts as a failure.
    """
    tolerance = F.when(F.col("Expected") == F.floor("Expected"), 0.0).otherwise(1e-8)
    diff = F.abs(F.col("Observed") - F.col("Expected"))
    status = F.when(F.col("Observed").isNull(), "NOT_IMPLEMENTED").when(diff <= tolerance, "PASS").otherwise("FAIL")
    known = F.col("Observed").isNotNull()
    return expected.join(observed, "Item", "left").select("Item", "Observed", "Expected", diff.alias("Absolute_difference"), F.when(known, tolerance).alias("Tolerance"), status.alias("Status"))


def invariants(metrics: DataFrame, rules: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``(Invariant, Status, Detail)``, one row per rule: an SQL condition over the one-row frame ``metrics`` and the columns that its detail shows.

    A null condition counts as failed.  Whole numbers are shown without a point.
    """

    def shown(name: str) -> Column:
        x = F.col(name).cast("double")
        text = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
        return F.concat(F.lit(f"{name}="), F.coalesce(text, F.lit("NA")))

    status = lambda r: F.when(F.coalesce(F.expr(r), F.lit(False)), "PASS").otherwise("FAIL")
    rows = F.array(*[F.struct(F.lit(n).alias("Invariant"), status(r).alias("Status"), F.concat_ws(", ", *map(shown, names)).alias("Detail")) for n, (r, names) in rules.items()])
    return metrics.select(F.explode(rows).alias("r")).select("r.*")


def failures(*tables: DataFrame) -> DataFrame:
    """Names of all rows that did not pass."""
    out = None
    for t in tables:
        part = t.where("Status <> 'PASS'").select(F.col(t.columns[0]).alias("name"), "Status")
        out = part if out is None else out.unionByName(part)
    return out
